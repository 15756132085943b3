"""All registered image queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom import queries as _queries  # noqa: F401  registers
from gridloom.plans import embedding as _embedding, files as _files, filters as _filters, geometry as _geometry, patches_to_volume as _patches, reconstruction as _reconstruction, registration as _registration, reports as _reports, volumes as _volumes  # noqa: F401
from gridloom.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

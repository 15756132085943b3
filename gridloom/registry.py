"""Registered queries, their SQL, and the views that the SQL is made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PX = """px AS (SELECT vec_id AS slice_id, label AS stack_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y,
  CAST(floor(500 * (CAST(embedding[i + 1] AS DOUBLE) + 1)) AS INT) AS v FROM embeddings, range(64) t(i))"""
PX3 = f"""{PX}, rk AS (SELECT vec_id AS slice_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS z FROM embeddings),
  px3 AS (SELECT px.*, z FROM px JOIN rk USING (slice_id))"""


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating-point columns rounded, with no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(c: str, name: str) -> str:
    """The SQL of a rounded column."""
    return f"round({c}, 6) + 0.0 AS {name}"

"""Spectral embedding of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import spectral
from gridloom.registry import query, rounded
from gridloom.scratch import Scratch
from gridloom.sources import surrogate as sg

#: Grey levels of a band.
BAND = 125


def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links both ways between slices (their ids) and what they show: a pixel place in a band of grey levels (numbers below zero). Linear in the pixels; no pairs of slices."""
    shown = (-1 - (F.floor(F.col("v") / BAND) * 64 + F.col("y") * sg.SIDE + F.col("x"))).cast("long")
    seen = sg.px(spark, sf_dir).select(F.col("slice_id").cast("long").alias("a"), shown.alias("b"), F.lit(1.0).alias("w"))
    return seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


@query()
def spectral_embedding(spark, sf_dir):
    """Slices by three vectors of the graph of all slices and what they show; slices that show alike lie together."""
    rows, _, residual = spectral.embedded(affinity(spark, sf_dir), 3, Scratch(spark), bound=1e-4)
    return rounded(rows.filter("id >= 0").select(F.col("id").alias("slice_id"), *[F.get("vector", F.lit(j)).alias(f"e{j}") for j in range(3)])).withColumn("residual", F.lit(residual))

"""Slices that arrive in files, measured as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def slices(spark: SparkSession, path: str, schema: str = "vec_id long, embedding array<float>, label int") -> DataFrame:
    """A stream of block-form images from a folder of Parquet files."""
    level = F.transform("embedding", lambda e: F.floor(500 * (e.cast("double") + 1)).cast("int"))
    return spark.readStream.schema(schema).parquet(path).select(F.col("vec_id").alias("slice_id"), F.col("label").alias("stack_id"), level.alias("pixels"))


def running_means(images: DataFrame) -> DataFrame:
    """stack_id, slices and mean over all that has arrived; per-slice sums are taken before the state."""
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, v: s + v)
    return images.select("stack_id", total.alias("s"), F.size("pixels").alias("n")).groupBy("stack_id").agg(F.count("*").alias("n_slices"), (F.sum("s") / F.sum("n")).alias("mean"))

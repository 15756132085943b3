"""Pixel views of the supplied tables: one embedding row is an 8 x 8 slice, its label the stack.

Block form holds an image a row (pixels, x fastest); long form a pixel a row.
Block form needs no shuffle for what stays inside an image; long form is for
joins on coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice_id, stack_id, pixels (int)."""
    level = F.transform("embedding", lambda e: F.floor(500 * (e.cast("double") + 1)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slice_id"), F.col("label").alias("stack_id"), level.alias("pixels"))


def explode_pixels(images: DataFrame, nx: int = SIDE, pixels: str = "pixels", value: str = "v") -> DataFrame:
    """Long form of a block form: the image's columns, x, y and the value."""
    keep = [c for c in images.columns if c != pixels]
    long = images.select(*keep, F.posexplode(pixels).alias("_at", value))
    return long.select(*keep, (F.col("_at") % nx).alias("x"), F.floor(F.col("_at") / nx).cast("int").alias("y"), value)


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice_id, stack_id, x, y, v."""
    return explode_pixels(blocks(spark, sf_dir))


def ranked(images: DataFrame) -> DataFrame:
    """Adds z, the place of a slice in its stack. Ids alone are ranked; pixels never pass the window."""
    ids = images.select(F.col("slice_id").alias("_id"), "stack_id")
    ranks = ids.select("_id", (F.row_number().over(W.partitionBy("stack_id").orderBy("_id")) - 1).cast("int").alias("z"))
    return images.join(ranks, images["slice_id"] == ranks["_id"]).drop("_id")


def with_depth(images: DataFrame) -> DataFrame:
    """Adds nz, the number of slices of the stack of an image with z."""
    depth = images.groupBy(F.col("stack_id").alias("_stack")).agg((F.max("z") + 1).cast("int").alias("nz"))
    return images.join(depth, images["stack_id"] == depth["_stack"]).drop("_stack")


def px3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form with z; ranks are taken over images, not pixels."""
    return explode_pixels(ranked(blocks(spark, sf_dir)))


def pose(slice_id: Column) -> dict[str, Column]:
    """Fixed rigid parameters of a slice: millimetres and degrees."""
    d = lambda c: c.cast("double")
    return {
        "tx": d(slice_id % 5) - 2, "ty": d(slice_id % 3) - 1, "tz": d(slice_id % 2) * 0.5,
        "rx": d(slice_id % 4) * 2, "ry": d(slice_id % 6) * 1.5, "rz": d(slice_id % 7) * 3,
    }


#: A 3 x 3 x 3 normalised Gaussian with one-dimensional weights 1/4, 1/2, 1/4.
PSF = [(dx, dy, dz, (0.5 if dx == 0 else 0.25) * (0.5 if dy == 0 else 0.25) * (0.5 if dz == 0 else 0.25)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]

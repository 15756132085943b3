"""Projections, masks, statistics and splits of images in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

PADDING = -1


# Statistics


def statistics(rows: DataFrame, by: Sequence[str], value: str = "v", padding: float = PADDING) -> DataFrame:
    """Range, range above padding, means of positive and of all values, and the deviation over all."""
    v = F.col(value)
    above = F.when(v > padding, v)
    return rows.groupBy(*by).agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.min(above).alias("low_pad"), F.max(above).alias("high_pad"),
        F.avg(F.when(v > 0, v.cast("double"))).alias("mean_positive"), F.avg(v.cast("double")).alias("mean_all"), F.stddev_pop(v.cast("double")).alias("sd"),
    )


def peak(rows: DataFrame, by: Sequence[str], value: str = "v", axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """The place of the highest value, the first in axes' order on ties."""
    best = F.max_by(F.struct(*axes), F.struct(F.col(value), *[(-F.col(a)).alias(f"m_{a}") for a in axes])).alias("p")
    return rows.groupBy(*by).agg(best, F.max(value).alias("high")).select(*by, *[F.col(f"p.{a}").alias(a) for a in axes], "high")


def centroid(rows: DataFrame, by: Sequence[str], value: str = "v", axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """The value-weighted centre of positive values."""
    v = F.col(value).cast("double")
    return rows.filter(v > 0).groupBy(*by).agg(*[(F.sum(v * F.col(a)) / F.sum(v)).alias(f"c{a}") for a in axes])


def gravity(rows: DataFrame, points: DataFrame, by: Sequence[str], reach: int, value: str = "v") -> DataFrame:
    """The value-weighted centre within reach of a point (px, py) of each image."""
    near = rows.join(points, list(by)).filter((F.abs(F.col("x") - F.col("px")) <= reach) & (F.abs(F.col("y") - F.col("py")) <= reach))
    return centroid(near, by, value)


def box(rows: DataFrame, by: Sequence[str], where: Column, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """First and last place on each axis where the condition holds."""
    return rows.filter(where).groupBy(*by).agg(*[f(a).alias(f"{a}{k}") for a in axes for f, k in ((F.min, 0), (F.max, 1))])


def crop(rows: DataFrame, by: Sequence[str], where: Column, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows inside the box of the condition, with coordinates from its corner; images where it never holds go."""
    inside = rows.join(box(rows, by, where, axes), list(by))
    for a in axes:
        inside = inside.filter(F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")))
    return inside.select(*[(F.col(c) - F.col(f"{c}0")).alias(c) if c in axes else F.col(c) for c in rows.columns])


# Projections


def region(rows: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """The sub-box from the first to before the second number on each axis, shifted to 0."""
    for a, (lo, hi) in ranges.items():
        rows = rows.filter((F.col(a) >= lo) & (F.col(a) < hi)).withColumn(a, F.col(a) - lo)
    return rows


def reflect(rows: DataFrame, **sizes: int) -> DataFrame:
    for a, n in sizes.items():
        rows = rows.withColumn(a, n - 1 - F.col(a))
    return rows


def flip(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Swap two axes."""
    return rows.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in rows.columns])


def frame(rows: DataFrame, t: int) -> DataFrame:
    return rows.filter(F.col("t") == t)


def arithmetic(a: Column, b: Column) -> dict[str, Column]:
    """Sum, difference, product and quotient; a quotient by 0 is 0."""
    return {"v_add": a + b, "v_sub": a - b, "v_mul": a * b, "v_div": F.when(b != 0, a / F.when(b != 0, b)).otherwise(0.0)}


def rescaled(rows: DataFrame, by: Sequence[str], low: float, high: float, value: str = "v") -> DataFrame:
    """Values mapped linearly so that each image spans low to high; a flat image becomes low."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    v = F.col(value).cast("double")
    span = F.nullif((F.col("_b") - F.col("_a")).cast("double"), F.lit(0.0))
    return rows.join(ends, list(by)).withColumn(value, F.coalesce((v - F.col("_a")) / span, F.lit(0.0)) * (high - low) + low).drop("_a", "_b")


def rescaled_to_max(rows: DataFrame, by: Sequence[str], high: float, value: str = "v") -> DataFrame:
    """Positive values scaled so that the highest is high."""
    ends = rows.groupBy(*by).agg(F.max(value).alias("_b"))
    v = F.col(value).cast("double")
    return rows.join(ends, list(by)).withColumn(value, F.when(v > 0, v * high / F.col("_b")).otherwise(v)).drop("_b")


def binned(rows: DataFrame, by: Sequence[str], most: int, value: str = "v") -> DataFrame:
    """Positive values over an integer bin width, the least that needs at most `most` bins, truncated."""
    ends = rows.groupBy(*by).agg(F.ceil((F.max(value) - F.min(value) + 1) / F.lit(most)).cast("int").alias("_w"), F.min(value).alias("_a"))
    return rows.join(ends, list(by)).withColumn("bin", F.when(F.col(value) >= 0, F.floor((F.col(value) - F.col("_a")) / F.col("_w")).cast("int")).otherwise(F.col(value))).drop("_w", "_a")


# Masks


def binary(value: Column, above: float = 0) -> Column:
    return (value > above).cast("int")


def clamp(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    value = value if low is None else F.greatest(value, low if isinstance(low, Column) else F.lit(low))
    return value if high is None else F.least(value, high if isinstance(high, Column) else F.lit(high))


def order_statistic(rows: DataFrame, by: Sequence[str], shares: dict[str, float], value: str = "v") -> DataFrame:
    """Elements round((n - 1) * share) of the ascending values.

    Counts by distinct value are cumulated, so an image of any size costs a window over its levels alone.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    up = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    level = counts.select(*by, value, F.sum("_n").over(up).alias("_up"), F.sum("_n").over(W.partitionBy(*by)).alias("_all"))
    return level.groupBy(*by).agg(*[F.min(F.when(F.col("_up") > F.round((F.col("_all") - 1) * F.lit(q)), F.col(value))).alias(name) for name, q in shares.items()])


def saturated(rows: DataFrame, by: Sequence[str], q0: float, q1: float, value: str = "v") -> DataFrame:
    ends = order_statistic(rows, by, {"_a": q0, "_b": q1}, value)
    return rows.join(ends, list(by)).withColumn(value, clamp(F.col(value), F.col("_a"), F.col("_b"))).drop("_a", "_b")


def masked(rows: DataFrame, mask: DataFrame, on: Sequence[str], value: str = "v", padding: float = PADDING) -> DataFrame:
    """Values where the mask (column m) is 0 or missing become padding."""
    return rows.join(mask, list(on), "left").withColumn(value, F.when(F.coalesce("m", F.lit(0)) == 0, F.lit(padding)).otherwise(F.col(value))).drop("m")


def overlap(stacks: DataFrame, on: Sequence[str], stack: str = "stack_id") -> DataFrame:
    """Places that lie inside every stack."""
    total = stacks.select(stack).distinct().agg(F.count("*").alias("_k"))
    seen = stacks.select(*on, stack).distinct().groupBy(*on).agg(F.count("*").alias("_n"))
    return seen.crossJoin(F.broadcast(total)).select(*on, (F.col("_n") == F.col("_k")).cast("int").alias("m"))  # one row


def padding_guess(rows: DataFrame, by: Sequence[str], corners: Column, value: str = "v") -> DataFrame:
    """The value of all corners where they agree, else null."""
    return rows.filter(corners).groupBy(*by).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias("padding"))


def small(rows: DataFrame, key: str, share: float = 0.1, where: Column | None = None) -> DataFrame:
    """Groups with their counts, and whether they hold less than share of the upper median count."""
    n = F.count("*") if where is None else F.count_if(where)
    counts = rows.groupBy(key).agg(n.alias("n"))
    median = order_statistic(counts.withColumn("_one", F.lit(1)), ["_one"], {"median": 0.5}, "n")
    return counts.crossJoin(F.broadcast(median.select("median"))).select(key, "n", (F.col("n") < share * F.col("median")).alias("small"))  # one row


# Splits of a stack into packages


def package(z: Column, packages: int) -> tuple[Column, Column]:
    """Package of a slice and its place in it."""
    return z % packages, F.floor(z / packages).cast("int")


def even_odd(z: Column, packages: int) -> tuple[Column, Column]:
    """Packages split once more into even and odd places: the package of twice as many, and the place."""
    p, k = package(z, packages)
    return p * 2 + k % 2, F.floor(k / 2).cast("int")


def half_path(z: Column, n: Column, least: int = 4) -> Column:
    """Path of a slice, as letters, through repeated halving of stacks of at least `least` slices."""

    def cut(s: Column, _: Column) -> Column:
        half = F.floor(s["size"] / 2).cast("int")
        low = z - s["start"] < half
        deeper = F.struct(
            F.when(low, s["start"]).otherwise(s["start"] + half).alias("start"), F.when(low, half).otherwise(s["size"] - half).alias("size"), F.concat(s["path"], F.when(low, F.lit("a")).otherwise(F.lit("b"))).alias("path")
        )
        return F.when(s["size"] >= least, deeper).otherwise(s)

    # No stack has so many slices that it halves oftener than the bits of its length.
    whole = F.struct(F.lit(0).alias("start"), n.cast("int").alias("size"), F.lit("").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n)).cast("int") + 1), whole, cut)["path"]


def with_number(a: Column, b: float) -> dict[str, Column]:
    """Sum, difference, product and quotient with a number; division by 0 leaves the image."""
    return {"v_add": a + b, "v_sub": a - b, "v_mul": a * b, "v_div": a / F.lit(float(b)) if b else a.cast("double")}


def rasterised(spark: SparkSession, sizes: tuple[int, int, int], f, spacing: float = 1.0) -> DataFrame:
    """x, y, z and v = f of the world's coordinates, the lattice's centre at 0; no cross join, places come from their number."""
    nx, ny, nz = sizes
    k = F.col("id")
    at = {"x": (k % nx).cast("int"), "y": (F.floor(k / nx) % ny).cast("int"), "z": F.floor(k / (nx * ny)).cast("int")}
    rows = spark.range(nx * ny * nz).select(*[c.alias(a) for a, c in at.items()])
    return rows.select("x", "y", "z", f(*[(F.col(a) - (n - 1) / 2) * spacing for a, n in zip("xyz", sizes)]).alias("v"))


def padding_runs(pixels: str, padding: int = -1) -> Column:
    """pixels with padding as minus the number of padding pixels from there to the run's end."""
    back = F.aggregate(
        F.reverse(pixels),
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("run")),
        lambda s, p: F.struct(F.concat(s["out"], F.array(F.when(p == padding, -(s["run"] + 1)).otherwise(p))).alias("out"), F.when(p == padding, s["run"] + 1).otherwise(0).alias("run")),
    )
    return F.reverse(back["out"])

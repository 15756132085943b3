"""Text files of results: logs of evaluations by run, and histograms of one or two axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: An axis: its column, number of bins and range.
Axis = tuple[str, int, float, float]


def logged(rows: DataFrame, path: str, **run: int | str) -> None:
    """Rows added to a folder of comma-separated files under the columns of a run (stack, iteration, size, ...).

    Other runs' rows stay. A run that is logged again, as after a lost driver,
    takes the place of its own rows; with no row at all nothing is changed.
    """
    out = rows.select(*[F.lit(v).alias(k) for k, v in run.items()], *rows.columns)
    out.write.option("header", True).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*run).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All runs of a log; the schema names the rows' columns and then the runs'."""
    return spark.read.option("header", True).schema(schema).csv(path)


def histogram_text(hist: DataFrame, key: str, axes: Sequence[Axis], word: str, count: str = "n") -> DataFrame:
    """key and text: a line with the format's word; a line with numbers of bins, the sum, ranges and widths; then a line of counts for each bin of the last axis (one axis: a line a bin).

    Bins that hist lacks are 0; the counts may be weights. Bins outside are left out.
    """
    (x, nx, *_), *rest = axes
    if len(rest) > 1:
        raise ValueError("one or two axes")
    ny = rest[0][1] if rest else 1
    place = (F.col(rest[0][0]) * nx if rest else F.lit(0)) + F.col(x)
    inside = F.col(x).between(0, nx - 1) & (F.col(rest[0][0]).between(0, ny - 1) if rest else F.lit(True))
    cells = hist.filter(inside).groupBy(key, place.cast("int").alias("_at")).agg(F.sum(F.col(count).cast("double")).alias("_n"))
    held = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_n"))).alias("_m"), F.sum("_n").alias("_sum"))  # bins of one histogram
    value = lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)).cast("string")
    if rest:
        lines = F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda j: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda i: value(j * nx + i)), " "))
    else:
        lines = F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), value)
    head = F.concat_ws(" ", *[F.lit(str(a[1])) for a in axes], F.col("_sum").cast("string"), *[F.lit(repr(float(v))) for a in axes for v in a[2:]], *[F.lit(repr((a[3] - a[2]) / a[1])) for a in axes])
    return held.select(key, F.concat(F.lit(word + "\n"), head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def histogram_cells(texts: DataFrame, axes: int, word: str, text: str = "text") -> DataFrame:
    """The other columns with i (and j), n and the centre of the bin on each axis (x, y), for every cell of a file that isn't 0. A text of another format raises."""
    keep = [c for c in texts.columns if c != text]
    t = F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), 1)
    held = texts.withColumn("_t", F.when(F.get(t, F.lit(0)) == word, t).otherwise(F.raise_error(F.concat(F.lit(f"not a file of {word}: "), F.substring(text, 1, 40)))))
    number = lambda k: F.get("_t", F.lit(k)).cast("double")
    nx = number(1).cast("int")
    first = 2 + 4 * axes  # word, bins, sum, ranges, widths
    cells = held.select(*keep, nx.alias("_nx"), *[f.alias(n) for a in range(axes) for n, f in ((f"_low{a}", number(2 + axes + 2 * a)), (f"_width{a}", number(2 + 3 * axes + a)))], F.posexplode(F.slice("_t", first + 1, F.size("_t"))).alias("_at", "_v"))
    cells = cells.withColumn("n", F.col("_v").cast("double")).filter("n <> 0").withColumn("i", F.col("_at") % F.col("_nx")).withColumn("j", F.floor(F.col("_at") / F.col("_nx")).cast("int"))
    centre = lambda c, a: F.col(f"_low{a}") + (F.col(c) + 0.5) * F.col(f"_width{a}")
    return cells.select(*keep, "i", *(["j"] if axes > 1 else []), "n", centre("i", 0).alias("x"), *([centre("j", 1).alias("y")] if axes > 1 else []))


def save_texts(texts: DataFrame, path: str, key: str) -> None:
    """A file for each key, in a folder named by it."""
    texts.repartition(key).write.partitionBy(key).text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """key and text of saved files, each read whole."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")

"""Queries over the supplied tables for the image operators, and their SQL oracles.

Every query runs over all slices. PX and the views after it are the oracles'
own definitions of the pixel views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridloom.functions import coords, scalars
from gridloom.operators import histograms as hist, images as im, kernels, patches, projection as pj, robust, stencils
from gridloom.registry import ORACLES, PX, PX3, QUERIES, R, query, rounded
from gridloom.scratch import Scratch
from gridloom.sources import surrogate as sg

LOW, HIGH, BINS = 0.0, 1000.0, 20
SIZES = {"x": sg.SIDE, "y": sg.SIDE}


PAIRS = f"""{PX}, fst AS (SELECT stack_id, min(slice_id) AS f FROM px GROUP BY 1),
  pairs AS (SELECT q.slice_id, q.stack_id, q.x, q.y, p.v AS a, q.v AS b FROM px q JOIN fst USING (stack_id) JOIN px p ON p.slice_id = f AND p.x = q.x AND p.y = q.y)"""
BIN = lambda c: f"greatest(0, least(19, CAST(round(20 * ({c} - 25.0) / 1000.0) AS INT)))"


def pair_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slice with its stack's first, as one array of pairs (a: first, b: own); joined as images, a row a stack on one side."""
    images = sg.blocks(spark, sf_dir)
    first = images.groupBy("stack_id").agg(F.min_by("pixels", "slice_id").alias("first"))
    return images.join(first, "stack_id").select("slice_id", "stack_id", F.arrays_zip(F.col("first").alias("a"), F.col("pixels").alias("b")).alias("pixels"))


def pair_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each slice (b) with those of its stack's first slice (a)."""
    long = sg.explode_pixels(pair_blocks(spark, sf_dir), value="p")
    return long.select("slice_id", "stack_id", "x", "y", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.joint(pair_pixels(spark, sf_dir), ["slice_id"], "a", "b", LOW, HIGH, BINS)


JOINT = f"{PAIRS}, jh AS (SELECT slice_id, {BIN('a')} AS i, {BIN('b')} AS j, count(*) AS n FROM pairs WHERE a BETWEEN 0 AND 1000 AND b BETWEEN 0 AND 1000 GROUP BY ALL)"


# Histograms and metrics


@query(f"""WITH {JOINT},
t AS (SELECT slice_id, sum(n)::DOUBLE AS t FROM jh GROUP BY 1),
mx AS (SELECT slice_id, i, sum(n)::DOUBLE AS n, sum(n * (j * 50 + 25.0)) / sum(n) AS e FROM jh GROUP BY 1, 2),
my AS (SELECT slice_id, j, sum(n)::DOUBLE AS n, sum(n * (i * 50 + 25.0)) / sum(n) AS e FROM jh GROUP BY 1, 2),
hx AS (SELECT slice_id, -sum(n / t * ln(n / t)) AS hx, sum(n / t * (i * 50 + 25.0)) AS ex, sum(n / t * (i * 50 + 25.0) ** 2) AS exx, sum(n / t * e * e) AS cy FROM mx JOIN t USING (slice_id) GROUP BY 1),
hy AS (SELECT slice_id, -sum(n / t * ln(n / t)) AS hy, sum(n / t * (j * 50 + 25.0)) AS ey, sum(n / t * (j * 50 + 25.0) ** 2) AS eyy, sum(n / t * e * e) AS cx FROM my JOIN t USING (slice_id) GROUP BY 1),
k AS (SELECT mx.slice_id, sum(mx.n * my.n / (t * t)) AS ch FROM mx JOIN my ON mx.slice_id = my.slice_id AND i = j JOIN t ON t.slice_id = mx.slice_id GROUP BY 1),
h AS (SELECT slice_id, -sum(n / t * ln(n / t)) AS hxy, sum(n * (i * 50 + 25.0) * (j * 50 + 25.0)) / max(t) AS exy, sum(n * ((i - j) * 50.0) ** 2) AS ssd, sum(CASE WHEN i = j THEN n ELSE 0 END) / max(t) AS lc, max(t) AS t FROM jh JOIN t USING (slice_id) GROUP BY 1)
SELECT slice_id, t::BIGINT AS samples, {R('hxy', 'joint_entropy')}, {R('hx + hy - hxy', 'mi')}, {R('(hx + hy) / hxy', 'nmi')},
  {R('abs(exy - ex * ey) / (sqrt(exx - ex * ex) * sqrt(eyy - ey * ey))', 'cross_correlation')}, {R('exy - ex * ey', 'covariance')},
  {R('(cx - ex * ex) / (exx - ex * ex)', 'correlation_ratio_xy')}, {R('(cy - ey * ey) / (eyy - ey * ey)', 'correlation_ratio_yx')},
  {R('ssd', 'ssd')}, {R('lc', 'label_consistency')}, {R('(lc - coalesce(ch, 0)) / (1 - coalesce(ch, 0))', 'kappa')},
  {R('ex', 'mean_x')}, {R('ey', 'mean_y')}, {R('exx - ex * ex', 'variance_x')}, {R('eyy - ey * ey', 'variance_y')}, {R('hx', 'entropy_x')}, {R('hy', 'entropy_y')}
FROM h JOIN hx USING (slice_id) JOIN hy USING (slice_id) LEFT JOIN k USING (slice_id)""")
def joint_metrics(spark, sf_dir):
    """Every joint-histogram metric of each slice against its stack's first."""
    return rounded(hist.metrics(pair_histogram(spark, sf_dir), ["slice_id"], LOW, HIGH, BINS))


@query(f"WITH {JOINT} SELECT slice_id, i, j, n, round(ln(n / sum(n) OVER (PARTITION BY slice_id)), 6) + 0.0 AS log_p FROM jh")
def joint_histogram(spark, sf_dir):
    h = pair_histogram(spark, sf_dir)
    return rounded(h.select("slice_id", "i", "j", "n", F.log(F.col("n") / F.sum("n").over(W.partitionBy("slice_id"))).alias("log_p")))


@query(f"""WITH {JOINT} SELECT slice_id, 'x' AS axis, i, NULL::INT AS j, sum(n)::BIGINT AS n FROM jh GROUP BY 1, i
UNION ALL SELECT slice_id, 'y', NULL, j, sum(n)::BIGINT FROM jh GROUP BY 1, j UNION ALL SELECT slice_id, 'xy', i, j, sum(n)::BIGINT FROM jh GROUP BY 1, i, j""")
def marginal_histograms(spark, sf_dir):
    return hist.marginals(pair_histogram(spark, sf_dir), ["slice_id"])


@query(f"""WITH {JOINT} SELECT slice_id, i, {R('sum(n * (j * 50 + 25.0)) / sum(n)', 'mean_y')} FROM jh GROUP BY 1, 2""")
def conditional_means(spark, sf_dir):
    c = hist.centre(F.col("j"), LOW, HIGH, BINS)
    return rounded(pair_histogram(spark, sf_dir).groupBy("slice_id", "i").agg((F.sum(F.col("n") * c) / F.sum("n")).alias("mean_y")))


@query(f"""WITH {JOINT}, s AS (SELECT slice_id, i + k AS i, j, n * w AS n FROM jh, (VALUES (-1, 1/6.0::DOUBLE), (0, 2/3.0::DOUBLE), (1, 1/6.0::DOUBLE)) t(k, w) WHERE i + k BETWEEN 0 AND 19),
u AS (SELECT slice_id, i, j + k AS j, n * w AS n FROM s, (VALUES (-1, 1/6.0::DOUBLE), (0, 2/3.0::DOUBLE), (1, 1/6.0::DOUBLE)) t(k, w) WHERE j + k BETWEEN 0 AND 19)
SELECT slice_id, i, j, {R('sum(n)', 'n')} FROM u GROUP BY 1, 2, 3""")
def smoothed_joint_histogram(spark, sf_dir):
    h = hist.smooth(pair_histogram(spark, sf_dir), ["slice_id"], BINS, "i")
    return rounded(hist.smooth(h, ["slice_id"], BINS, "j")).select("slice_id", "i", "j", "n")


HIST1 = f"{PX}, h AS (SELECT stack_id, {BIN('v')} AS bin, count(*) AS n FROM px WHERE v BETWEEN 0 AND 1000 GROUP BY ALL)"


@query(f"WITH {HIST1} SELECT * FROM h")
def histogram1d(spark, sf_dir):
    return hist.histogram(sg.px(spark, sf_dir), ["stack_id"], "v", LOW, HIGH, BINS)


@query(f"""WITH {HIST1}, t AS (SELECT stack_id, n::DOUBLE AS n, bin * 50 + 25.0 AS c, sum(n) OVER (PARTITION BY stack_id)::DOUBLE AS t FROM h)
SELECT stack_id, {R('sum(n * c) / max(t)', 'mean')}, {R('sum(n * c * c) / max(t) - (sum(n * c) / max(t)) ** 2', 'variance')},
 {R('sqrt(sum(n * c * c) / max(t) - (sum(n * c) / max(t)) ** 2)', 'sd')}, {R('-sum(n / t * ln(n / t))', 'entropy')} FROM t GROUP BY 1""")
def histogram_moments(spark, sf_dir):
    return rounded(hist.moments(histogram1d(spark, sf_dir), ["stack_id"], LOW, HIGH, BINS))


@query(f"""WITH {PX}, h AS (SELECT stack_id, {BIN('v')} AS bin, sum(v)::DOUBLE AS n FROM px WHERE v BETWEEN 0 AND 1000 GROUP BY ALL),
t AS (SELECT stack_id, n, bin * 50 + 25.0 AS c, sum(n) OVER (PARTITION BY stack_id) AS t FROM h)
SELECT stack_id, {R('sum(n * c) / max(t)', 'mean')}, {R('sum(n * c * c) / max(t) - (sum(n * c) / max(t)) ** 2', 'variance')},
 {R('sqrt(sum(n * c * c) / max(t) - (sum(n * c) / max(t)) ** 2)', 'sd')}, {R('-sum(n / t * ln(n / t))', 'entropy')} FROM t GROUP BY 1""")
def density_moments(spark, sf_dir):
    h = hist.histogram(sg.px(spark, sf_dir), ["stack_id"], "v", LOW, HIGH, BINS, weight="v")
    return rounded(hist.moments(h, ["stack_id"], LOW, HIGH, BINS))


@query(f"""WITH {HIST1}, r AS (SELECT stack_id, bin, sum(n) OVER (PARTITION BY stack_id ORDER BY bin) AS up, sum(n) OVER (PARTITION BY stack_id) AS t FROM h)
SELECT stack_id, min(bin) AS bin, {R('min(bin) * 50 + 25.0', 'value')} FROM r WHERE up >= 0.75::DOUBLE * t GROUP BY 1""")
def cdf_quantile(spark, sf_dir):
    return rounded(hist.cdf_value(histogram1d(spark, sf_dir), ["stack_id"], 0.75, LOW, HIGH, BINS))


@query(f"""WITH {HIST1}, r AS (SELECT stack_id, bin, sum(n) OVER (PARTITION BY stack_id ORDER BY bin) / sum(n) OVER (PARTITION BY stack_id) AS share FROM h)
SELECT slice_id, x, y, {R('share * 1000', 'v_eq')} FROM px JOIN r ON r.stack_id = px.stack_id AND bin = {BIN('v')}""")
def histogram_equalise(spark, sf_dir):
    return rounded(hist.equalised(sg.px(spark, sf_dir), ["stack_id"], "v", LOW, HIGH, BINS).select("slice_id", "x", "y", "v_eq"))


@query(f"""WITH {HIST1} SELECT stack_id, bin + k AS bin, {R('sum(n * w)', 'n')} FROM h, (VALUES (-1, 1/6.0::DOUBLE), (0, 2/3.0::DOUBLE), (1, 1/6.0::DOUBLE)) t(k, w) WHERE bin + k BETWEEN 0 AND 19 GROUP BY 1, 2""")
def histogram_smooth(spark, sf_dir):
    return rounded(hist.smooth(histogram1d(spark, sf_dir), ["stack_id"], BINS)).select("stack_id", "bin", "n")


@query(f"WITH {PAIRS} SELECT slice_id, {R('corr(a, b)', 'ncc')}, {R('-avg((a - b) * (a - b))', 'ssd')}, {R('avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)', 'same')} FROM pairs GROUP BY 1")
def streaming_metrics(spark, sf_dir):
    return rounded(hist.streaming_metrics(pair_pixels(spark, sf_dir), ["slice_id"], "a", "b"))


@query(f"""WITH {PX} SELECT p.stack_id, p.slice_id AS a, q.slice_id AS b, {R('corr(p.v, q.v)', 'ncc')}, {R('-avg((p.v - q.v) ** 2)', 'ssd')}
FROM px p JOIN px q ON p.stack_id = q.stack_id AND p.slice_id < q.slice_id AND p.x = q.x AND p.y = q.y GROUP BY 1, 2, 3""")
def similarity_pairwise(spark, sf_dir):
    """Correlation and squared difference of all slice pairs of a stack, from products of blocks of slices."""
    images = sg.blocks(spark, sf_dir)
    return rounded(hist.pairs_once(images, ["stack_id"]))


@query(f"""WITH {PX}, d AS (SELECT p.slice_id AS a, q.slice_id AS b, sqrt(sum((p.v - q.v) ** 2)) AS d FROM px p JOIN px q ON p.stack_id = q.stack_id AND p.slice_id <> q.slice_id AND p.x = q.x AND p.y = q.y GROUP BY 1, 2)
SELECT a AS slice_id, CAST(k AS INT) AS k, b AS neighbour, {R('d', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d) WHERE k <= 5""")
def knn_slices(spark, sf_dir):
    """The five nearest slices of the stack; the nearest few are kept of each meeting of blocks."""
    return rounded(hist.nearest(sg.blocks(spark, sf_dir), ["stack_id"], 5))


# Statistics, projections, masks


@query(f"""WITH {PX} SELECT stack_id, min(v) AS low, max(v) AS high, min(v) FILTER (v > 480) AS low_pad, max(v) FILTER (v > 480) AS high_pad,
 {R('avg(v) FILTER (v > 0)', 'mean_positive')}, {R('avg(v)', 'mean_all')}, {R('stddev_pop(v)', 'sd')} FROM px GROUP BY 1""")
def image_statistics(spark, sf_dir):
    return rounded(im.statistics(sg.px(spark, sf_dir), ["stack_id"], padding=480))


@query(f"WITH {PX} SELECT slice_id, y, x, v AS high FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY v DESC, y, x) AS k FROM px) WHERE k = 1")
def max_position(spark, sf_dir):
    return im.peak(sg.px(spark, sf_dir), ["slice_id"])


@query(f"WITH {PX} SELECT slice_id, {R('sum(v * x) / sum(v)', 'cx')}, {R('sum(v * y) / sum(v)', 'cy')} FROM px WHERE v > 0 GROUP BY 1")
def centroid_by_slice(spark, sf_dir):
    return rounded(im.centroid(sg.px(spark, sf_dir), ["slice_id"]))


@query(f"""WITH {PX}, m AS (SELECT slice_id, x AS px, y AS py FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY v DESC, y, x) AS k FROM px) WHERE k = 1)
SELECT slice_id, {R('sum(v * x) / sum(v)', 'cx')}, {R('sum(v * y) / sum(v)', 'cy')} FROM px JOIN m USING (slice_id) WHERE abs(x - px) <= 2 AND abs(y - py) <= 2 AND v > 0 GROUP BY 1""")
def gravity_centre(spark, sf_dir):
    rows = sg.px(spark, sf_dir)
    peak = im.peak(rows, ["slice_id"]).select("slice_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return rounded(im.gravity(rows, peak, ["slice_id"], 2))


@query(f"""WITH {PX}, b AS (SELECT slice_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px WHERE v > 540 GROUP BY 1)
SELECT slice_id, stack_id, x - x0 AS x, y - y0 AS y, v FROM px JOIN b USING (slice_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def bbox_crop(spark, sf_dir):
    return im.crop(sg.px(spark, sf_dir), ["slice_id"], F.col("v") > 540)


@query(f"""WITH {PX}, o AS (SELECT slice_id, v, row_number() OVER (PARTITION BY slice_id ORDER BY v) - 1 AS k FROM px),
q AS (SELECT slice_id, max(v) FILTER (k = round(63 * 0.1::DOUBLE)) AS lo, max(v) FILTER (k = round(63 * 0.9::DOUBLE)) AS hi FROM o GROUP BY 1)
SELECT slice_id, stack_id, x, y, greatest(lo, least(hi, v)) AS v FROM px JOIN q USING (slice_id)""")
def quantile_saturate(spark, sf_dir):
    return im.saturated(sg.px(spark, sf_dir), ["slice_id"], 0.1, 0.9)


@query(f"""WITH {PAIRS} SELECT slice_id, x, y, a + b AS v_add, a - b AS v_sub, a * b AS v_mul, {R('CASE WHEN b - 500 <> 0 THEN a / (b - 500) ELSE 0 END', 'v_div')} FROM pairs""")
def voxel_arithmetic(spark, sf_dir):
    rows = pair_pixels(spark, sf_dir)
    made = im.arithmetic(F.col("a"), F.col("b"))
    made["v_div"] = im.arithmetic(F.col("a"), F.col("b") - 500)["v_div"]
    return rounded(rows.select("slice_id", "x", "y", *[c.alias(n) for n, c in made.items()]))


@query(f"""WITH {PX}, m AS (SELECT slice_id, min(v) AS a, max(v) AS b FROM px GROUP BY 1)
SELECT slice_id, x, y, {R('(v - a) / (b - a)::DOUBLE * 255', 'v')} FROM px JOIN m USING (slice_id)""")
def intensity_rescale(spark, sf_dir):
    return rounded(im.rescaled(sg.px(spark, sf_dir), ["slice_id"], 0.0, 255.0).select("slice_id", "x", "y", "v"))


@query(f"WITH {PX} SELECT slice_id, x, y, {R('CASE WHEN v > 0 THEN v * 1000.0::DOUBLE / max(v) OVER (PARTITION BY slice_id) ELSE v END', 'v')} FROM px")
def rescale_to_max(spark, sf_dir):
    return rounded(im.rescaled_to_max(sg.px(spark, sf_dir), ["slice_id"], 1000.0).select("slice_id", "x", "y", "v"))


@query(f"""WITH {PX}, m AS (SELECT stack_id, CAST(ceil((max(v) - min(v) + 1) / 16.0) AS INT) AS w, min(v) AS a FROM px GROUP BY 1)
SELECT slice_id, x, y, (v - a) // w AS bin FROM px JOIN m USING (stack_id)""")
def bin_rescale(spark, sf_dir):
    return im.binned(sg.px(spark, sf_dir), ["stack_id"], 16).select("slice_id", "x", "y", "bin")


@query(f"WITH {PX} SELECT slice_id, stack_id, 7 - x AS y, y AS x, v FROM px WHERE x >= 2 AND x < 6")
def reflect_flip_region(spark, sf_dir):
    """A region along x, mirrored, then with axes swapped and moved back to where it was."""
    cut = im.region(sg.px(spark, sf_dir), x=(2, 6))
    return im.flip(im.reflect(cut, x=4), "x", "y").withColumn("y", F.col("y") + 2)


@query(f"WITH {PX} SELECT slice_id, x, y, CAST(v > 500 AS INT) AS m, CAST(v <> 500 AS INT) AS other, least(550, greatest(450, v)) AS capped FROM px")
def mask_threshold_clamp(spark, sf_dir):
    v = F.col("v")
    return sg.px(spark, sf_dir).select("slice_id", "x", "y", im.binary(v, 500).alias("m"), (v != 500).cast("int").alias("other"), im.clamp(v, 450, 550).alias("capped"))


@query(f"WITH {PX} SELECT x, y, CAST(count(DISTINCT stack_id) FILTER (v > 650) = (SELECT count(DISTINCT stack_id) FROM px WHERE v > 650) AS INT) AS m FROM px WHERE v > 650 GROUP BY 1, 2")
def mask_overlap(spark, sf_dir):
    return im.overlap(sg.px(spark, sf_dir).filter("v > 650"), ["x", "y"])


@query(f"""WITH {PAIRS} SELECT slice_id, x, y, CASE WHEN a > 500 THEN b ELSE -1 END AS v FROM pairs""")
def masked_image(spark, sf_dir):
    pairs = pair_pixels(spark, sf_dir)
    mask = pairs.groupBy("stack_id", "x", "y").agg(F.max(im.binary(F.col("a"), 500)).alias("m"))
    rows = pairs.select("stack_id", "slice_id", "x", "y", F.col("b").alias("v"))
    return im.masked(rows, mask, ["stack_id", "x", "y"]).select("slice_id", "x", "y", "v")


@query(f"""WITH {PX} SELECT slice_id, CASE WHEN min(v // 50) = max(v // 50) THEN min(v // 50) END AS padding FROM px WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY 1""")
def padding_guess(spark, sf_dir):
    rows = sg.px(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 50).cast("int"))
    return im.padding_guess(rows, ["slice_id"], F.col("x").isin(0, 7) & F.col("y").isin(0, 7))


@query(f"""WITH {PX}, c AS (SELECT slice_id, count(*) FILTER (v > 560) AS n FROM px GROUP BY 1),
m AS (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS t FROM c) WHERE k = round((t - 1) * 0.5::DOUBLE))
SELECT slice_id, c.n, c.n < 0.1::DOUBLE * m.n AS small FROM c, m""")
def small_overlap(spark, sf_dir):
    return im.small(sg.px(spark, sf_dir), "slice_id", where=F.col("v") > 560)


@query(f"WITH {PX} SELECT stack_id, x, y, {R('avg(v)', 'mean')}, count(*)::BIGINT AS n FROM px WHERE v <> 0 GROUP BY 1, 2, 3")
def template_average(spark, sf_dir):
    return rounded(sg.px(spark, sf_dir).filter("v <> 0").groupBy("stack_id", "x", "y").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count("*").alias("n")))


@query(f"""WITH {PX}, f AS (SELECT stack_id, 500.0::DOUBLE / avg(v) AS factor FROM px WHERE v > 0 GROUP BY 1)
SELECT slice_id, x, y, {R('CASE WHEN v > 0 THEN v * factor ELSE v END', 'v')}, {R('factor', 'factor')} FROM px JOIN f USING (stack_id)""")
def stack_intensity_match(spark, sf_dir):
    rows = sg.px(spark, sf_dir)
    f = rows.filter("v > 0").groupBy("stack_id").agg((F.lit(500.0) / F.avg(F.col("v").cast("double"))).alias("factor"))
    v = F.col("v").cast("double")
    return rounded(rows.join(f, "stack_id").select("slice_id", "x", "y", F.when(v > 0, v * F.col("factor")).otherwise(v).alias("v"), "factor"))


@query(f"""WITH {PX}, o AS (SELECT stack_id, [quantile_cont(v::DOUBLE, k / 10.0::DOUBLE) FOR k IN [0]] AS z FROM px GROUP BY 1),
l AS (SELECT stack_id, k, quantile_cont(v::DOUBLE, 0.0) AS q FROM px, range(1) t(k) GROUP BY 1, 2),
m AS (SELECT stack_id, quantile_cont(v::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS own FROM px GROUP BY 1),
r AS (SELECT own AS ref FROM m ORDER BY stack_id LIMIT 1),
j AS (SELECT slice_id, x, y, v::DOUBLE AS v, own, ref, greatest(1, least(10, len(list_filter(own, lambda q: q <= v)))) AS k FROM px JOIN m USING (stack_id), r)
SELECT slice_id, x, y, {R('CASE WHEN own[k + 1] > own[k] THEN ref[k] + (v - own[k]) * (ref[k + 1] - ref[k]) / (own[k + 1] - own[k]) ELSE ref[k] END', 'v_matched')} FROM j""".replace(
    "o AS (SELECT stack_id, [quantile_cont(v::DOUBLE, k / 10.0::DOUBLE) FOR k IN [0]] AS z FROM px GROUP BY 1),\nl AS (SELECT stack_id, k, quantile_cont(v::DOUBLE, 0.0) AS q FROM px, range(1) t(k) GROUP BY 1, 2),\n", ""))
def histogram_match(spark, sf_dir):
    """Every stack mapped onto the first by eleven landmarks."""
    rows = sg.px(spark, sf_dir)
    shares = [k / 10 for k in range(11)]
    marks = rows.groupBy("stack_id").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("landmarks"))
    return rounded(hist.matched(rows, "stack_id", "v", marks.orderBy("stack_id").limit(1), shares).select("slice_id", "x", "y", "v_matched"))


@query(f"WITH {PX3}, k AS (SELECT slice_id, stack_id, z, count(*) OVER (PARTITION BY stack_id, z) AS c, count(*) OVER (PARTITION BY stack_id) AS n FROM (SELECT DISTINCT slice_id, stack_id, z FROM px3)) SELECT slice_id, z, z % 3 AS pkg, z // 3 AS at, (z % 3) * 2 + (z // 3) % 2 AS pkg2, z // 6 AS at2, CAST(z < n // 2 AS INT) AS low FROM k")
def package_split(spark, sf_dir):
    z = F.col("z")
    (p, a), (q, b) = im.package(z, 3), im.even_odd(z, 3)
    n = F.count("*").over(W.partitionBy("stack_id"))
    half = F.substring(im.half_path(z, n), 1, 1)
    return sg.ranked(sg.blocks(spark, sf_dir)).select("slice_id", "z", p.alias("pkg"), a.alias("at"), q.alias("pkg2"), b.alias("at2"), (half == "a").cast("int").alias("low"))


# Stencils


KERNEL = scalars.gaussian_kernel(1.0)
KERNEL_SQL = "(VALUES " + ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in KERNEL) + ") g(k, w)"


def _made(spark: SparkSession, sf_dir: str, pixels: Column, *keep: str) -> DataFrame:
    """Pixels of an expression over each slice's array."""
    return sg.explode_pixels(sg.blocks(spark, sf_dir).select("slice_id", *keep, "pixels").withColumn("pixels", pixels))


@query(f"""WITH {PX}, bx AS (SELECT slice_id, x - k AS x, y, sum(v * w) / sum(w) AS v FROM px, {KERNEL_SQL} WHERE x - k BETWEEN 0 AND 7 GROUP BY slice_id, x - k, y)
SELECT slice_id, x, y - k AS y, {R('sum(v * w) / sum(w)', 'v')} FROM bx, {KERNEL_SQL} WHERE y - k BETWEEN 0 AND 7 GROUP BY slice_id, x, y - k""")
def gauss_blur(spark, sf_dir):
    return rounded(sg.explode_pixels(stencils.block_separable(sg.blocks(spark, sf_dir).select("slice_id", "pixels"), KERNEL, 8, 8)))


@query(f"""WITH {PX}, o AS (SELECT px.slice_id, px.x, px.y, px.v, sum(q.v * w) / sum(w) AS s FROM px JOIN (SELECT * FROM px, (VALUES (-1, 1.0::DOUBLE), (0, 2.0::DOUBLE), (1, 1.0::DOUBLE)) g(k, w)) q
  ON q.slice_id = px.slice_id AND q.y = px.y AND q.x = px.x + k AND q.v > 480 WHERE px.v > 480 GROUP BY ALL)
SELECT px.slice_id, px.x, px.y, {R('coalesce(s, px.v)', 'v')} FROM px LEFT JOIN o USING (slice_id, x, y)""")
def convolution_with_padding(spark, sf_dir):
    made = stencils.block_convolved("pixels", [(-1, 0, 1.0), (0, 0, 2.0), (1, 0, 1.0)], 8, 8, padding=480)
    return rounded(_made(spark, sf_dir, made))


@query(f"""WITH {PX}, g AS (SELECT slice_id, x, y, coalesce(lead(v) OVER (PARTITION BY slice_id, y ORDER BY x) - lag(v) OVER (PARTITION BY slice_id, y ORDER BY x), 0)::DOUBLE AS gx,
 coalesce(lead(v) OVER (PARTITION BY slice_id, x ORDER BY y) - lag(v) OVER (PARTITION BY slice_id, x ORDER BY y), 0)::DOUBLE AS gy FROM px)
SELECT slice_id, x, y, gx, gy, {R('sqrt(gx * gx + gy * gy)', 'magnitude')} FROM g""")
def gradient_magnitude(spark, sf_dir):
    return rounded(_made(spark, sf_dir, stencils.block_gradients("pixels", 8, 8)).select("slice_id", "x", "y", "v.*"))


def _morph(f: str) -> str:
    return f"""WITH {PX} SELECT p.slice_id, p.x, p.y, CASE WHEN p.x IN (0, 7) OR p.y IN (0, 7) THEN max(p.v) ELSE {f}(q.v) END AS v
FROM px p JOIN px q ON p.slice_id = q.slice_id AND abs(p.x - q.x) + abs(p.y - q.y) <= 1 GROUP BY p.slice_id, p.x, p.y"""


@query(_morph("max"))
def dilate(spark, sf_dir):
    return _made(spark, sf_dir, stencils.block_morphology("pixels", 8, 8, 4, True))


@query(_morph("min"))
def erode(spark, sf_dir):
    return _made(spark, sf_dir, stencils.block_morphology("pixels", 8, 8, 4, False))


@query(f"""WITH {PX} SELECT p.slice_id, p.stack_id, p.x, p.y, CASE WHEN p.x IN (0, 7) OR p.y IN (0, 7) THEN max(p.v) ELSE list_sort(list(q.v))[5] END AS v
FROM px p JOIN px q ON p.slice_id = q.slice_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.slice_id, p.stack_id, p.x, p.y""")
def median3(spark, sf_dir):
    return _made(spark, sf_dir, stencils.block_rank("pixels", 8, 8), "stack_id").select("slice_id", "stack_id", "x", "y", "v")


@query(f"""WITH {PX}, l AS (SELECT slice_id, x, y, v // 50 AS v FROM px), c AS (SELECT p.slice_id, p.x, p.y, p.v AS own, q.v, count(*) AS n FROM l p JOIN l q ON p.slice_id = q.slice_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY ALL)
SELECT slice_id, x, y, CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN own ELSE v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, x, y ORDER BY n DESC, v) AS k FROM c) WHERE k = 1""")
def mode3(spark, sf_dir):
    labels = sg.blocks(spark, sf_dir).select("slice_id", F.transform("pixels", lambda v: F.floor(v / 50).cast("int")).alias("pixels"))
    return sg.explode_pixels(labels.withColumn("pixels", stencils.block_rank("pixels", 8, 8, mode=True)))


@query(f"""WITH {PAIRS}, s AS (SELECT p.slice_id, p.x, p.y, avg(q.a) AS ma, avg(q.b) AS mb, avg(q.a * q.a) AS aa, avg(q.b * q.b) AS bb, avg(q.a * q.b) AS ab
 FROM pairs p JOIN pairs q ON p.slice_id = q.slice_id AND q.x - p.x BETWEEN -2 AND 3 AND q.y - p.y BETWEEN -2 AND 3 GROUP BY 1, 2, 3)
SELECT slice_id, x, y, {R('(2 * ma * mb + 6.5025::DOUBLE) * (2 * (ab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (aa - ma * ma + bb - mb * mb + 58.5225::DOUBLE))', 'ssim')} FROM s""")
def ssim_local(spark, sf_dir):
    made = stencils.block_ssim(pair_blocks(spark, sf_dir).select("slice_id", "pixels"), "pixels", 8, 8)
    return rounded(sg.explode_pixels(made, value="ssim"))


DIRS_SQL = "(VALUES " + ", ".join(f"({s * x}, {s * y}, {s * z}, {1 / (abs(x) + abs(y) + abs(z))!r}::DOUBLE)" for x, y, z in stencils.DIRECTIONS for s in (1, -1)) + ") d(ox, oy, oz, f)"


@query(f"""WITH {PX3}, vol AS (SELECT stack_id, x, y, z, v::DOUBLE AS v, CASE WHEN v > 480 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM px3),
n AS (SELECT p.stack_id, p.x, p.y, p.z, q.v AS vn, q.c AS cn, f, CASE WHEN p.c > 0 AND q.c > 0 THEN f / sqrt(1 + ((q.v - p.v) * sqrt(f) / 100.0::DOUBLE) ** 2) ELSE 0 END AS b
  FROM (SELECT * FROM vol, {DIRS_SQL}) p JOIN vol q ON q.stack_id = p.stack_id AND q.x = p.x + ox AND q.y = p.y + oy AND q.z = p.z + oz),
s AS (SELECT stack_id, x, y, z, sum(b * vn * cn) AS s, sum(b * cn) AS w, sum(CASE WHEN cn > 0 THEN b ELSE 0 END) AS o FROM n GROUP BY 1, 2, 3, 4)
SELECT stack_id, x, y, z, {R('CASE WHEN c + 0.5::DOUBLE * (coalesce(w, 0) - coalesce(o, 0) * c) > 0 THEN (v * c + 0.5::DOUBLE * (coalesce(s, 0) - coalesce(o, 0) * v * c)) / (c + 0.5::DOUBLE * (coalesce(w, 0) - coalesce(o, 0) * c)) ELSE 0 END', 'v')}
FROM vol LEFT JOIN s USING (stack_id, x, y, z)""")
def regularise13(spark, sf_dir):
    vol = sg.px3(spark, sf_dir).select("stack_id", "x", "y", "z", "v", F.when(F.col("v") > 480, 1.0).otherwise(0.0).alias("c"))
    return rounded(stencils.regularised(vol, ["stack_id"], delta=100.0, alpha=0.05, lam=100000.0))


# Resampling


@query(f"""WITH {PX}, o AS (SELECT DISTINCT slice_id FROM px), l AS (SELECT slice_id, CAST(i % 5 AS INT) AS ox, CAST(i // 5 AS INT) AS oy FROM o, range(25) t(i)),
s AS (SELECT *, CAST(round((ox - 2.0::DOUBLE) * 1.5 + 3.5) AS INT) AS x, CAST(round((oy - 2.0::DOUBLE) * 1.5 + 3.5) AS INT) AS y FROM l)
SELECT slice_id, ox, oy, coalesce(v, 0)::DOUBLE AS v FROM s LEFT JOIN px USING (slice_id, x, y)""")
def resample_nn(spark, sf_dir):
    return rounded(pj.resample(sg.blocks(spark, sf_dir).select("slice_id"), sg.px(spark, sf_dir), 8, 1.0, 1.5, "nearest"))


LINEAR = f"""{PX}, o AS (SELECT DISTINCT slice_id FROM px), l AS (SELECT slice_id, CAST(i % 5 AS INT) AS ox, CAST(i // 5 AS INT) AS oy FROM o, range(25) t(i)),
s AS (SELECT *, (ox - 2.0::DOUBLE) * 1.5 + 3.5 AS sx, (oy - 2.0::DOUBLE) * 1.5 + 3.5 AS sy FROM l),
c AS (SELECT slice_id, ox, oy, CAST(floor(sx) AS INT) + a AS x, CAST(floor(sy) AS INT) + b AS y, (1 - abs(sx - floor(sx) - a)) * (1 - abs(sy - floor(sy) - b)) AS w FROM s, range(2) p(a), range(2) q(b))"""


@query(f"WITH {LINEAR} SELECT slice_id, ox, oy, {R('sum(w * coalesce(v, 0))', 'v')} FROM c LEFT JOIN px USING (slice_id, x, y) GROUP BY 1, 2, 3")
def resample_linear(spark, sf_dir):
    return rounded(pj.resample(sg.blocks(spark, sf_dir).select("slice_id"), sg.px(spark, sf_dir), 8, 1.0, 1.5))


@query(f"""WITH {LINEAR}, g AS (SELECT slice_id, ox, oy, sum(w * v) FILTER (v > 480) AS s, sum(w) FILTER (v > 480) AS w, count(*) FILTER (coalesce(v, 0) <= 480) AS bad FROM c LEFT JOIN px USING (slice_id, x, y) GROUP BY 1, 2, 3)
SELECT slice_id, ox, oy, {R('CASE WHEN 2 * bad < 4 AND w > 0 THEN s / w ELSE 480 END', 'v')} FROM g""")
def resample_with_padding(spark, sf_dir):
    return rounded(pj.resample_padded(sg.blocks(spark, sf_dir).select("slice_id"), sg.px(spark, sf_dir), 8, 1.0, 1.5, 480))


# Coordinates


POSE = """pose AS (SELECT vec_id AS slice_id, (vec_id % 5)::DOUBLE - 2 AS tx, (vec_id % 3)::DOUBLE - 1 AS ty, (vec_id % 2)::DOUBLE * 0.5 AS tz,
 radians((vec_id % 4)::DOUBLE * 2) AS ax, radians((vec_id % 6)::DOUBLE * 1.5) AS ay, radians((vec_id % 7)::DOUBLE * 3) AS az FROM embeddings),
mat AS (SELECT slice_id, cos(ay) * cos(az) AS m0, cos(ay) * sin(az) AS m1, -sin(ay) AS m2, tx AS m3,
 sin(ax) * sin(ay) * cos(az) - cos(ax) * sin(az) AS m4, sin(ax) * sin(ay) * sin(az) + cos(ax) * cos(az) AS m5, sin(ax) * cos(ay) AS m6, ty AS m7,
 cos(ax) * sin(ay) * cos(az) + sin(ax) * sin(az) AS m8, cos(ax) * sin(ay) * sin(az) - sin(ax) * cos(az) AS m9, cos(ax) * cos(ay) AS m10, tz AS m11, ax, ay, az FROM pose)"""


def matrix() -> list[Column]:
    return coords.rigid(**sg.pose(F.col("slice_id")))


@query(f"""WITH {PX3}, {POSE} SELECT slice_id, x, y, {R('m0 * (x - 3.5) + m1 * (y - 3.5) + m2 * z + m3', 'wx')}, {R('m4 * (x - 3.5) + m5 * (y - 3.5) + m6 * z + m7', 'wy')}, {R('m8 * (x - 3.5) + m9 * (y - 3.5) + m10 * z + m11', 'wz')}
FROM px3 JOIN mat USING (slice_id)""")
def rigid_transform_points(spark, sf_dir):
    w = coords.apply(matrix(), F.col("x") - 3.5, F.col("y") - 3.5, F.col("z"))
    return rounded(sg.px3(spark, sf_dir).select("slice_id", "x", "y", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))]))


@query(f"WITH {POSE} SELECT slice_id, {R('m3', 'tx')}, {R('m7', 'ty')}, {R('m11', 'tz')}, {R('degrees(ax)', 'rx')}, {R('degrees(ay)', 'ry')}, {R('degrees(az)', 'rz')} FROM mat")
def params_from_matrix(spark, sf_dir):
    """Parameters of the inverse of the inverse of each slice's matrix: what went in."""
    images = sg.blocks(spark, sf_dir)
    back = coords.parameters(coords.rigid_inverse(coords.rigid_inverse(matrix())))
    return rounded(images.select("slice_id", *[c.alias(n) for n, c in back.items()]))


@query(f"""WITH {PX} SELECT slice_id, x, y, {R('10 + 2.0 * (y - 3.5)', 'wx')}, {R('-5 + 1.5 * (x - 3.5)', 'wy')}, {R('(slice_id % 4) * 3.0', 'wz')}, x::DOUBLE AS bx, y::DOUBLE AS by, 0.0::DOUBLE AS bz,
 (y * 8 + x)::INT AS at FROM px""")
def image_to_world(spark, sf_dir):
    """Lattice places in millimetres with turned axes, back again, and their index."""
    lay = dict(n=(8, 8, 1), d=(1.5, 2.0, 3.0), origin=(F.lit(10.0), F.lit(-5.0), F.col("slice_id") % 4 * 3.0), axes=(0, 1, 0, 1, 0, 0, 0, 0, 1))
    w = coords.apply(coords.image_to_world(**lay), F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0))
    rows = sg.px(spark, sf_dir).select("slice_id", "x", "y", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))])
    b = coords.apply(coords.world_to_image(**lay), F.col("wx"), F.col("wy"), F.col("wz"))
    return rounded(rows.select("*", *[c.alias(n) for c, n in zip(b, ("bx", "by", "bz"))], coords.lattice_index(F.col("x"), F.col("y"), nx=8, ny=8).alias("at")))


@query(f"""WITH {POSE}, k AS (SELECT mat.*, (i & 1) * 8 - 3.5 AS x, (i >> 1 & 1) * 8 - 3.5 AS y, (i >> 2 & 1) AS z FROM mat, range(8) t(i))
SELECT slice_id, {R('min(m0 * x + m1 * y + m2 * z + m3)', 'x0')}, {R('max(m0 * x + m1 * y + m2 * z + m3)', 'x1')}, {R('min(m4 * x + m5 * y + m6 * z + m7)', 'y0')}, {R('max(m4 * x + m5 * y + m6 * z + m7)', 'y1')} FROM k GROUP BY 1""")
def bbox_transformed(spark, sf_dir):
    images = sg.blocks(spark, sf_dir).select("slice_id")
    corner = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((a * 8 - 3.5, b * 8 - 3.5, c), "xyz")]) for a in (0, 1) for b in (0, 1) for c in (0, 1)])).alias("k")
    x, y, _ = coords.apply(matrix(), F.col("k.x"), F.col("k.y"), F.col("k.z"))
    return rounded(images.select("slice_id", corner).groupBy("slice_id").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")))


# Projection and robust statistics: one chain of views, as the operators chain


PSF_SQL = "(VALUES " + ", ".join(f"({x}, {y}, {z}, {p!r}::DOUBLE)" for x, y, z, p in sg.PSF) + ") f(dx, dy, dz, p)"
COEFF = f"""{PX3}, {POSE}, dep AS (SELECT stack_id, max(z) + 1 AS nz FROM px3 GROUP BY 1),
q AS (SELECT stack_id, slice_id, x, y, p, x + dx - 3.5 AS ux, y + dy - 3.5 AS uy, z + dz AS uz FROM px3, {PSF_SQL}),
w AS (SELECT stack_id, slice_id, x, y, p, m0 * ux + m1 * uy + m2 * uz + m3 + 3.5 AS wx, m4 * ux + m5 * uy + m6 * uz + m7 + 3.5 AS wy, m8 * ux + m9 * uy + m10 * uz + m11 AS wz FROM q JOIN mat USING (slice_id)),
e AS (SELECT stack_id, slice_id, x, y, p, CAST(floor(wx) AS INT) + a AS vx, CAST(floor(wy) AS INT) + b AS vy, CAST(floor(wz) AS INT) + c AS vz,
 (1 - abs(wx - floor(wx) - a)) * (1 - abs(wy - floor(wy) - b)) * (1 - abs(wz - floor(wz) - c)) AS t FROM w, range(2) i(a), range(2) j(b), range(2) k(c)),
co AS (SELECT stack_id, slice_id, x, y, vx, vy, vz, sum(p * t) AS c FROM e JOIN dep USING (stack_id) WHERE t > 0 AND vx BETWEEN 0 AND 7 AND vy BETWEEN 0 AND 7 AND vz >= 0 AND vz < nz GROUP BY ALL)"""
VOLUME = f"""{COEFF}, vol AS (SELECT stack_id, vx, vy, vz, sum(c * v) / sum(c) AS vol, sum(c) AS volw FROM co JOIN px USING (slice_id, stack_id, x, y) GROUP BY 1, 2, 3, 4)"""
SIMULATED = f"""{VOLUME}, sm AS (SELECT stack_id, slice_id, x, y, sum(c * vol) / sum(c) AS sim, sum(c) AS simweight FROM co JOIN vol USING (stack_id, vx, vy, vz) GROUP BY 1, 2, 3, 4),
pix AS (SELECT sm.*, v FROM sm JOIN px USING (slice_id, stack_id, x, y)), ok AS (SELECT *, v - sim AS e FROM pix WHERE v <> -1 AND simweight > 0.99::DOUBLE)"""
EM0 = f"""{SIMULATED}, st AS (SELECT (SELECT avg(e * e) FROM ok) AS sigma, 0.9::DOUBLE AS mix, 1 / (2.1::DOUBLE * max(v) FILTER (v > 0) - 1.9::DOUBLE * min(v) FILTER (v > 0)) AS m FROM pix)"""
WEIGHTS = f"""{EM0}, ws AS (SELECT p.*, CASE WHEN v <> -1 AND simweight > 0.99::DOUBLE THEN
 (0.0001::DOUBLE * exp(-((v - sim) ** 2) / (2 * sigma)) / sqrt(6.28::DOUBLE * sigma)) * mix / ((0.0001::DOUBLE * exp(-((v - sim) ** 2) / (2 * sigma)) / sqrt(6.28::DOUBLE * sigma)) * mix + m * 0.0001::DOUBLE * (1 - mix)) ELSE 0 END AS w FROM pix p, st)"""
POTENTIAL = f"""{WEIGHTS}, pot AS (SELECT stack_id, slice_id, coalesce(sqrt(avg((1 - w) ** 2) FILTER (v <> -1 AND simweight > 0.99::DOUBLE)), -1) AS p FROM ws GROUP BY 1, 2)"""
DENS = lambda d, v: f"(0.0001::DOUBLE * exp(-({d}) * ({d}) / (2 * {v})) / sqrt(6.28::DOUBLE * {v}))"
SLICEW = f"""{POTENTIAL}, mn AS (SELECT sum(p * (1 - p)) / sum(1 - p) AS mean, sum(p * p) / sum(p) AS mean2 FROM pot WHERE p >= 0),
vr AS (SELECT mean, mean2, greatest(sum((p - mean) ** 2 * (1 - p)) / sum(1 - p), 1e-8::DOUBLE / 6.28::DOUBLE) AS v1, greatest(sum((p - mean2) ** 2 * p) / sum(p), 1e-8::DOUBLE / 6.28::DOUBLE) AS v2 FROM pot, mn WHERE p >= 0 GROUP BY 1, 2),
gg AS (SELECT stack_id, slice_id, p, mean, CASE WHEN p < mean2 THEN {DENS('p - mean', 'v1')} ELSE 0 END AS g1, CASE WHEN p > mean THEN {DENS('p - mean2', 'v2')} ELSE 0 END AS g2 FROM pot, vr),
sw AS (SELECT stack_id, slice_id, p AS potential, CASE WHEN p < 0 THEN 0 WHEN g1 * 0.9::DOUBLE + g2 * 0.1::DOUBLE > 0 THEN g1 * 0.9::DOUBLE / (g1 * 0.9::DOUBLE + g2 * 0.1::DOUBLE) WHEN p <= mean THEN 1 ELSE 0 END AS w_slice FROM gg)"""
SCALES = f"""{SLICEW}, sc AS (SELECT stack_id, slice_id, CASE WHEN sum(w * v * v) FILTER (v <> -1 AND simweight > 0.99::DOUBLE) > 0 THEN sum(w * v * sim) FILTER (v <> -1 AND simweight > 0.99::DOUBLE) / sum(w * v * v) FILTER (v <> -1 AND simweight > 0.99::DOUBLE) ELSE 1 END AS scale FROM ws GROUP BY 1, 2)"""


def coefficient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of all slices with voxels of their stack's volume; the pixel's value comes along."""
    images = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))
    return pj.coefficients(images, matrix(), sg.PSF, (3.5, 3.5, 0.0), (sg.SIDE, sg.SIDE))


def seen_slices(spark: SparkSession, sf_dir: str) -> pj.Relation:
    """The relation whose table is coefficient_rows."""
    images = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))
    return pj.seen_slices(images, matrix(), sg.PSF, (3.5, 3.5, 0.0), (sg.SIDE, sg.SIDE))


class Chain:
    """What the steps of a reconstruction read again and again, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.scratch = Scratch(spark)
        self.seen = seen_slices(spark, sf_dir)
        self.seen.images = self.scratch.put(self.seen.images, "images")
        self.volume = self.scratch.put(pj.back_projected(self.seen), "volume")

    def simulated(self) -> DataFrame:
        return pj.forward_projected(self.seen, self.volume, keep=("v",))

    def weighted(self) -> DataFrame:
        """Pixels with their posterior weights under the initial statistics."""
        pixels = self.scratch.put(self.simulated(), "pixels")
        return self.scratch.put(robust.weighted(pixels, robust.initial(pixels)), "weighted")


@query(f"WITH {COEFF} SELECT stack_id, slice_id, x, y, count(*) AS n, {R('sum(c)', 'total')}, {R('max(c)', 'most')} FROM co GROUP BY 1, 2, 3, 4")
def psf_coeff(spark, sf_dir):
    """Of each pixel, its voxels and the sum and highest of its coefficients."""
    return rounded(coefficient_rows(spark, sf_dir).groupBy("stack_id", "slice_id", "x", "y").agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.max("c").alias("most")))


@query(f"WITH {VOLUME} SELECT stack_id, vx, vy, vz, {R('vol', 'vol')}, {R('volw', 'volw')} FROM vol")
def back_project(spark, sf_dir):
    return rounded(pj.back_projected(seen_slices(spark, sf_dir)))


@query(f"WITH {SIMULATED} SELECT stack_id, slice_id, x, y, v, {R('sim', 'sim')}, {R('simweight', 'simweight')} FROM pix")
def forward_project(spark, sf_dir):
    return rounded(Chain(spark, sf_dir).simulated()).select("stack_id", "slice_id", "x", "y", "v", "sim", "simweight")


@query(f"WITH {EM0} SELECT {R('sigma', 'sigma')}, {R('mix', 'mix')}, {R('m', 'm')} FROM st")
def em_init_stats(spark, sf_dir):
    state = robust.initial(Chain(spark, sf_dir).simulated())
    return rounded(spark.createDataFrame([state], "sigma double, mix double, m double"))


@query(f"WITH {WEIGHTS} SELECT slice_id, x, y, {R('w', 'w')} FROM ws")
def e_step_voxel(spark, sf_dir):
    return rounded(Chain(spark, sf_dir).weighted().select("slice_id", "x", "y", "w"))


@query(f"WITH {SLICEW} SELECT stack_id, slice_id, {R('potential', 'potential')}, {R('w_slice', 'w_slice')} FROM sw")
def e_step_slice(spark, sf_dir):
    return rounded(robust.slice_weights(robust.potentials(Chain(spark, sf_dir).weighted()))[0])


@query(f"WITH {WEIGHTS}, k AS (SELECT *, v - sim AS e FROM ws WHERE v <> -1 AND simweight > 0.99::DOUBLE) SELECT {R('greatest(sum(e * e * w) / sum(w), 1e-8::DOUBLE / 6.28::DOUBLE)', 'sigma')}, {R('sum(w) / count(*)', 'mix')}, {R('1 / (max(e) - min(e))', 'm')} FROM k")
def m_step(spark, sf_dir):
    state = robust.maximised(Chain(spark, sf_dir).weighted())
    return rounded(spark.createDataFrame([state], "sigma double, mix double, m double"))


@query(f"WITH {SCALES} SELECT stack_id, slice_id, {R('scale', 'scale')} FROM sc")
def slice_scale(spark, sf_dir):
    return rounded(robust.slice_scales(Chain(spark, sf_dir).weighted()))


@query(f"WITH {SLICEW} SELECT {R('sum(w * w_slice * v * sim) / sum(w * w_slice * sim * sim)', 'scale')} FROM ws JOIN sw USING (slice_id) WHERE v <> -1 AND simweight > 0.99::DOUBLE")
def volume_scale(spark, sf_dir):
    pixels = Chain(spark, sf_dir).weighted()
    return rounded(robust.volume_scale(pixels.join(robust.slice_weights(robust.potentials(pixels))[0].drop("stack_id"), "slice_id")))


@query(f"""WITH {SCALES}, ad AS (SELECT co.stack_id, vx, vy, vz, sum(c * w * w_slice * (CASE WHEN sim > 0 THEN v * scale - sim ELSE 0 END)) AS addon, sum(c * w * w_slice) AS cmap
 FROM co JOIN ws USING (slice_id, x, y) JOIN sw USING (slice_id) JOIN sc USING (slice_id) GROUP BY 1, 2, 3, 4)
SELECT stack_id, vx, vy, vz, {R('least(1100, greatest(0, vol + 0.8::DOUBLE * CASE WHEN coalesce(cmap, 0) > 0 THEN addon / cmap ELSE 0 END))', 'vol')}, {R('coalesce(cmap, 0)', 'cmap')} FROM vol LEFT JOIN ad USING (stack_id, vx, vy, vz)""")
def superres_step(spark, sf_dir):
    chain = Chain(spark, sf_dir)
    pixels = chain.weighted()
    slices = robust.slice_weights(robust.potentials(pixels))[0].select("slice_id", "w_slice").join(robust.slice_scales(pixels).select("slice_id", "scale"), "slice_id")
    return rounded(robust.super_resolved(chain.seen, pixels.join(slices, "slice_id"), chain.volume, 0.8, 0.0, 1000.0))


@query(f"WITH {SLICEW}, ins AS (SELECT slice_id, max(simweight) > 0.99::DOUBLE AS inside FROM pix GROUP BY 1) SELECT stack_id, count(*) FILTER (inside AND w_slice >= 0.5) AS included, count(*) FILTER (inside AND w_slice < 0.5) AS excluded, count(*) FILTER (NOT inside) AS outside FROM sw JOIN ins USING (slice_id) GROUP BY 1")
def slice_report(spark, sf_dir):
    pixels = Chain(spark, sf_dir).weighted()
    inside = pixels.groupBy("slice_id").agg((F.max("simweight") > robust.SURE).alias("inside"))
    return robust.report(robust.slice_weights(robust.potentials(pixels))[0].join(inside, "slice_id"))


@query(f"WITH {WEIGHTS}, b AS (SELECT slice_id, x, y, CASE WHEN v > 1 AND sim > 1 AND simweight > 0.99::DOUBLE THEN ln(v / sim) * w ELSE 0 END AS b FROM ws) SELECT slice_id, x, y, {R('b - avg(b) OVER (PARTITION BY slice_id)', 'bias')} FROM b")
def bias_residual(spark, sf_dir):
    """Weighted log residuals with zero mean in each slice."""
    b = Chain(spark, sf_dir).weighted().select("slice_id", "x", "y", robust.bias_residual().alias("b"))
    return rounded(b.select("slice_id", "x", "y", (F.col("b") - F.avg("b").over(W.partitionBy("slice_id"))).alias("bias")))


# Patches, evaluation, kernels


@query(f"WITH {PX} SELECT slice_id, stack_id, x, y, v, CAST(a * 2 AS INT) AS px0, CAST(b * 2 AS INT) AS py0 FROM px, range(2) i(a), range(2) j(b) WHERE x >= a * 2 AND x < a * 2 + 4 AND y >= b * 2 AND y < b * 2 + 4")
def patch_extract(spark, sf_dir):
    return patches.extracted(sg.px(spark, sf_dir), 8, 8, 4, 2)


@query(f"WITH {PX}, q AS (SELECT slice_id, v, CAST(a * 2 AS INT) AS px0, CAST(b * 2 AS INT) AS py0 FROM px, range(2) i(a), range(2) j(b) WHERE x >= a * 2 AND x < a * 2 + 4 AND y >= b * 2 AND y < b * 2 + 4) SELECT slice_id, px0, py0, count(*) FILTER (v > 510) AS n_set, count(*) AS n FROM q GROUP BY 1, 2, 3 HAVING count(*) FILTER (v > 510) > 16 / 3.0")
def patch_occupancy(spark, sf_dir):
    return patches.occupied(patches.extracted(sg.px(spark, sf_dir), 8, 8, 4, 2), 4, F.col("v") > 510)


GRID = patches.seeds(8, 8, 4)
GRID_SQL = "(VALUES " + ", ".join(f"({k}, {x}, {y})" for k, x, y in GRID) + ") g(label, gx, gy)"
SLIC = f"""{PX}, c AS (SELECT slice_id, label, x::DOUBLE AS cx, y::DOUBLE AS cy, v::DOUBLE AS cv FROM px JOIN {GRID_SQL} ON x = gx AND y = gy),
d AS (SELECT px.slice_id, px.x, px.y, v, label, (v - cv) ** 2 + ((x - cx) ** 2 + (y - cy) ** 2) * 100.0::DOUBLE AS d FROM px JOIN c ON c.slice_id = px.slice_id AND x >= cx - 4 AND x < cx + 4 AND y >= cy - 4 AND y < cy + 4),
a AS (SELECT slice_id, x, y, v, label FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, x, y ORDER BY d, label) AS k FROM d) WHERE k = 1)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sg.px(spark, sf_dir)
    return patches.assigned(rows, patches.seeded(rows, GRID), 4, 40.0)


@query(f"WITH {SLIC} SELECT * FROM a")
def slic_assign_step(spark, sf_dir):
    return _assigned(spark, sf_dir).filter("label IS NOT NULL").select("slice_id", "x", "y", "v", "label")


@query(f"WITH {SLIC} SELECT slice_id, label, {R('avg(x)', 'cx')}, {R('avg(y)', 'cy')}, {R('avg(v)', 'cv')} FROM a GROUP BY 1, 2")
def slic_update_step(spark, sf_dir):
    return rounded(patches.updated(_assigned(spark, sf_dir)))


@query(f"WITH {PX}, l AS (SELECT slice_id, x, y, v // 50 AS label FROM px) SELECT slice_id, x, y, CAST(coalesce(lead(label) OVER (PARTITION BY slice_id, y ORDER BY x) <> label, false) OR coalesce(lead(label) OVER (PARTITION BY slice_id, x ORDER BY y) <> label, false) AS INT) AS contour FROM l")
def label_contours(spark, sf_dir):
    labels = sg.px(spark, sf_dir).select("slice_id", "x", "y", F.floor(F.col("v") / 50).cast("int").alias("label"))
    return patches.contours(labels).select("slice_id", "x", "y", "contour")


@query(f"WITH {PAIRS} SELECT slice_id, {R('20 * log10(max(a)) - 10 * log10(sum((a - b) ** 2) / count(*))', 'psnr')} FROM pairs GROUP BY 1 HAVING sum((a - b) ** 2) > 0")
def psnr_pair(spark, sf_dir):
    d = (F.col("a") - F.col("b")).cast("double")
    s = pair_pixels(spark, sf_dir).groupBy("slice_id").agg(F.max("a").alias("m"), F.avg(d * d).alias("e"))
    return rounded(s.filter("e > 0").select("slice_id", (20 * F.log10("m") - 10 * F.log10("e")).alias("psnr")))


@query(f"WITH {PX} SELECT slice_id, CAST(floor(count(*) FILTER (v > 500) * 1.5::DOUBLE * 2.0 * 30.0 / 1000) AS BIGINT) AS ml FROM px GROUP BY 1")
def volume_measurement(spark, sf_dir):
    n = F.size(F.filter("pixels", lambda p: p > 500))
    return sg.blocks(spark, sf_dir).select("slice_id", F.floor(n * 1.5 * 2.0 * 30.0 / 1000).cast("long").alias("ml"))


def _kernel(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    made = kernels.per_image(sg.blocks(spark, sf_dir).select("slice_id", "pixels"), f, 8)
    return rounded(sg.explode_pixels(made).select("slice_id", "x", "y", "v"))


@query(f"""WITH RECURSIVE {PX}, m AS (SELECT slice_id, x, y, y * 8 + x AS k FROM px WHERE v > 510),
e AS (SELECT p.slice_id, p.k AS a, q.k AS b FROM m p JOIN m q ON p.slice_id = q.slice_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1),
r AS (SELECT slice_id, k, k AS least FROM m UNION SELECT r.slice_id, e.b, r.least FROM r JOIN e ON e.slice_id = r.slice_id AND e.a = r.k WHERE r.least < e.b),
l AS (SELECT slice_id, k, min(least) AS label FROM r GROUP BY 1, 2), s AS (SELECT slice_id, label, count(*) AS n FROM l GROUP BY 1, 2),
t AS (SELECT slice_id, label FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY n DESC, label) AS i FROM s) WHERE i = 1)
SELECT px.slice_id, px.x, px.y, CASE WHEN t.label IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM px LEFT JOIN l ON l.slice_id = px.slice_id AND l.k = px.y * 8 + px.x LEFT JOIN t ON t.slice_id = px.slice_id AND t.label = l.label""")
def largest_component(spark, sf_dir):
    return _kernel(spark, sf_dir, _lcc)


def _lcc(image):
    return kernels.largest_component(image > 510)


def _distance(expr: str) -> str:
    return f"""WITH {PX}, d AS (SELECT p.slice_id, p.x, p.y, {expr} AS d FROM px p JOIN px q ON p.slice_id = q.slice_id AND q.v > 500 GROUP BY 1, 2, 3) SELECT slice_id, x, y, {R('d', 'v')} FROM d"""


@query(_distance("min(abs(p.x - q.x) + abs(p.y - q.y))::DOUBLE"))
def distance_cityblock(spark, sf_dir):
    return _kernel(spark, sf_dir, _city).filter(F.col("v") < 1e9)


@query(_distance("sqrt(min((p.x - q.x) ** 2 + (p.y - q.y) ** 2))"))
def distance_euclidean(spark, sf_dir):
    return _kernel(spark, sf_dir, _euclid).filter(F.col("v") < 1e9)


def _city(image):
    return kernels.distances(image > 500, city=True)


def _euclid(image):
    return kernels.distances(image > 500)


@query()
def fft_blur(spark, sf_dir):
    return _kernel(spark, sf_dir, kernels.fourier_blur(1.0))


@query()
def anisotropic_diffusion(spark, sf_dir):
    return _kernel(spark, sf_dir, kernels.diffusion(5, 40.0))


@query()
def nonlocal_median(spark, sf_dir):
    return _kernel(spark, sf_dir, kernels.nonlocal_median(1, 50.0))


@query()
def bspline_coefficients(spark, sf_dir):
    return _kernel(spark, sf_dir, kernels.spline_coefficients)


@query()
def svd_motion_score(spark, sf_dir):
    return rounded(kernels.motion_scores(sg.blocks(spark, sf_dir)))


@query()
def register_slice(spark, sf_dir):
    return rounded(kernels.registration(sg.blocks(spark, sf_dir), 8))


# Scalars


@query("SELECT p_partkey, round(0.0001::DOUBLE * exp(-p_size * p_size / (2 * 25.0::DOUBLE)) / sqrt(6.28::DOUBLE * 25.0), 9) + 0.0 AS g, round(p_size * 0.0001::DOUBLE, 9) + 0.0 AS m, round((1 - f) ** 3 / 6, 9) + 0.0 AS b0, round((3 * f ** 3 - 6 * f ** 2 + 4) / 6, 9) + 0.0 AS b1, round((-3 * f ** 3 + 3 * f ** 2 + 3 * f + 1) / 6, 9) + 0.0 AS b2, round(f ** 3 / 6, 9) + 0.0 AS b3, split_part(p_type, ' ', -1) AS last FROM (SELECT *, p_retailprice - floor(p_retailprice) AS f FROM part)")
def scalar_functions(spark, sf_dir):
    """Densities, spline bases and string pieces over the part table."""
    size = F.col("p_size").cast("double")
    f = F.col("p_retailprice") - F.floor("p_retailprice")
    rows = sg.table(spark, sf_dir, "part").select("p_partkey", scalars.gaussian_density(size, F.lit(25.0)).alias("g"), scalars.uniform_density(size).alias("m"), *[scalars.bspline(i, f).alias(f"b{i}") for i in range(4)], scalars.base_name(F.regexp_replace("p_type", " ", "/")).alias("last"))
    return rounded(rows, 9)

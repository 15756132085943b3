"""Queries of kernels, interpolation, resampling under transformations, and kernels on whole images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import kernels, projection as pj, stencils
from gridloom.queries import KERNEL, KERNEL_SQL, POSE, _made, matrix
from gridloom.registry import ORACLES, PX, PX3, R, query, rounded
from gridloom.sources import surrogate as sg

D = "::DOUBLE"


def _blocks(spark, sf_dir):
    return sg.blocks(spark, sf_dir).select("slice_id", "pixels")


# Blur, convolution, derivatives


@query(f"""WITH {PX}, bx AS (SELECT p.slice_id, p.x, p.y, CASE WHEN p.v > 480 THEN sum(q.v * w) FILTER (q.v > 480) / sum(w) FILTER (q.v > 480) ELSE p.v END AS v FROM px p, {KERNEL_SQL}, px q WHERE q.slice_id = p.slice_id AND q.y = p.y AND q.x = p.x + k GROUP BY p.slice_id, p.x, p.y, p.v)
SELECT p.slice_id, p.x, p.y, {R('CASE WHEN p.v > 480 THEN sum(q.v * w) FILTER (q.v > 480) / sum(w) FILTER (q.v > 480) ELSE p.v END', 'v')} FROM bx p, {KERNEL_SQL}, bx q WHERE q.slice_id = p.slice_id AND q.x = p.x AND q.y = p.y + k GROUP BY p.slice_id, p.x, p.y, p.v""")
def blur_with_padding(spark, sf_dir):
    """Values up to 480 are padding."""
    return rounded(sg.explode_pixels(stencils.block_separable(_blocks(spark, sf_dir), KERNEL, 8, 8, padding=480)))


@query(f"""WITH {PX3}, bx AS (SELECT p.stack_id, p.x, p.y, p.z, sum(q.v * w) / sum(w) AS v FROM px3 p, {KERNEL_SQL}, px3 q WHERE q.slice_id = p.slice_id AND q.y = p.y AND q.x = p.x + k GROUP BY p.stack_id, p.x, p.y, p.z),
bb AS (SELECT p.stack_id, p.x, p.y, p.z, sum(q.v * w) / sum(w) AS v FROM bx p, {KERNEL_SQL}, bx q WHERE q.stack_id = p.stack_id AND q.z = p.z AND q.x = p.x AND q.y = p.y + k GROUP BY p.stack_id, p.x, p.y, p.z)
SELECT p.stack_id, p.x, p.y, p.z, {R('sum(q.v * w) / sum(w)', 'v')} FROM bb p, {KERNEL_SQL}, bb q WHERE q.stack_id = p.stack_id AND q.x = p.x AND q.y = p.y AND q.z = p.z + k GROUP BY p.stack_id, p.x, p.y, p.z""")
def blur_volume(spark, sf_dir):
    """In the plane on each slice's array, then across slices by a scatter along z."""
    flat = stencils.block_separable(sg.ranked(sg.blocks(spark, sf_dir)).select("slice_id", "stack_id", "z", "pixels"), KERNEL, 8, 8)
    rows = sg.explode_pixels(flat)
    found = stencils.across(rows, ["stack_id", "x", "y"], "z", KERNEL)
    return rounded(found.select("stack_id", "x", "y", "z", "v"))


CUBE = [(dx, dy, dz, 1.0 / (1 + abs(dx) + abs(dy) + abs(dz))) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]
CUBE_SQL = "(VALUES " + ", ".join(f"({x}, {y}, {z}, {w!r}{D})" for x, y, z, w in CUBE) + ") g(dx, dy, dz, w)"


def _volumes(spark, sf_dir):
    """Volumes as arrays: stack_id, nz and values, x fastest, from slices in order of z."""
    images = sg.ranked(sg.blocks(spark, sf_dir))
    return images.groupBy("stack_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "pixels"))), lambda s: s["pixels"])).alias("pixels"), F.count("*").cast("int").alias("nz"))


def _sent(spark, sf_dir, offsets, value="v"):
    """stack_id, x, y, z, w and the value of voxels at their neighbours' places within the plane."""
    return stencils.scatter(sg.px3(spark, sf_dir).select("stack_id", "x", "y", "z", value), ["stack_id"], offsets, {"x": 8, "y": 8, "z": 1 << 30}, value)


@query(f"""WITH {PX3} SELECT p.stack_id, p.x, p.y, p.z, {R('sum(q.v * w) / sum(w)', 'v')} FROM px3 p, {CUBE_SQL}, px3 q WHERE q.stack_id = p.stack_id AND q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz GROUP BY p.stack_id, p.x, p.y, p.z""")
def convolution_3d(spark, sf_dir):
    vol = sg.px3(spark, sf_dir)
    sums = _sent(spark, sf_dir, CUBE).groupBy("stack_id", "x", "y", "z").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return rounded(sums.join(vol.select("stack_id", "x", "y", "z"), ["stack_id", "x", "y", "z"]))


def _dilated(n: int, f: str) -> str:
    reach = {6: "abs(q.x - p.x) + abs(q.y - p.y) + abs(q.z - p.z) <= 1", 18: "abs(q.x - p.x) + abs(q.y - p.y) + abs(q.z - p.z) <= 2", 26: "TRUE"}[n]
    return f"""WITH {PX3}, t AS (SELECT stack_id, max(z) AS top FROM px3 GROUP BY 1) SELECT p.stack_id, p.x, p.y, p.z, CASE WHEN p.x IN (0, 7) OR p.y IN (0, 7) OR p.z IN (0, top) THEN max(p.v) ELSE {f}(q.v) END AS v FROM px3 p JOIN t USING (stack_id) JOIN px3 q ON q.stack_id = p.stack_id
 AND q.x - p.x BETWEEN -1 AND 1 AND q.y - p.y BETWEEN -1 AND 1 AND q.z - p.z BETWEEN -1 AND 1 AND {reach} GROUP BY p.stack_id, p.x, p.y, p.z, top"""


def _morphology(spark, sf_dir, n, dilate):
    offsets = [(0, 0, 0, 1.0)] + [(*o, 1.0) for o in stencils.CONNECTIVITY[n]]
    vol = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))
    rows = sg.explode_pixels(vol).select("stack_id", "x", "y", "z", "nz", "v")
    best = _sent(spark, sf_dir, offsets).groupBy("stack_id", "x", "y", "z").agg((F.max if dilate else F.min)("v").alias("m"))
    edge = F.col("x").isin(0, 7) | F.col("y").isin(0, 7) | (F.col("z") == 0) | (F.col("z") == F.col("nz") - 1)
    return rows.join(best, ["stack_id", "x", "y", "z"]).select("stack_id", "x", "y", "z", F.when(edge, F.col("v")).otherwise(F.col("m")).alias("v"))


@query(_dilated(26, "max"))
def dilate_26(spark, sf_dir):
    return _morphology(spark, sf_dir, 26, True)


@query(_dilated(18, "max"))
def dilate_18(spark, sf_dir):
    return _morphology(spark, sf_dir, 18, True)


@query(_dilated(6, "min"))
def erode_6(spark, sf_dir):
    return _morphology(spark, sf_dir, 6, False)


FIRST = [(k, -k * w) for k, w in scalars.gaussian_kernel(1.0)]
SECOND = [(k, (k * k - 1) * w) for k, w in scalars.gaussian_kernel(1.0)]
_vals = lambda kernel: "(VALUES " + ", ".join(f"({k}, {w!r}{D})" for k, w in kernel) + ") g(k, w)"


@query(f"""WITH {PX} SELECT p.slice_id, p.x, p.y, {R('sum(q.v * g.w)', 'ix')}, {R('sum(q.v * h.w)', 'ixx')} FROM px p JOIN px q ON q.slice_id = p.slice_id AND q.y = p.y JOIN {_vals(FIRST)} ON q.x = p.x + g.k JOIN {_vals(SECOND).replace('g(k, w)', 'h(k, w)')} ON h.k = g.k GROUP BY 1, 2, 3""")
def gaussian_derivatives(spark, sf_dir):
    """First and second derivative of a Gaussian along x."""
    made = F.arrays_zip(*[stencils.block_convolved("pixels", [(k, 0, w) for k, w in kernel], 8, 8, normalise=False).alias(n) for kernel, n in ((FIRST, "a"), (SECOND, "b"))])
    return rounded(_made(spark, sf_dir, made).select("slice_id", "x", "y", F.col("v.a").alias("ix"), F.col("v.b").alias("ixx")))


@query(f"SELECT p_partkey, {R('exp(-0.5 * s * s) / sqrt(2 * pi())', 'g')}, {R('-s * exp(-0.5 * s * s) / sqrt(2 * pi())', 'gx')}, {R('(s * s - 1) * exp(-0.5 * s * s) / sqrt(2 * pi())', 'gxx')}, {R('s * s * exp(-s * s) / (2 * pi())', 'gxy')} FROM (SELECT p_partkey, p_size / 10.0{D} AS s FROM part)")
def scalar_gaussian(spark, sf_dir):
    """A Gaussian and its derivatives."""
    s = F.col("p_size") / F.lit(10.0)
    return rounded(sg.table(spark, sf_dir, "part").select("p_partkey", *[scalars.gaussian_derivative(s, o).alias(n) for o, n in ((0, "g"), (1, "gx"), (2, "gxx"))], (scalars.gaussian_derivative(s, 1) * scalars.gaussian_derivative(s, 1)).alias("gxy")))


@query(f"""WITH {PX3}, g AS (SELECT slice_id, x, y, (coalesce(lead(v) OVER h, v) - coalesce(lag(v) OVER h, v)) / (CASE WHEN x IN (0, 7) THEN 1.0{D} ELSE 2.0{D} END * 1.5) AS gx, (coalesce(lead(v) OVER u, v) - coalesce(lag(v) OVER u, v)) / (CASE WHEN y IN (0, 7) THEN 1.0{D} ELSE 2.0{D} END * 2.0) AS gy, coalesce(lead(v) OVER w - lag(v) OVER w, 0){D} AS gz FROM px3
 WINDOW h AS (PARTITION BY slice_id, y ORDER BY x), u AS (PARTITION BY slice_id, x ORDER BY y), w AS (PARTITION BY stack_id, x, y ORDER BY z))
SELECT slice_id, x, y, {R('gx', 'gx')}, {R('gy', 'gy')}, {R('gz', 'gz')}, {R('CASE WHEN gx * gx + gy * gy > 0 THEN gx / sqrt(gx * gx + gy * gy) ELSE 0 END', 'nx')} FROM g""")
def gradient_vector(spark, sf_dir):
    """One-sided at edges and by spacing in the plane, with its unit vector; central across slices."""
    images = sg.ranked(sg.blocks(spark, sf_dir)).select("slice_id", "stack_id", "z", F.arrays_zip(stencils.block_gradients("pixels", 8, 8, True, (1.5, 2.0)).alias("g"), F.col("pixels").alias("p")).alias("pixels"))
    rows = sg.explode_pixels(images).select("slice_id", "stack_id", "x", "y", "z", F.col("v.g").alias("g"), F.col("v.p").alias("v"))
    flat = rows.select("slice_id", "stack_id", "x", "y", "z", "v", "g.gx", "g.gy", "g.magnitude")
    z = stencils.gradients(flat.withColumnsRenamed({"gx": "ax", "gy": "ay", "magnitude": "l"}), ["stack_id", "x", "y"], axes=("z",))
    return rounded(z.select("slice_id", "x", "y", F.col("ax").alias("gx"), F.col("ay").alias("gy"), "gz", F.when(F.col("l") > 0, F.col("ax") / F.col("l")).otherwise(0.0).alias("nx")))


# Kernels on whole images, and their SQL


def _wrapped_kernel(sigma: float) -> list[list[float]]:
    """The periodic kernel of fourier_blur on 8 places."""
    f = np.fft.fftfreq(8)
    return np.fft.ifft(np.exp(-2 * (np.pi * sigma) ** 2 * f * f)).real.tolist()


_ring = "(VALUES " + ", ".join(f"({k}, {w!r}{D})" for k, w in enumerate(_wrapped_kernel(1.0))) + ")"
ORACLES["fft_blur"] = f"""WITH {PX} SELECT p.slice_id, p.x, p.y, {R('sum(q.v * a.w * b.w)', 'v')} FROM px p JOIN px q ON q.slice_id = p.slice_id JOIN {_ring} a(k, w) ON a.k = (p.x - q.x + 8) % 8 JOIN {_ring} b(k, w) ON b.k = (p.y - q.y + 8) % 8 GROUP BY 1, 2, 3"""
_flow = lambda n: f"({n} / (1 + ({n} / 40.0{D}) ** 2))"
_steps = ", ".join(
    f"""u{k + 1} AS (SELECT slice_id, x, y, v + 0.2{D} * (coalesce({_flow('(lead(v) OVER h - v)')}, 0) - coalesce({_flow('(v - lag(v) OVER h)')}, 0) + coalesce({_flow('(lead(v) OVER u - v)')}, 0) - coalesce({_flow('(v - lag(v) OVER u)')}, 0)) AS v FROM u{k}
 WINDOW h AS (PARTITION BY slice_id, y ORDER BY x), u AS (PARTITION BY slice_id, x ORDER BY y))"""
    for k in range(5)
)
ORACLES["anisotropic_diffusion"] = f"WITH {PX}, u0 AS (SELECT slice_id, x, y, v{D} AS v FROM px), {_steps} SELECT slice_id, x, y, {R('v', 'v')} FROM u5"
_mirror = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
ORACLES["nonlocal_median"] = f"""WITH {PX}, w AS (SELECT p.slice_id, p.x, p.y, q.v AS n, exp(-(((q.v - p.v) / 50.0{D}) ** 2)) AS w, (dy + 1) * 3 + dx + 1 AS k FROM px p, range(-1, 2) a(dx), range(-1, 2) b(dy), px q WHERE q.slice_id = p.slice_id AND q.x = {_mirror('p.x + dx')} AND q.y = {_mirror('p.y + dy')}),
c AS (SELECT *, sum(w) OVER (PARTITION BY slice_id, x, y ORDER BY n, k) AS up, sum(w) OVER (PARTITION BY slice_id, x, y) AS t FROM w) SELECT slice_id, x, y, min(n){D} AS v FROM c WHERE up >= t / 2 GROUP BY 1, 2, 3"""


def _spline_inverse() -> str:
    m = np.zeros((8, 8))
    for i in range(8):
        for k, w in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
            j = abs(i + k)
            m[i, min(j, 14 - j)] += w
    inv = np.linalg.inv(m)
    return "(VALUES " + ", ".join(f"({i}, {j}, {inv[i, j]!r}{D})".replace("np.float64(", "").replace(")::", "::") for i in range(8) for j in range(8)) + ")"


_inv = _spline_inverse()
ORACLES["bspline_coefficients"] = f"WITH {PX}, a AS (SELECT slice_id, i AS x, y, sum(v * w) AS v FROM px JOIN {_inv} m(i, j, w) ON j = x GROUP BY 1, 2, 3) SELECT slice_id, CAST(x AS INT) AS x, CAST(i AS INT) AS y, {R('sum(v * w)', 'v')} FROM a JOIN {_inv} m(i, j, w) ON j = y GROUP BY 1, 2, 3"


@query(f"""WITH {PX3}, s AS (SELECT stack_id, x, y, z FROM px3 WHERE v > 540) SELECT p.stack_id, p.x, p.y, p.z, {R('sqrt(min((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + 4 * (p.z - s.z) ** 2))', 'euclid')}, min(abs(p.x - s.x) + abs(p.y - s.y) + 2 * abs(p.z - s.z)){D} AS city FROM px3 p JOIN s USING (stack_id) GROUP BY 1, 2, 3, 4""")
def distances_3d(spark, sf_dir):
    """Distances in volumes with planes two apart, by envelopes along one axis after the other."""
    vol = _volumes(spark, sf_dir)
    made = kernels.per_volume(vol, lambda a: np.stack([kernels.distances(a > 540, (2.0, 1.0, 1.0)), kernels.distances(a > 540, (2.0, 1.0, 1.0), city=True)]), 8, 8)
    n = (F.size("pixels") / 2).cast("int")
    both = F.arrays_zip(F.slice("pixels", F.lit(1), n).alias("e"), F.slice("pixels", n + 1, n).alias("c"))
    rows = made.select("stack_id", F.posexplode(both).alias("at", "d"))
    at = F.col("at")
    return rounded(rows.select("stack_id", (at % 8).alias("x"), (F.floor(at / 8) % 8).cast("int").alias("y"), F.floor(at / 64).cast("int").alias("z"), F.col("d.e").alias("euclid"), F.col("d.c").alias("city")))


@query(f"""WITH RECURSIVE {PX3}, m AS (SELECT stack_id, (z * 8 + y) * 8 + x AS k, x, y, z FROM px3 WHERE v > 545), e AS (SELECT p.stack_id, p.k AS a, q.k AS b FROM m p JOIN m q ON p.stack_id = q.stack_id AND abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
r AS (SELECT stack_id, k, k AS least FROM m UNION SELECT r.stack_id, e.b, r.least FROM r JOIN e ON e.stack_id = r.stack_id AND e.a = r.k WHERE r.least < e.b), l AS (SELECT stack_id, k, min(least) AS label FROM r GROUP BY 1, 2)
SELECT stack_id, label, count(*) AS n FROM l GROUP BY 1, 2""")
def components_3d(spark, sf_dir):
    """All connected parts of volumes, with their sizes."""
    vol = _volumes(spark, sf_dir)
    made = kernels.per_volume(vol, lambda a: kernels.components(a > 545), 8, 8)
    labels = made.select("stack_id", F.explode("pixels").alias("label")).filter("label >= 0")
    return labels.groupBy("stack_id", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


# Interpolation and resampling


def _sampled(weight: str, reach: int, sum_one: bool = False) -> str:
    """SQL of values at ((i % 5) - 2) * 1.5 + 3.5, a little off, clamped places, by a kernel of the distance {t}."""
    total = "sum(wx * wy)" if sum_one else "1"
    return f"""WITH {PX}, o AS (SELECT DISTINCT slice_id FROM px), l AS (SELECT slice_id, CAST(i % 5 AS INT) AS ox, CAST(i // 5 AS INT) AS oy FROM o, range(25) t(i)), s AS (SELECT *, (ox - 2.0{D}) * 1.5 + 3.5 + 0.2{D} AS sx, (oy - 2.0{D}) * 1.5 + 3.5 - 0.3{D} AS sy FROM l),
c AS (SELECT slice_id, ox, oy, CAST(floor(sx) AS INT) + a AS cx, CAST(floor(sy) AS INT) + b AS cy, sx - (floor(sx) + a) AS dx, sy - (floor(sy) + b) AS dy FROM s, range({1 - reach}, {reach + 1}) p(a), range({1 - reach}, {reach + 1}) q(b)),
d AS (SELECT *, {weight.format(t='abs(dx)')} AS wx, {weight.format(t='abs(dy)')} AS wy FROM c) SELECT slice_id, ox, oy, {R(f'sum(wx * wy * v) / {total}', 'v')} FROM d JOIN px USING (slice_id) WHERE px.x = greatest(0, least(7, cx)) AND px.y = greatest(0, least(7, cy)) GROUP BY 1, 2, 3"""


def _interpolated(spark, sf_dir, kernel, reach, normalise=False, images=None):
    return rounded(pj.interpolated(_blocks(spark, sf_dir) if images is None else images, 8, 8, [((ox - 2) * 1.5 + 3.5 + 0.2, (oy - 2) * 1.5 + 3.5 - 0.3) for oy in range(5) for ox in range(5)], kernel, reach, normalise, 5))


@query(_sampled("(CASE WHEN {t} < 1 THEN {t} ** 3 - 2 * {t} ** 2 + 1 WHEN {t} < 2 THEN -({t} ** 3) + 5 * {t} ** 2 - 8 * {t} + 4 ELSE 0 END)", 2))
def interpolate_cubic(spark, sf_dir):
    return _interpolated(spark, sf_dir, pj.KERNELS["cubic"], 2)


@query(_sampled("(CASE WHEN {t} = 0 THEN 1 WHEN {t} < 6 THEN sin(pi() * {t}) / (pi() * {t}) * 0.5 * (1 + cos(pi() * {t} / 6)) ELSE 0 END)", 6, True))
def interpolate_sinc(spark, sf_dir):
    return _interpolated(spark, sf_dir, pj.KERNELS["sinc"], 6, True)


@query(_sampled("exp(-0.5 * {t} * {t})", 3, True))
def interpolate_gaussian(spark, sf_dir):
    return _interpolated(spark, sf_dir, pj.KERNELS["gaussian"], 3, True)


COEFFICIENTS = ORACLES["bspline_coefficients"].replace(f"WITH {PX}, ", "WITH ").replace("round(sum(v * w), 6) + 0.0", "sum(v * w)")
_bspline = _sampled("(CASE WHEN {t} < 1 THEN (4 - 6 * {t} ** 2 + 3 * {t} ** 3) / 6 WHEN {t} < 2 THEN (2 - {t}) ** 3 / 6 ELSE 0 END)", 2)


@query(_bspline.replace("JOIN px USING", "JOIN cf px USING").replace(f"WITH {PX}, ", f"WITH {PX}, cf AS ({COEFFICIENTS}), "))
def interpolate_bspline(spark, sf_dir):
    """Coefficients first, then the four basis functions about each place."""
    coefficients = kernels.per_image(_blocks(spark, sf_dir), kernels.spline_coefficients, 8)
    return _interpolated(spark, sf_dir, pj.KERNELS["bspline"], 2, images=coefficients)


@query(f"""WITH {PX}, {POSE}, s AS (SELECT slice_id, ox, oy, m5 * (ox - 3.5 - m3) - m1 * (oy - 3.5 - m7) AS ux, -m4 * (ox - 3.5 - m3) + m0 * (oy - 3.5 - m7) AS uy, m0 * m5 - m1 * m4 AS det FROM (SELECT slice_id, x AS ox, y AS oy FROM px) JOIN mat USING (slice_id)),
t AS (SELECT slice_id, ox, oy, ux / det + 3.5 AS sx, uy / det + 3.5 AS sy FROM s), c AS (SELECT slice_id, ox, oy, sx, sy, CAST(floor(sx) AS INT) + a AS x, CAST(floor(sy) AS INT) + b AS y, (1 - abs(sx - floor(sx) - a)) * (1 - abs(sy - floor(sy) - b)) AS w FROM t, range(2) p(a), range(2) q(b))
SELECT slice_id, ox AS x, oy AS y, {R('CASE WHEN min(sx) >= -0.5 AND min(sx) < 7.5 AND min(sy) >= -0.5 AND min(sy) < 7.5 THEN sum(w * coalesce(v, 0)) * 2 + 10 ELSE -1 END', 'v')} FROM c LEFT JOIN px USING (slice_id, x, y) GROUP BY 1, 2, 3""")
def resample_transformed(spark, sf_dir):
    """Each slice under the in-plane part of its pose and its inverse composed: output place, inverse map, linear value scaled by 2 and shifted by 10; -1 outside the field of view."""
    m = matrix()
    det = m[0] * m[5] - m[1] * m[4]
    inverse = (m[5] / det, -m[1] / det, -m[4] / det, m[0] / det)
    images = sg.blocks(spark, sf_dir).select("slice_id", "pixels", F.array(*inverse, m[3], m[7]).alias("t"))
    return rounded(sg.explode_pixels(pj.transformed(images, 8, 8, scale=2.0, offset=10.0, padding=-1.0)))


@query(f"""WITH {PX}, a AS (SELECT slice_id, CAST(x // 2 AS INT) AS hx, CAST(y // 2 AS INT) AS hy, avg(v) AS v FROM px GROUP BY 1, 2, 3) SELECT slice_id, CAST(hx // 2 AS INT) AS x, CAST(hy // 2 AS INT) AS y, {R('avg(v)', 'v')} FROM a GROUP BY 1, 2, 3""")
def iterative_resampling(spark, sf_dir):
    """Spacing doubled twice; each time a place lies halfway between two, so linear values are means of four."""
    images = _blocks(spark, sf_dir)
    for n in (8, 4):
        images = pj.halved(images, n, n)
    return rounded(sg.explode_pixels(images, nx=2))


@query(f"WITH {PX} SELECT slice_id, count(*) AS n, TRUE AS inside, TRUE AS still FROM px GROUP BY 1")
def uniform_noise(spark, sf_dir):
    """Uniform noise drawn once for each pixel from a seed: values stay within its bounds, padding stays."""
    made = sg.explode_pixels(_blocks(spark, sf_dir).select("slice_id", F.col("pixels").alias("p"), pj.with_noise("pixels", "slice_id", 7, -5.0, 5.0, padding=480).alias("pixels")).select("slice_id", F.arrays_zip("p", "pixels").alias("pixels")))
    a, b = F.col("v.p"), F.col("v.pixels")
    return made.groupBy("slice_id").agg(F.count("*").alias("n"), F.bool_and(F.abs(b - a) <= 5).alias("inside"), F.bool_and((a > 480) | (a == b)).alias("still"))

"""Queries of reconstruction: set-up of masks and stacks, bias fields, state of the robust statistics, and whole iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions import coords
from gridloom.operators import projection as pj, robust, stencils
from gridloom.queries import COEFF, DENS, KERNEL, KERNEL_SQL, POSE, SCALES, SIMULATED, SLICEW, VOLUME, WEIGHTS, Chain, matrix, seen_slices
from gridloom.registry import PX, PX3, R, query, rounded
from gridloom.sources import surrogate as sg

D = "::DOUBLE"
VOXEL = pj.VOXEL


# Set-up


@query(f"WITH {PX}, p AS (SELECT slice_id, x, y, CASE WHEN v < 480 THEN -1 ELSE v END AS v FROM px), r AS (SELECT min(v) AS lo, max(v) AS hi FROM p WHERE v > 0) SELECT slice_id, x, y, CASE WHEN v = -1 THEN 0.0 ELSE 1.0 END{D} AS w, 0.0{D} AS b, 1.0{D} AS scale, 1.0{D} AS w_slice, lo, hi FROM p, r")
def em_reset(spark, sf_dir):
    """Weights, bias, scales and slice weights before the first step, and the range of positive values."""
    rows = sg.px(spark, sf_dir).withColumn("v", F.when(F.col("v") < 480, -1).otherwise(F.col("v")))
    return robust.reset(rows).select("slice_id", "x", "y", "w", "b", "scale", "w_slice", "lo", "hi")


@query(f"""WITH {PX}, f AS (SELECT stack_id, 500.0{D} / avg(v) AS factor FROM px WHERE v > 0 GROUP BY 1) SELECT slice_id, x, y, {R('CASE WHEN v > 0 THEN v / factor ELSE v END', 'v')} FROM px JOIN f USING (stack_id)""")
def restore_intensity(spark, sf_dir):
    """Positive values over their stack's factor."""
    rows = sg.px(spark, sf_dir)
    factors = rows.filter("v > 0").groupBy("stack_id").agg((F.lit(500.0) / F.avg(F.col("v").cast("double"))).alias("factor"))
    return rounded(robust.restored(rows, factors).select("slice_id", "x", "y", "v"))


@query(f"""WITH {PX}, m AS (SELECT stack_id, avg(v) AS mean FROM px WHERE v > 0 GROUP BY 1), g AS (SELECT avg(mean) AS mean FROM m) SELECT slice_id, x, y, {R('CASE WHEN v > 0 THEN v * 700.0 / g.mean ELSE v END', 'v')} FROM px, g""")
def intensity_match_together(spark, sf_dir):
    """One factor for all stacks: the target over the mean of the stacks' means."""
    rows = sg.px(spark, sf_dir)
    mean = rows.filter("v > 0").groupBy("stack_id").agg(F.avg(F.col("v").cast("double")).alias("m")).agg(F.avg("m")).first()[0]
    v = F.col("v").cast("double")
    return rounded(rows.select("slice_id", "x", "y", F.when(v > 0, v * 700.0 / mean).otherwise(v).alias("v")))


@query(f"""WITH {PX}, f AS (SELECT stack_id, min(slice_id) AS f FROM px GROUP BY 1), m AS (SELECT p.stack_id, x, y, v > 500 AS m FROM px p JOIN f ON slice_id = f), q AS (SELECT px.stack_id, v - 480 AS v FROM px JOIN m USING (stack_id, x, y) WHERE m)
SELECT stack_id, {R('avg(v)', 'mean_all')}, {R('avg(v) FILTER (v > 0)', 'mean_positive')}, count(*) AS n FROM q GROUP BY 1""")
def stack_mean_in_mask(spark, sf_dir):
    """Means over a mask (the stack's first slice over 500), of all values and of positive ones."""
    images = sg.blocks(spark, sf_dir)
    first = images.groupBy("stack_id").agg(F.min_by("pixels", "slice_id").alias("mask"))
    rows = sg.explode_pixels(images.join(first, "stack_id").select("stack_id", "slice_id", F.arrays_zip("pixels", "mask").alias("pixels"))).filter("v.mask > 500")
    v = (F.col("v.pixels") - 480).cast("double")
    return rounded(rows.groupBy("stack_id").agg(F.avg(v).alias("mean_all"), F.avg(F.when(v > 0, v)).alias("mean_positive"), F.count("*").alias("n")))


@query(f"""WITH {PX3}, c AS (SELECT stack_id, avg(x - 3.5) AS cx, avg(y - 3.5) AS cy, avg(z * 2.5) AS cz FROM px3 WHERE v >= 480 GROUP BY 1), t AS (SELECT * FROM c WHERE stack_id = (SELECT min(stack_id) FROM c)) SELECT c.stack_id, {R('t.cx - c.cx', 'tx')}, {R('t.cy - c.cy', 'ty')}, {R('t.cz - c.cz', 'tz')} FROM c, t""")
def stack_centring(spark, sf_dir):
    """The shift of each stack that lays its centre on the template's; values under 480 are padding."""
    rows = sg.px3(spark, sf_dir).filter("v >= 480")
    c = rows.groupBy("stack_id").agg(F.avg(F.col("x") - 3.5).alias("cx"), F.avg(F.col("y") - 3.5).alias("cy"), F.avg(F.col("z") * 2.5).alias("cz"))
    t = c.orderBy("stack_id").limit(1).select(*[F.col(f"c{a}").alias(f"t{a}") for a in "xyz"])
    both = c.join(F.broadcast(t))  # one row
    return rounded(both.select("stack_id", *[(F.col(f"t{a}") - F.col(f"c{a}")).alias(f"t{a}") for a in "xyz"]))


@query(f"""WITH {PX3}, n AS (SELECT stack_id, max(z) + 1 + 2 AS nz FROM px3 GROUP BY 1) SELECT stack_id, 1.25{D} AS d, 8 AS nx, CAST(floor(8 * 1.5{D} / 1.25) AS INT) AS ny, CAST(floor(nz * 2.5{D} / 1.25) AS INT) AS nz FROM n""")
def template_lattice(spark, sf_dir):
    """Sizes of the volume's lattice: two slices more, spacing the least of the stack's."""
    depth = sg.ranked(sg.blocks(spark, sf_dir)).groupBy("stack_id").agg((F.max("z") + 1).alias("n"))
    made = pj.template((F.lit(8), F.lit(8), F.col("n")), (1.25, 1.5, 2.5))
    return depth.select("stack_id", *[c.alias(k) for k, c in made.items()])


_mask_blur = f"""bx AS (SELECT stack_id, x - k AS x, y, sum(m * w) / sum(w) AS m FROM m0, {KERNEL_SQL} WHERE x - k BETWEEN 0 AND 7 GROUP BY stack_id, x - k, y), by_ AS (SELECT stack_id, x, y - k AS y, sum(m * w) / sum(w) AS m FROM bx, {KERNEL_SQL} WHERE y - k BETWEEN 0 AND 7 GROUP BY stack_id, x, y - k)"""


@query(f"""WITH {PX}, f AS (SELECT stack_id, min(slice_id) AS f FROM px GROUP BY 1), m0 AS (SELECT p.stack_id, x, y, CAST(v > 500 AS INT) AS m FROM px p JOIN f ON slice_id = f), {_mask_blur}
SELECT stack_id, CAST(i % 5 AS INT) AS ox, CAST(i // 5 AS INT) AS oy, CAST(m > 0.5 AS INT) AS m FROM range(25) t(i) JOIN by_ ON x = CAST(round((i % 5 - 2.0{D}) * 1.5 + 3.5) AS INT) AND y = CAST(round((i // 5 - 2.0{D}) * 1.5 + 3.5) AS INT)""")
def mask_install(spark, sf_dir):
    """A mask blurred, cut at a half, and taken by nearest places onto the template's lattice."""
    images = sg.blocks(spark, sf_dir)
    first = images.groupBy("stack_id").agg(F.min_by("pixels", "slice_id").alias("pixels")).select("stack_id", F.transform("pixels", lambda v: (v > 500).cast("int")).alias("pixels"))
    smooth = stencils.block_separable(first, KERNEL, 8, 8)
    place = lambda o: F.round((o - 2.0) * 1.5 + 3.5).cast("int")
    out = smooth.select("stack_id", "pixels", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")).select("stack_id", "pixels", (F.col("k") % 5).alias("ox"), F.floor(F.col("k") / 5).cast("int").alias("oy"))
    return out.select("stack_id", "ox", "oy", (F.get("pixels", place(F.col("oy")) * 8 + place(F.col("ox"))) > 0.5).cast("int").alias("m"))


MOVED = "round(m0 * (x - 3.5) + m1 * (y - 3.5) + m2 * z + m3 + 3.5) AS rx, round(m4 * (x - 3.5) + m5 * (y - 3.5) + m6 * z + m7 + 3.5) AS ry, round(m8 * (x - 3.5) + m9 * (y - 3.5) + m10 * z + m11) AS rz"


def moved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the voxel (rx, ry, rz) that their pose takes them next to."""
    w = coords.apply(matrix(), F.col("x") - 3.5, F.col("y") - 3.5, F.col("z"))
    return sg.px3(spark, sf_dir).select("stack_id", "slice_id", "x", "y", "z", "v", *[coords.nearest(c + s).alias(n) for c, s, n in zip(w, (3.5, 3.5, 0.0), ("rx", "ry", "rz"))])


@query(f"""WITH {PX3}, {POSE}, r AS (SELECT stack_id, slice_id, x, y, v, {MOVED} FROM px3 JOIN mat USING (slice_id)) SELECT r.slice_id, r.x, r.y, CASE WHEN q.v > 500 AND r.v >= 470 THEN r.v ELSE -1 END AS v FROM r LEFT JOIN px3 q ON q.stack_id = r.stack_id AND q.x = rx AND q.y = ry AND q.z = rz""")
def mask_slices(spark, sf_dir):
    """Pixels that are low, outside the volume, or outside the mask (the stack over 500) become padding."""
    mask = sg.px3(spark, sf_dir).select("stack_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), (F.col("v") > 500).alias("m"))
    met = moved_places(spark, sf_dir).join(mask, ["stack_id", "rx", "ry", "rz"], "left")
    return met.select("slice_id", "x", "y", F.when(F.coalesce("m", F.lit(False)) & (F.col("v") >= 470), F.col("v")).otherwise(-1).alias("v"))


@query(f"""WITH {PX3}, {POSE}, r AS (SELECT stack_id, slice_id, v, {MOVED} FROM px3 JOIN mat USING (slice_id)) SELECT stack_id, CAST(rx AS INT) AS x, CAST(ry AS INT) AS y, CAST(rz AS INT) AS z, {R('avg(v)', 'v')}, count(*) AS n FROM r WHERE v > 0 AND rx BETWEEN 0 AND 7 AND ry BETWEEN 0 AND 7 AND rz >= 0 GROUP BY ALL""")
def slice_average(spark, sf_dir):
    """Mean of the positive pixels nearest to each voxel."""
    rows = moved_places(spark, sf_dir).filter("v > 0 AND rx BETWEEN 0 AND 7 AND ry BETWEEN 0 AND 7 AND rz >= 0")
    return rounded(rows.groupBy("stack_id", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rz").alias("z")).agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("n")))


@query(f"""WITH {COEFF} SELECT stack_id, vx, vy, vz, {R('sum(c * CAST(v > 500 AS INT)) / sum(c)', 'm')} FROM co JOIN px USING (slice_id, stack_id, x, y) GROUP BY 1, 2, 3, 4""")
def manual_mask_projection(spark, sf_dir):
    """A mask drawn on slices, spread into the volume."""
    return rounded(pj.back_projected(seen_slices(spark, sf_dir).valued(F.transform("v", lambda v: (v > 500).cast("double")))).select(*VOXEL, F.col("vol").alias("m")))


@query(f"""WITH {SIMULATED} SELECT stack_id, z, pix.x, pix.y, {R('CASE WHEN simweight > 0.5 THEN sim ELSE 0 END', 'v')} FROM pix JOIN rk USING (slice_id)""")
def simulate_stacks(spark, sf_dir):
    """Simulated slices put together as stacks, 0 where little of the volume is seen."""
    z = sg.ranked(sg.blocks(spark, sf_dir)).select("slice_id", "z")
    rows = Chain(spark, sf_dir).simulated().join(z, "slice_id")
    return rounded(rows.select("stack_id", "z", "x", "y", F.when(F.col("simweight") > 0.5, F.col("sim")).otherwise(0.0).alias("v")))


# Bias


BIAS = f"""{WEIGHTS}, b0 AS (SELECT slice_id, x, y, CASE WHEN v <> -1 AND simweight > 0.99{D} THEN w * v ELSE 0 END AS wb, CASE WHEN v <> -1 AND simweight > 0.99{D} AND sim > 1 AND v > 1 THEN ln(v / sim) * w * v ELSE 0 END AS wr FROM ws),
b1 AS (SELECT slice_id, x - k AS x, y, sum(wb * g.w) AS wb, sum(wr * g.w) AS wr FROM b0, {KERNEL_SQL} WHERE x - k BETWEEN 0 AND 7 GROUP BY slice_id, x - k, y),
b2 AS (SELECT slice_id, x, y - k AS y, sum(wb * g.w) AS wb, sum(wr * g.w) AS wr FROM b1, {KERNEL_SQL} WHERE y - k BETWEEN 0 AND 7 GROUP BY slice_id, x, y - k),
b3 AS (SELECT px.slice_id, px.x, px.y, CASE WHEN wb > 0 THEN wr / wb ELSE 0 END AS b FROM px LEFT JOIN b2 USING (slice_id, x, y)), bi AS (SELECT slice_id, x, y, b - avg(b) OVER (PARTITION BY slice_id) AS b FROM b3)"""


@query(f"WITH {BIAS} SELECT slice_id, x, y, {R('b', 'b')} FROM bi")
def bias_field(spark, sf_dir):
    """Smoothed log residuals of each slice, with zero mean."""
    return rounded(robust.bias(Chain(spark, sf_dir).weighted(), KERNEL, 8, 8).select("slice_id", "x", "y", "b"))


_vol_blur = lambda src, a, b: f"""q1 AS (SELECT stack_id, vx - k AS vx, vy, vz, sum({a} * g.w) AS n, sum({b} * g.w) AS d FROM {src}, {KERNEL_SQL} WHERE vx - k BETWEEN 0 AND 7 GROUP BY stack_id, vx - k, vy, vz),
q2 AS (SELECT stack_id, vx, vy - k AS vy, vz, sum(n * g.w) AS n, sum(d * g.w) AS d FROM q1, {KERNEL_SQL} WHERE vy - k BETWEEN 0 AND 7 GROUP BY stack_id, vx, vy - k, vz), q3 AS (SELECT stack_id, vx, vy, vz - k AS vz, sum(n * g.w) AS n, sum(d * g.w) AS d FROM q2, {KERNEL_SQL} GROUP BY stack_id, vx, vy, vz - k)"""  # noqa: E731


@query(f"""WITH {BIAS}, sc AS (SELECT slice_id, sum(w * v * sim) FILTER (v <> -1 AND simweight > 0.99{D}) / sum(w * v * v) FILTER (v <> -1 AND simweight > 0.99{D}) AS scale FROM ws GROUP BY 1),
nb AS (SELECT co.stack_id, vx, vy, vz, sum(c * (b - CASE WHEN scale > 0 THEN ln(scale) ELSE 0 END)) / sum(c) AS nb FROM co JOIN bi USING (slice_id, x, y) JOIN sc USING (slice_id) GROUP BY 1, 2, 3, 4), {_vol_blur('nb', 'nb', '1')}
SELECT stack_id, vx, vy, vz, round(vol / exp(-n / d), 5) + 0.0 AS vol FROM vol JOIN q3 USING (stack_id, vx, vy, vz)""")
def normalise_bias(spark, sf_dir):
    """The slices' bias and scales, spread into the volume and smoothed, taken out of it."""
    chain = Chain(spark, sf_dir)
    pixels = chain.weighted()
    made = robust.normalised_bias(chain.seen, robust.bias(pixels, KERNEL, 8, 8), robust.slice_scales(pixels), chain.volume, KERNEL)
    return rounded(made, 5)


SUPER = f"""{SCALES}, ad AS (SELECT co.stack_id, vx, vy, vz, sum(c * w * w_slice * (CASE WHEN sim > 0 THEN v * scale - sim ELSE 0 END)) AS addon, sum(c * w * w_slice) AS cmap FROM co JOIN ws USING (slice_id, x, y) JOIN sw USING (slice_id) JOIN sc USING (slice_id) GROUP BY 1, 2, 3, 4),
su AS (SELECT stack_id, vx, vy, vz, vol AS old, least(1100, greatest(0, vol + 0.8{D} * CASE WHEN coalesce(cmap, 0) > 0 THEN addon / cmap ELSE 0 END)) AS vol, coalesce(cmap, 0) AS cmap FROM vol LEFT JOIN ad USING (stack_id, vx, vy, vz))"""


def super_resolved(spark, sf_dir):
    chain = Chain(spark, sf_dir)
    pixels = chain.weighted()
    slices = robust.slice_weights(robust.potentials(pixels))[0].select("slice_id", "w_slice").join(robust.slice_scales(pixels).select("slice_id", "scale"), "slice_id")
    return chain, chain.scratch.put(robust.super_resolved(chain.seen, pixels.join(slices, "slice_id"), chain.volume, 0.8, 0.0, 1000.0), "super")


@query(f"""WITH {SUPER}, lr AS (SELECT *, old > 10 AND vol > 10 AS m FROM su), l2 AS (SELECT stack_id, vx, vy, vz, CASE WHEN m THEN ln(vol / old) ELSE 0 END AS r, CASE WHEN m THEN 1 ELSE 0 END AS m FROM lr), {_vol_blur('l2', 'r', 'm')}
SELECT stack_id, vx, vy, vz, round(least(1100, greatest(0, vol / exp(n / d))), 5) + 0.0 AS vol FROM su JOIN q3 USING (stack_id, vx, vy, vz)""")
def global_bias_correct(spark, sf_dir):
    """The smoothed log ratio of a volume to the one before, taken out."""
    chain, after = super_resolved(spark, sf_dir)
    return rounded(robust.bias_corrected(after, chain.volume, KERNEL, 0.01, 0.0, 1000.0), 5)


def _regular(src: str, out: str, k: float = 0.5) -> str:
    """SQL of the regulariser over su-like rows: old, vol, cmap."""
    from gridloom.queries import DIRS_SQL

    return f"""rn AS (SELECT p.stack_id, p.vx, p.vy, p.vz, q.vol AS vn, q.cmap AS cn, CASE WHEN p.cmap > 0 AND q.cmap > 0 THEN f / sqrt(1 + ((q.old - p.old) * sqrt(f) / 100.0{D}) ** 2) ELSE 0 END AS b FROM (SELECT * FROM {src}, {DIRS_SQL}) p JOIN {src} q ON q.stack_id = p.stack_id AND q.vx = p.vx + ox AND q.vy = p.vy + oy AND q.vz = p.vz + oz),
rs AS (SELECT stack_id, vx, vy, vz, sum(b * vn * cn) AS s, sum(b * cn) AS w, sum(b) AS o FROM rn GROUP BY 1, 2, 3, 4),
{out} AS (SELECT stack_id, vx, vy, vz, CASE WHEN cmap + {k}{D} * (coalesce(w, 0) - coalesce(o, 0) * cmap) > 0 THEN (vol * cmap + {k}{D} * (coalesce(s, 0) - coalesce(o, 0) * vol * cmap)) / (cmap + {k}{D} * (coalesce(w, 0) - coalesce(o, 0) * cmap)) ELSE 0 END AS vol, cmap FROM {src} LEFT JOIN rs USING (stack_id, vx, vy, vz))"""


@query(f"WITH {SUPER}, {_regular('su', 'rg')} SELECT stack_id, vx, vy, vz, round(vol, 4) + 0.0 AS vol, {R('cmap', 'cmap')} FROM rg")
def superres_regularised(spark, sf_dir):
    """The step along residuals and then the regulariser, whose weights come from the volume before the step."""
    chain, after = super_resolved(spark, sf_dir)
    out = robust.regularised_step(after, chain.volume, delta=100.0, alpha=0.05, lam=100000.0)
    return rounded(out.select(*VOXEL, F.round("vol", 4).alias("vol"), "cmap"))


@query(f"WITH {SLICEW}, k AS (SELECT sum(w * w_slice * v * sim) / sum(w * w_slice * sim * sim) AS scale FROM ws JOIN sw USING (slice_id) WHERE v <> -1 AND simweight > 0.99{D}) SELECT stack_id, vx, vy, vz, round(CASE WHEN vol > 0 THEN vol * scale ELSE vol END, 5) + 0.0 AS vol FROM vol, k")
def volume_rescaled(spark, sf_dir):
    """The volume by the factor that fits it to the slices; positive values only."""
    chain = Chain(spark, sf_dir)
    pixels = chain.weighted()
    scale = robust.volume_scale(pixels.join(robust.slice_weights(robust.potentials(pixels))[0].drop("stack_id"), "slice_id")).first()[0]
    return rounded(chain.volume.select(*VOXEL, F.when(F.col("vol") > 0, F.col("vol") * scale).otherwise(F.col("vol")).alias("vol")), 5)


# Whole iterations


def _iteration(i: int) -> str:
    """SQL of one iteration from vol{i}, pix{i} (sim, w), sw{i} and numbers st{i} to those of i + 1."""
    ok = f"v <> -1 AND simweight > 0.99{D}"
    j = i + 1
    e = "(v * scale - sim)"
    return f"""sc{i} AS (SELECT slice_id, CASE WHEN sum(w * v * v) FILTER ({ok}) > 0 THEN sum(w * v * sim) FILTER ({ok}) / sum(w * v * v) FILTER ({ok}) ELSE 1 END AS scale FROM pix{i} GROUP BY 1),
ad{i} AS (SELECT co.stack_id, vx, vy, vz, sum(c * w * w_slice * (CASE WHEN sim > 0 THEN v * scale - sim ELSE 0 END)) AS addon, sum(c * w * w_slice) AS cmap FROM co JOIN pix{i} USING (slice_id, x, y) JOIN sw{i} USING (slice_id) JOIN sc{i} USING (slice_id) GROUP BY 1, 2, 3, 4),
su{i} AS MATERIALIZED (SELECT stack_id, vx, vy, vz, vol AS old, least(1100, greatest(0, vol + 0.8{D} * CASE WHEN coalesce(ad{i}.cmap, 0) > 0 THEN addon / ad{i}.cmap ELSE 0 END)) AS vol, coalesce(ad{i}.cmap, 0) AS cmap FROM vol{i} LEFT JOIN ad{i} USING (stack_id, vx, vy, vz)),
{_regular(f'su{i}', f'vol{j}', 0.05).replace('rn AS', f'rn{i} AS').replace('FROM rn ', f'FROM rn{i} ').replace('rs AS', f'rs{i} AS').replace('JOIN rs ', f'JOIN rs{i} ').replace(f'vol{j} AS (', f'vol{j} AS MATERIALIZED (')},
si{j} AS MATERIALIZED (SELECT stack_id, slice_id, x, y, sum(c * vol) / sum(c) AS sim, sum(c) AS simweight FROM co JOIN vol{j} USING (stack_id, vx, vy, vz) GROUP BY 1, 2, 3, 4),
pr{j} AS (SELECT si{j}.*, v, w, scale FROM si{j} JOIN (SELECT slice_id, x, y, v, w FROM pix{i}) USING (slice_id, x, y) JOIN sc{i} USING (slice_id)),
st{j} AS MATERIALIZED (SELECT greatest(sum({e} * {e} * w) / sum(w), 1e-8{D} / 6.28{D}) AS sigma, {'(SELECT mix FROM st0)' if i == 0 else 'sum(w) / count(*)'} AS mix, 1 / (max({e}) - min({e})) AS m FROM pr{j} WHERE {ok}),
pix{j} AS MATERIALIZED (SELECT stack_id, slice_id, x, y, v, sim, simweight, CASE WHEN {ok} THEN ({DENS(e, 'sigma')} * mix) / ({DENS(e, 'sigma')} * mix + m * 0.0001{D} * (1 - mix)) ELSE 0 END AS w FROM pr{j}, st{j}),
pot{j} AS (SELECT stack_id, slice_id, coalesce(sqrt(avg((1 - w) ** 2) FILTER ({ok})), -1) AS p FROM pix{j} GROUP BY 1, 2),
pw{j} AS (SELECT pot{j}.*, w_slice AS k FROM pot{j} JOIN sw{i} USING (slice_id)),
mn{j} AS (SELECT sum(p * k) / sum(k) AS mean, sum(p * (1 - k)) / sum(1 - k) AS mean2 FROM pw{j} WHERE p >= 0),
vr{j} AS (SELECT mean, mean2, greatest(sum((p - mean) ** 2 * k) / sum(k), 1e-8{D} / 6.28{D}) AS v1, greatest(sum((p - mean2) ** 2 * (1 - k)) / sum(1 - k), 1e-8{D} / 6.28{D}) AS v2 FROM pw{j}, mn{j} WHERE p >= 0 GROUP BY 1, 2),
gg{j} AS (SELECT stack_id, slice_id, p, mean, mean2, CASE WHEN p < mean2 THEN {DENS('p - mean', 'v1')} ELSE 0 END AS g1, CASE WHEN p > mean THEN {DENS('p - mean2', 'v2')} ELSE 0 END AS g2 FROM pw{j}, vr{j}), mi{j} AS (SELECT avg(w_slice) AS mix_s FROM sw{i} JOIN pot{i or ''} USING (slice_id) WHERE p >= 0),
sw{j} AS MATERIALIZED (SELECT stack_id, slice_id, CASE WHEN p < 0 THEN 0 WHEN mean2 <= mean THEN 1 WHEN g1 * mix_s + g2 * (1 - mix_s) > 0 THEN g1 * mix_s / (g1 * mix_s + g2 * (1 - mix_s)) WHEN p >= mean2 THEN 0 ELSE 1 END AS w_slice FROM gg{j}, mi{j})"""


LOOP = f"""{SLICEW}, vol0 AS (SELECT stack_id, vx, vy, vz, vol FROM vol), pix0 AS MATERIALIZED (SELECT stack_id, slice_id, x, y, v, sim, simweight, w FROM ws), sw0 AS MATERIALIZED (SELECT stack_id, slice_id, w_slice FROM sw), st0 AS (SELECT * FROM st), {_iteration(0)}, {_iteration(1)}""".replace("co AS (", "co AS MATERIALIZED (", 1)


@query(f"WITH {LOOP} SELECT stack_id, vx, vy, vz, round(vol, 3) + 0.0 AS vol FROM vol2")
def reconstruct_2iter(spark, sf_dir):
    """Two iterations with their state carried: scales, step and regulariser, simulation, M-step, E-step."""
    return rounded(Loop(spark, sf_dir).run(2).select(*VOXEL, "vol"), 3)


class Loop(Chain):
    """Iterations over volume, pixels and slices; each state is a written table, so lineage stays short."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.begin()

    def begin(self) -> None:
        """Pixels, weights and slices before the first step."""
        pixels = self.scratch.put(self.simulated(), "pixels")
        self.state = robust.initial(pixels)
        self.pixels = self.scratch.put(robust.weighted(pixels, self.state), "state0")
        slices, self.mix = robust.slice_weights(robust.potentials(self.pixels))
        self.slices = self.scratch.put(slices, "slices0")

    def step(self, i: int) -> None:
        """Iteration i, from 0."""
        scales = self.scratch.put(robust.slice_scales(self.pixels).select("slice_id", "scale"), f"scales{i}")
        of = self.slices.select("slice_id", "w_slice").join(scales, "slice_id")
        after = self.scratch.put(robust.super_resolved(self.seen, self.pixels.join(of, "slice_id"), self.volume, 0.8, 0.0, 1000.0), f"super{i}")
        self.volume = self.scratch.put(robust.regularised_step(after, self.volume, 100.0, 0.05, 10000.0), f"volume{i + 1}")
        simulated = pj.forward_projected(self.seen, self.volume.select(*VOXEL, "vol"))
        known = self.pixels.select("slice_id", "x", "y", "v", "w").join(scales, "slice_id")
        pixels = self.scratch.put(simulated.join(known, ["slice_id", "x", "y"]), f"simulated{i + 1}")
        e = robust.residual(F.col("scale"))
        self.state = robust.maximised(pixels, e, self.state["mix"] if i == 0 else None)
        self.pixels = self.scratch.put(robust.weighted(pixels, self.state, e).drop("scale"), f"state{i + 1}")
        potential = robust.potentials(self.pixels).join(self.slices.select("slice_id", F.col("w_slice").alias("prior")), "slice_id")
        slices, mix = robust.slice_weights(potential, self.mix, "prior")
        self.slices, self.mix = self.scratch.put(slices, f"slices{i + 1}"), mix
        self.scratch.drop(f"super{i}", f"simulated{i + 1}")

    def run(self, iterations: int) -> DataFrame:
        for i in range(iterations):
            self.step(i)
        return self.volume


@query(f"WITH {LOOP} SELECT slice_id, round(w_slice, 3) + 0.0 AS w_slice FROM sw1")
def slice_weights_second(spark, sf_dir):
    """Weights of slices after an iteration, from those before as priors."""
    loop = Loop(spark, sf_dir)
    loop.run(1)
    return rounded(loop.slices.select("slice_id", "w_slice"), 3)

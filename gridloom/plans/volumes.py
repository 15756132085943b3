"""Queries of registration to volumes: slices, stacks and patches, on table pixels laid under planted transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions import coords
from gridloom.operators import evaluation as ev, patches, points as pt, projection as pj, robust, scattered, template, tiles as tl, volume_registration as vr
from gridloom.plans.geometry import POINTS, points
from gridloom.plans.reconstruction import Loop
from gridloom.queries import KERNEL, KERNEL_SQL
from gridloom.registry import PX3, R, query, rounded
from gridloom.scratch import Scratch
from gridloom.sources import surrogate as sg

D = "::DOUBLE"
VOXEL = pj.VOXEL


def smooth_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stacks as volumes (key, vx, vy, vz, vol), smoothed along three axes."""
    rows = sg.px3(spark, sf_dir).select("stack_id", *[F.col(a).alias(f"v{a}") for a in "xyz"], F.col("v").cast("double").alias("v"), F.lit(1.0).alias("one"))
    return robust.smoothed_ratio(rows, KERNEL, "v", "one").select(F.col("stack_id").alias("key"), "vx", "vy", "vz", F.col("ratio").alias("vol"))


def planted(unit: Column, shift: float = 0.2, turn: float = 1.0) -> Column:
    """Fixed rigid parameters of a unit, to be found again."""
    parts = [(5, 2, shift), (3, 1, shift * 1.5), (4, -2, shift / 2), (5, 2, turn * 0.75), (7, 3, turn * 0.5), (9, 4, turn)]
    return F.array(*[((unit % n).cast("double") - middle) * by for n, middle, by in parts])


PLANTED = ", ".join(f"((slice_id % {n}){D} - {m}) * {b} AS {c}" for c, n, m, b in (("tx", 5, 2, 0.2), ("ty", 3, 1, repr(0.2 * 1.5)), ("tz", 4, -2, 0.1), ("rx", 5, 2, 0.75), ("ry", 7, 3, 0.5), ("rz", 9, 4, 1.0)))
ENTRIES = """cos(ay) * cos(az) AS m0, cos(ay) * sin(az) AS m1, -sin(ay) AS m2, tx AS m3, sin(ax) * sin(ay) * cos(az) - cos(ax) * sin(az) AS m4, sin(ax) * sin(ay) * sin(az) + cos(ax) * cos(az) AS m5, sin(ax) * cos(ay) AS m6, ty AS m7,
 cos(ax) * sin(ay) * cos(az) + sin(ax) * sin(az) AS m8, cos(ax) * sin(ay) * sin(az) - sin(ax) * cos(az) AS m9, cos(ax) * cos(ay) AS m10, tz AS m11"""


def moved_sql(x: str, y: str, z: str) -> str:
    return ", ".join(f"m{4 * r} * ({x}) + m{4 * r + 1} * ({y}) + m{4 * r + 2} * ({z}) + m{4 * r + 3} + {c} AS w{a}" for r, (a, c) in enumerate(zip("xyz", ("3.5", "3.5", "z"))))


def sampled_sql(name: str, of: str, keys: str) -> str:
    """Trilinear values sv.vol at wx, wy, wz of a table; null where a voxel that counts is missing."""
    w = " * ".join(f"(1 - abs(w{a} - floor(w{a}) - {b}))" for a, b in zip("xyz", "abc"))
    return f"""{name} AS (SELECT {keys}, CASE WHEN count(s.vol) = count(*) THEN sum(t * s.vol) END AS s FROM (SELECT *, CAST(floor(wx) AS INT) + a AS qx, CAST(floor(wy) AS INT) + b AS qy, CAST(floor(wz) AS INT) + c AS qz, {w} AS t
 FROM {of}, range(2) i(a), range(2) j(b), range(2) k(c)) e LEFT JOIN sv s ON s.stack_id = e.stack_id AND s.vx = qx AND s.vy = qy AND s.vz = qz WHERE t > 0 GROUP BY ALL)"""


SMOOTH = f"""{PX3}, sx AS (SELECT stack_id, x - k AS x, y, z, sum(v * w) AS n, sum(w) AS d FROM px3, {KERNEL_SQL} WHERE x - k BETWEEN 0 AND 7 GROUP BY ALL),
sy AS (SELECT stack_id, x, y - k AS y, z, sum(n * w) AS n, sum(d * w) AS d FROM sx, {KERNEL_SQL} WHERE y - k BETWEEN 0 AND 7 GROUP BY ALL),
dz AS (SELECT stack_id, max(z) AS most FROM px3 GROUP BY 1), sv AS (SELECT stack_id, x AS vx, y AS vy, z - k AS vz, sum(n * w) / sum(d * w) AS vol FROM sy JOIN dz USING (stack_id), {KERNEL_SQL} WHERE z - k BETWEEN 0 AND most + 4 GROUP BY ALL)"""
LAID = f"""{SMOOTH}, pp AS (SELECT DISTINCT slice_id, {PLANTED} FROM px3), pm AS (SELECT slice_id, {ENTRIES} FROM (SELECT *, radians(rx) AS ax, radians(ry) AS ay, radians(rz) AS az FROM pp)),
pt AS (SELECT slice_id, stack_id, x, y, z, {moved_sql('x - 3.5', 'y - 3.5', '0')} FROM px3 JOIN pm USING (slice_id)), {sampled_sql('laid', 'pt', 'slice_id, e.stack_id, x, y, z')}"""


def slice_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices as units in their stack's volume, about their own centre; v is still unknown."""
    lattice = [F.array(*[F.lit(float(c)) for c in a]) for a in ([i % 8 - 3.5 for i in range(64)], [i // 8 - 3.5 for i in range(64)], [0.0] * 64)]
    rows = sg.ranked(sg.blocks(spark, sf_dir))
    centre = F.array(F.lit(3.5), F.lit(3.5), F.col("z").cast("double"))
    return rows.select(F.col("slice_id").alias("unit"), F.col("slice_id").alias("image"), F.col("stack_id").alias("key"), *[a.alias(c) for a, c in zip(lattice, "xyz")], centre.alias("centre"), F.array(F.lit(None).cast("double")).alias("v"))


def laid(units: DataFrame, volume: DataFrame, p: Column, size: int, scratch: Scratch, at: Sequence[str] = ("vx", "vy", "vz")) -> DataFrame:
    """units with v, the volume's values under the parameters p."""
    posed = scratch.put(units.withColumn("p", p), "posed")
    values = tl.sampled(posed, scratch.put(tl.cut(volume, ["key"], at, "vol", size, 1), "volume-tiles"), size, bounds=tl.extent(volume, at, size))
    # Images' lattices are small in a file and large in memory.
    return scratch.put(vr.shuffled(posed.drop("v")).join(values, ["unit", "image"]), "laid")


SIZE = 16


@query(f"""WITH {LAID} SELECT slice_id, x, y, {R('s', 'v')} FROM laid""")
def lay_slices(spark, sf_dir):
    """Every slice taken from its stack's smoothed volume under a planted transformation; null where it leaves the volume."""
    images = laid(slice_units(spark, sf_dir), smooth_volume(spark, sf_dir), planted(F.col("unit")), SIZE, Scratch(spark))
    long = images.select(F.col("unit").alias("slice_id"), F.posexplode("v").alias("at", "v"))
    return rounded(long.select("slice_id", (F.col("at") % 8).alias("x"), F.floor(F.col("at") / 8).cast("int").alias("y"), "v"))


STEPS = ", ".join(f"({k}, " + ", ".join(str((0 if k == 0 else (1.0 if k % 2 else -1.0) * ((k - 1) // 2 == i))) + D for i in range(6)) + ")" for k in range(13))


@query(f"""WITH {LAID}, cp AS (SELECT k, tx, ty, tz, radians(rx) AS ax, radians(ry) AS ay, radians(rz) AS az FROM (VALUES {STEPS}) t(k, tx, ty, tz, rx, ry, rz)), cm AS (SELECT k, {ENTRIES} FROM cp),
ct AS (SELECT k, slice_id, stack_id, x, y, z, s AS v, {moved_sql('x - 3.5', 'y - 3.5', '0')} FROM laid, cm WHERE s IS NOT NULL), {sampled_sql('cv', 'ct', 'k, slice_id, e.stack_id, x, y, z, v')},
kn AS (SELECT slice_id, count(s) AS known FROM laid GROUP BY 1), ss AS (SELECT slice_id, k, count(s) AS n, corr(v, s) AS r FROM cv WHERE s IS NOT NULL GROUP BY 1, 2)
SELECT kn.slice_id, CAST(c.k AS INT) AS candidate, CASE WHEN coalesce(n, 0) < 8 OR n < 0.5 * known THEN -1.0 ELSE {R('coalesce(r, 0)', 'r').rsplit(' AS ', 1)[0]} END AS similarity FROM kn CROSS JOIN cm c LEFT JOIN ss ON ss.slice_id = kn.slice_id AND ss.k = c.k""")
def register_candidates(spark, sf_dir):
    """The similarity of every slice laid under a planted transformation with its volume, where it stands and a step to both sides of each parameter."""
    scratch = Scratch(spark)
    volume = scratch.put(smooth_volume(spark, sf_dir), "volume")
    images = laid(slice_units(spark, sf_dir), volume, planted(F.col("unit")), SIZE, scratch)
    zero = F.array(*[F.lit(0.0)] * 6)
    posed = images.withColumn("p", vr.sides(zero, F.array(*[F.lit(1.0)] * 6)))
    sims = vr.scored(posed, scratch.put(tl.cut(volume, ["key"], ["vx", "vy", "vz"], "vol", SIZE, vr.HALO), "tiles"), SIZE, 13)
    return rounded(sims.select(F.col("unit").alias("slice_id"), F.posexplode("sims").alias("candidate", "similarity")))


def found_again(images: DataFrame, volume: DataFrame, scratch: Scratch, name: str, size: int = SIZE) -> DataFrame:
    """unit, error_before, error_after (mean distance of the points to where they were planted), similarities and rounds; images hold p, as planted."""
    zero = F.array(*[F.lit(0.0)] * 6).alias("p")
    start = scratch.put(images.select("unit", zero, "centre").dropDuplicates(["unit"]), f"{name}-start")
    found = scratch.put(vr.registered(images, volume, start, scratch, size, name=name), f"{name}-found")
    true = images.select("unit", "p").dropDuplicates(["unit"])
    before, after = vr.distance(images, start, true), vr.distance(images, found, true)
    errors = before.select("unit", F.col("error").alias("error_before")).join(after.select("unit", F.col("error").alias("error_after")), "unit")
    return rounded(found.select("unit", F.col("first").alias("similarity_before"), F.col("last").alias("similarity_after"), "rounds").join(errors, "unit"))


@query()
def register_slices(spark, sf_dir):
    """All slices registered to their stacks' volumes at once; their planted transformations are found again."""
    scratch = Scratch(spark)
    volume = scratch.put(smooth_volume(spark, sf_dir), "volume")
    images = laid(slice_units(spark, sf_dir), volume, planted(F.col("unit")), SIZE, scratch)
    return found_again(images, volume, scratch, "slices").withColumnRenamed("unit", "slice_id")


def stack_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole stacks as units: an image a slice, about the stack's centre."""
    rows = sg.with_depth(slice_units(spark, sf_dir).withColumnRenamed("key", "stack_id").withColumn("z_of", F.get("centre", F.lit(2)).cast("int")).withColumn("slice_id", F.col("image")).withColumn("depth_z", F.col("z_of")).withColumn("z0", F.col("z")).drop("z").withColumn("z", F.col("z_of")))
    middle = (F.col("nz") - 1) / 2
    z = F.transform("z0", lambda _: F.col("z_of") - middle)
    return rows.select(F.col("stack_id").alias("unit"), "image", F.col("stack_id").alias("key"), "x", "y", z.alias("z"), F.array(F.lit(3.5), F.lit(3.5), middle).alias("centre"), "v")


@query()
def register_stacks(spark, sf_dir):
    """All stacks registered to templates at once: one transformation for all slices of a stack, found again."""
    scratch = Scratch(spark)
    volume = scratch.put(smooth_volume(spark, sf_dir), "volume")
    images = laid(stack_units(spark, sf_dir), volume, planted(F.col("unit"), 0.2, 0.4), SIZE, scratch)
    return found_again(images, volume, scratch, "stacks").withColumnRenamed("unit", "stack_id")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide volume of all slices: planes of 8 x 8 slices, as key, vx, vy, vz, v."""
    at = F.col("slice_id") % 64
    return sg.px(spark, sf_dir).select(
        F.lit(0).alias("key"), ((at % 8) * 8 + F.col("x")).cast("int").alias("vx"), (F.floor(at / 8) * 8 + F.col("y")).cast("int").alias("vy"), F.floor(F.col("slice_id") / 64).cast("int").alias("vz"), F.col("v").cast("double").alias("v")
    )


def smooth_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mosaic(spark, sf_dir).withColumnRenamed("key", "stack_id").withColumn("one", F.lit(1.0))
    return robust.smoothed_ratio(rows, KERNEL, "v", "one", 64, 64).select(F.col("stack_id").alias("key"), "vx", "vy", "vz", F.col("ratio").alias("vol"))


def patch_units(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """Patches of the mosaic's planes as units, about their own centres."""
    middle = (size - 1) / 2
    cut = patches.extracted(rows.select(F.col("vz").alias("slice_id"), F.col("vx").alias("x"), F.col("vy").alias("y")), 64, 64, size, stride)
    e = F.array_sort(F.collect_list(F.struct("y", "x")))
    own = cut.groupBy("slice_id", "px0", "py0").agg(e.alias("e"))
    unit = (F.col("slice_id") * 1_000_000 + F.col("py0") * 1_000 + F.col("px0")).cast("long")
    along = lambda c: F.transform("e", lambda s: s[c] - F.col(f"p{c}0") - middle)
    x, y = along("x"), along("y")
    centre = F.array(F.col("px0") + middle, F.col("py0") + middle, F.col("slice_id").cast("double"))
    return own.select(unit.alias("unit"), unit.alias("image"), F.lit(0).alias("key"), x.alias("x"), y.alias("y"), F.transform("e", lambda _: F.lit(0.0)).alias("z"), centre.alias("centre"), F.array(F.lit(None).cast("double")).alias("v"))


@query()
def register_patches(spark, sf_dir):
    """All overlapping patches registered at once to one volume that they share."""
    scratch = Scratch(spark)
    volume = scratch.put(smooth_mosaic(spark, sf_dir), "volume")
    images = laid(patch_units(mosaic(spark, sf_dir), 16, 8), volume, planted(F.floor(F.col("unit") / 1000) + F.col("unit") % 1000), 32, scratch)
    return found_again(images, volume, scratch, "patches", 32).withColumnRenamed("unit", "patch_id")


class Registering(Loop):
    """Reconstruction that registers every slice to the volume before each iteration.

    images: laid units, written; the first volume is made of those that meet
    first alone (the template's slices), where they stand.
    """

    def __init__(self, spark: SparkSession, images: DataFrame, first: Column):
        self.spark, self.images = spark, images
        own = images.select(F.col("key").alias("stack_id"), F.col("unit").alias("slice_id"), F.get("centre", F.lit(2)).alias("z"), F.col("v").alias("pixels"), first.alias("first"))
        depth = own.groupBy("stack_id").agg((F.max("z") + 1).cast("int").alias("nz"))
        self.blocks = Scratch(spark).put(own.join(depth, "stack_id"), "slices")
        self.poses = Scratch(spark).put(images.select("unit", F.array(*[F.lit(0.0)] * 6).alias("p"), "centre"), "poses")
        self.lay(F.col("first"))

    def lay(self, used: Column) -> None:
        """Coefficients, volume and first state of the slices in use, with the poses as they stand."""
        self.scratch = Scratch(self.spark)
        m = coords.rigid(*[F.get("p", F.lit(i)) for i in range(6)])
        # A unit turns about its own centre, coefficients about that of the stack's first plane.
        z = F.col("z")
        m[3], m[7], m[11] = m[3] - m[2] * z, m[7] - m[6] * z, m[11] + z - m[10] * z
        rows = self.blocks.filter(used).join(vr.shuffled(self.poses.select(F.col("unit").alias("slice_id"), "p")), "slice_id")
        self.seen = pj.seen_slices(rows, m, sg.PSF, (3.5, 3.5, 0.0), (sg.SIDE, sg.SIDE))
        self.seen.images = self.scratch.put(self.seen.images, "images")
        self.volume = self.scratch.put(pj.back_projected(self.seen), "volume")
        self.begin()

    def iterate(self, i: int) -> None:
        """Register all slices, then reconstruct: robust weights, scales, a step of super-resolution with the regulariser."""
        volume = self.volume.select(F.col("stack_id").alias("key"), *VOXEL[1:], "vol")
        found = vr.registered(self.images, volume, self.poses.select("unit", "p", "centre"), self.scratch, SIZE, rounds=6, name=f"loop{i}")
        self.poses = Scratch(self.spark).put(found, "poses")
        self.lay(F.lit(True))
        self.step(0)


@query()
def reconstruct_registering(spark, sf_dir):
    """Slices of two stacks through every volume: the template's stand right, the others lie under planted transformations.

    The first volume is the template's; then all slices are registered to it and
    the volume is reconstructed from all of them. By slice: its mean distance to
    where it was planted before and after, its similarity and its weight.
    """
    scratch = Scratch(spark)
    volume = scratch.put(smooth_volume(spark, sf_dir), "volume")
    copies = slice_units(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    units = copies.withColumn("unit", F.col("unit") * 2 + F.col("copy")).withColumn("image", F.col("unit")).drop("copy")
    template = F.col("unit") % 2 == 0
    true = F.transform(planted(F.col("unit")), lambda x: F.when(template, 0.0).otherwise(x))
    images = laid(units, volume, true, SIZE, scratch)
    loop = Registering(spark, images, template)
    out = scratch.put(vr.distance(images, loop.poses, images).withColumnRenamed("error", "error0"), "error0")
    loop.iterate(0)
    after = vr.distance(images, loop.poses, images).withColumnRenamed("error", "error1")
    state = loop.poses.select("unit", F.col("last").alias("similarity")).join(loop.slices.select(F.col("slice_id").alias("unit"), "w_slice"), "unit")
    return rounded(out.join(after, "unit").join(state, "unit").select(F.col("unit").alias("slice_id"), template.alias("template"), "error0", "error1", "similarity", "w_slice"))


# Scattered samples


def _b(t: str) -> list[str]:
    return [f"(1 - {t}) ** 3 / 6", f"(3 * {t} ** 3 - 6 * {t} ** 2 + 4) / 6", f"(-3 * {t} ** 3 + 3 * {t} ** 2 + 3 * {t} + 1) / 6", f"{t} ** 3 / 6"]


def _spread(n: int, of: str, spacing: float, keep: str) -> str:
    """Rows of the 64 control points of each sample of a table, with basis value and norm."""
    low = ", ".join(f"CAST(floor(w{a} / {spacing}) AS INT) AS l{a}, w{a} / {spacing} - floor(w{a} / {spacing}) AS f{a}" for a in "xyz")
    lists = ", ".join(f"[{', '.join(_b('f' + a))}] AS q{a}" for a in "xyz")
    norm = " * ".join(f"list_sum(list_transform(q{a}, lambda b: b * b))" for a in "xyz")
    return f"""g{n} AS (SELECT *, {lists} FROM (SELECT *, {low} FROM {of})), e{n} AS MATERIALIZED (SELECT {keep}, stack_id, lx + i - 1 AS cx, ly + j - 1 AS cy, lz + k - 1 AS cz, qx[i + 1] * qy[j + 1] * qz[k + 1] AS b, {norm} AS norm
 FROM g{n}, range(4) t(i), range(4) u(j), range(4) v(k))"""


OFFSETS = "(VALUES (-2, 0.125::DOUBLE), (-1, 0.5::DOUBLE), (0, 0.75::DOUBLE), (1, 0.5::DOUBLE), (2, 0.125::DOUBLE))"


@query(f"""WITH {PX3}, pp AS (SELECT DISTINCT slice_id, {PLANTED} FROM px3), pm AS (SELECT slice_id, {ENTRIES} FROM (SELECT *, radians(rx) AS ax, radians(ry) AS ay, radians(rz) AS az FROM pp)),
pt AS (SELECT slice_id * 64 + y * 8 + x AS id, stack_id, v{D} AS r, {moved_sql('x - 3.5', 'y - 3.5', '0')} FROM px3 JOIN pm USING (slice_id)),
{_spread(1, 'pt', 4.0, 'id, r, wx, wy, wz')}, c1 AS (SELECT stack_id, cx, cy, cz, sum(r * b ** 3 / norm) / sum(b * b) AS c FROM e1 WHERE b > 0 GROUP BY ALL),
pt2 AS (SELECT id, stack_id, wx, wy, wz, any_value(r) - sum(b * coalesce(c, 0)) AS r FROM e1 LEFT JOIN c1 USING (stack_id, cx, cy, cz) GROUP BY ALL),
{_spread(2, 'pt2', 2.0, 'id, r')}, c2 AS (SELECT stack_id, cx, cy, cz, sum(r * b ** 3 / norm) / sum(b * b) AS c FROM e2 WHERE b > 0 GROUP BY ALL),
tt AS (SELECT stack_id, cx, cy, cz, sum(c) AS c FROM (SELECT stack_id, 2 * cx + i AS cx, 2 * cy + j AS cy, 2 * cz + k AS cz, c * w1 * w2 * w3 AS c FROM c1, {OFFSETS} p(i, w1), {OFFSETS} q(j, w2), {OFFSETS} r(k, w3) UNION ALL SELECT * FROM c2) GROUP BY ALL),
vx AS (SELECT stack_id, x AS ix, y AS iy, z AS iz, x{D} AS wx, y{D} AS wy, z{D} AS wz FROM px3), {_spread(3, 'vx', 2.0, 'ix, iy, iz')}
SELECT stack_id, ix AS x, iy AS y, iz AS z, {R('sum(b * coalesce(c, 0))', 'v')} FROM e3 LEFT JOIN tt USING (stack_id, cx, cy, cz) GROUP BY ALL""")
def scattered_bspline(spark, sf_dir):
    """All slices' pixels, where fixed transformations take them, as scattered samples of each stack's volume: two levels of B-splines, read on the voxels."""
    scratch = Scratch(spark)
    pixels = sg.blocks(spark, sf_dir).select(F.col("slice_id").alias("unit"), F.transform("pixels", lambda v: v.cast("double")).alias("v"))
    units = slice_units(spark, sf_dir).drop("v")
    coefficients, spacing = scattered.approximated(units.join(pixels, "unit").withColumn("p", planted(F.col("unit"))), 4.0, 2, scratch)
    lattice = units.withColumn("v", F.transform("x", lambda _: F.lit(0.0))).withColumn("p", F.array(*[F.lit(0.0)] * 6))
    values = scattered.evaluated(scattered.dealt(lattice, 16.0), coefficients, spacing, 16.0)
    long = values.select("key", F.explode(F.arrays_zip("x", "y", "z", "s")).alias("e"))
    return rounded(long.select(F.col("key").alias("stack_id"), *[F.round(f"e.{a}").cast("int").alias(a) for a in "xyz"], F.col("e.s").alias("v")))


# Point sets


def label_map(label: Column) -> Column:
    """A fixed affine map near the identity for a label."""
    n = lambda k, by, less=0: ((label % k).cast("double") - less) * by
    zero = F.lit(0.0)
    rows = [[1 + n(3, 0.02), n(2, 0.01), zero, n(3, 0.05, 1)], [-n(4, 0.01), 1 - n(5, 0.01), zero, n(5, 0.04, 2)], [zero, n(3, 0.015), 1 + n(2, 0.02), n(2, 0.03)]]
    return F.array(*[c for r in rows for c in r])


_l = lambda k, by, less=0: f"((stack_id % {k}){D} - {less}) * {by}"
LABEL_MAP = [f"1 + {_l(3, 0.02)}", _l(2, 0.01), "0.0", _l(3, 0.05, 1), f"-{_l(4, 0.01)}", f"1 - {_l(5, 0.01)}", "0.0", _l(5, 0.04, 2), "0.0", _l(3, 0.015), f"1 + {_l(2, 0.02)}", _l(2, 0.03)]


@query(f"WITH {POINTS} SELECT DISTINCT stack_id, {', '.join(R(c, f'm{i}') for i, c in enumerate(LABEL_MAP))} FROM pts")
def align_points_iteratively(spark, sf_dir):
    """Each label's points onto a copy under a planted affine map, by nearest points and alignment in turn: the map is found to six places."""
    own = points(spark, sf_dir)
    copy = pt.moved(own, own.select("stack_id").distinct().withColumn("m", label_map(F.col("stack_id"))), "stack_id")
    found = pt.iterated(own, copy.select("stack_id", (F.col("id") + 1_000_000).alias("id"), "x", "y", "z"), "stack_id", 0.5, Scratch(spark))
    return rounded(found.select("stack_id", *[F.get("m", F.lit(i)).alias(f"m{i}") for i in range(12)]))


# Evaluation


@query(f"""WITH {SMOOTH}, ab AS (SELECT px3.stack_id, x, y, z, v{D} AS a, vol AS b FROM px3 JOIN sv ON sv.stack_id = px3.stack_id AND vx = x AND vy = y AND vz = z),
w AS (SELECT p.stack_id, p.x, p.y, p.z, avg(q.a) AS ma, avg(q.b) AS mb, var_pop(q.a) AS va, var_pop(q.b) AS vb, covar_pop(q.a, q.b) AS cov FROM ab p JOIN ab q ON p.stack_id = q.stack_id AND abs(p.x - q.x) <= 2 AND abs(p.y - q.y) <= 2 AND q.z BETWEEN p.z - 2 AND p.z + 2 GROUP BY 1, 2, 3, 4),
s AS (SELECT stack_id, avg((2 * ma * mb + {ev.C1}{D}) * (2 * cov + {ev.C2}{D}) / ((ma * ma + mb * mb + {ev.C1}{D}) * (va + vb + {ev.C2}{D}))) AS ssim FROM w GROUP BY 1),
g AS (SELECT stack_id, count(*) AS n, avg((a - b) ** 2) AS mse, max(a) AS top, corr(a, b) AS cc, avg(a) AS mean_a, avg(b) AS mean_b, var_pop(a) AS variance_a, var_pop(b) AS variance_b FROM ab GROUP BY 1)
SELECT stack_id, n, {R('mse', 'mse')}, {R('20 * log10(top) - 10 * log10(mse)', 'psnr')}, {R('cc', 'cc')}, {R('mean_a', 'mean_a')}, {R('mean_b', 'mean_b')}, {R('variance_a', 'variance_a')}, {R('variance_b', 'variance_b')}, {R('ssim', 'ssim')}, {R('(1 - ssim) / 2', 'dssim')} FROM g JOIN s USING (stack_id)""")
def evaluate_volumes(spark, sf_dir):
    """Every stack as a volume against its smoothed form, in three dimensions: error, correlation and local similarity."""
    true = sg.px3(spark, sf_dir).select(F.col("stack_id").alias("key"), *[F.col(a).alias(f"v{a}") for a in "xyz"], F.col("v").alias("vol"))
    made = ev.compared(true, smooth_volume(spark, sf_dir), "key", ["vx", "vy", "vz"])
    return rounded(made.withColumnRenamed("key", "stack_id"))


# The template


@query(f"WITH {PX3}, r AS (SELECT stack_id, min(v){D} AS lo, max(v){D} AS hi, max(z) + 1 AS nz FROM px3 GROUP BY 1), t AS (SELECT stack_id, x, y, z, (v - lo) / (hi - lo) AS v FROM px3 JOIN r USING (stack_id) WHERE z < nz // 3) SELECT p.stack_id, p.z AS a, q.z AS b, {R('sum(p.v * q.v)', 'g')} FROM t p JOIN t q ON q.stack_id = p.stack_id AND q.x = p.x AND q.y = p.y GROUP BY 1, 2, 3")
def motion_grams(spark, sf_dir):
    """Products of all pairs of slices of each stack's first third."""
    return rounded(template.grams(sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))))


@query()
def template_choice(spark, sf_dir):
    """Every stack's motion score, and the one that serves as template."""
    return rounded(template.chosen(template.scores(sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir))))))

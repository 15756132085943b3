"""Queries of patches and the volume: init, back-projection, simulation, robust statistics and super-resolution by patch."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.scalars import FWHM
from gridloom.operators import patch_volume as pv, projection as pj, robust
from gridloom.plans.reconstruction import SUPER, _regular
from gridloom.plans.volumes import ENTRIES, PLANTED, planted
from gridloom.queries import COEFF, SIMULATED, SLICEW, VOLUME, Chain
from gridloom.registry import R, query, rounded
from gridloom.scratch import Scratch
from gridloom.sources import surrogate as sg

D = "::DOUBLE"
VOXEL = pj.VOXEL
#: Edge and stride of patches, the mask's bound, and pixel size and thickness of a slice.
EDGE, STRIDE, BOUND, SPACING = 4, 2, 400, (1.0, 1.0, 2.0)

_s = [1.2 * SPACING[0] / FWHM, 1.2 * SPACING[1] / FWHM, SPACING[2] / FWHM]
INIT = f"""raw AS (SELECT vec_id AS slice_id, label AS stack_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(floor(500 * (CAST(embedding[i + 1] AS DOUBLE) + 1)) AS INT) AS v FROM embeddings, range(64) t(i)),
rk AS (SELECT vec_id AS slice_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS z FROM embeddings), pz AS (SELECT raw.*, z FROM raw JOIN rk USING (slice_id)),
dep AS (SELECT stack_id, max(z) + 1 AS nz FROM pz GROUP BY 1), pa AS (SELECT slice_id * 100 + b * 10 + a AS slice_id, stack_id, x - a AS x, y - b AS y, x AS ix, y AS iy, z, v FROM pz, (VALUES (0), (2)) i(a), (VALUES (0), (2)) j(b) WHERE x BETWEEN a AND a + 3 AND y BETWEEN b AND b + 3),
pp AS (SELECT DISTINCT slice_id, {PLANTED} FROM pa), pm AS (SELECT slice_id, {ENTRIES} FROM (SELECT *, radians(rx) AS ax, radians(ry) AS ay, radians(rz) AS az FROM pp)),
pw AS (SELECT pa.*, pm.* EXCLUDE (slice_id), {', '.join(f'm{4 * r} * (ix - 3.5) + m{4 * r + 1} * (iy - 3.5) + m{4 * r + 3} + {c} AS w{a}' for r, (a, c) in enumerate(zip('xyz', ('3.5', '3.5', 'z'))))} FROM pa JOIN pm USING (slice_id)),
px AS MATERIALIZED (SELECT pw.slice_id, pw.stack_id, pw.x, pw.y, CASE WHEN k.v > {BOUND} THEN pw.v ELSE -1 END AS v FROM pw LEFT JOIN pz k ON k.stack_id = pw.stack_id AND k.x = floor(wx) AND k.y = floor(wy) AND k.z = floor(wz))"""
_reach = f"range({-((pv.SUPPORT - 1) // 2)}, {pv.SUPPORT - (pv.SUPPORT - 1) // 2})"
_back = ", ".join(f"m{r} * (vx - 3.5 - m3) + m{4 + r} * (vy - 3.5 - m7) + m{8 + r} * (vz - z - m11) - {o} AS d{a}" for r, (a, o) in enumerate(zip("xyz", ("(ix - 3.5)", "(iy - 3.5)", "0"))))
PATCH_COEFF = f"""{INIT}, sp AS (SELECT slice_id, stack_id, x, y, vx, vy, vz, exp(-dx * dx / {2 * _s[0] ** 2!r}{D} - dy * dy / {2 * _s[1] ** 2!r}{D} - dz * dz / {2 * _s[2] ** 2!r}{D}) AS p FROM (SELECT *, {_back} FROM (SELECT pw.*, nz, CAST(round(wx) + i AS INT) AS vx, CAST(round(wy) + j AS INT) AS vy, CAST(round(wz) + k AS INT) AS vz
 FROM pw JOIN dep USING (stack_id), {_reach} t(i), {_reach} u(j), {_reach} q(k)) WHERE vx BETWEEN 0 AND 7 AND vy BETWEEN 0 AND 7 AND vz BETWEEN 0 AND nz - 1)),
cs AS (SELECT sp.*, p / sum(p) OVER (PARTITION BY sp.slice_id, sp.x, sp.y) AS c FROM sp JOIN px USING (slice_id, x, y) WHERE p >= {pv.LEAST} AND v <> -1),
co AS MATERIALIZED (SELECT cs.stack_id, cs.slice_id, cs.x, cs.y, vx, vy, vz, c FROM cs JOIN pz k ON k.stack_id = cs.stack_id AND k.x = vx AND k.y = vy AND k.z = vz AND k.v > {BOUND})"""


def on_patches(sql: str) -> str:
    """The SQL of a step on slices, with the coefficients of patches."""
    return PATCH_COEFF + sql.removeprefix(COEFF)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.px3(spark, sf_dir).filter(F.col("v") > BOUND).select(F.col("stack_id").alias("key"), *[F.col(a).alias(f"v{a}") for a in "xyz"])


def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of all slices, each under a fixed transformation of its own, cut from whole images without a shuffle."""
    images = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))
    firsts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for b in range(0, sg.SIDE - EDGE, STRIDE) for a in range(0, sg.SIDE - EDGE, STRIDE)])
    rows = images.withColumn("f", F.explode(firsts))
    place = F.sequence(F.lit(0), F.lit(EDGE * EDGE - 1))
    ix, iy = (lambda i: i % EDGE + F.col("f.a")), (lambda i: F.floor(i / EDGE).cast("int") + F.col("f.b"))
    unit = (F.col("slice_id") * 100 + F.col("f.b") * 10 + F.col("f.a")).alias("unit")
    made = rows.select(
        unit, F.col("stack_id").alias("key"), F.lit(EDGE).alias("width"), F.col("nz").alias("depth"), F.transform(place, lambda i: ix(i) - 3.5).alias("x"), F.transform(place, lambda i: iy(i) - 3.5).alias("y"), F.transform(place, lambda i: F.lit(0.0)).alias("z"),
        F.transform(place, lambda i: F.get("pixels", iy(i) * sg.SIDE + ix(i)).cast("double")).alias("v"), F.array(F.lit(3.5), F.lit(3.5), F.col("z").cast("double")).alias("centre"),
    )
    return made.withColumn("p", planted(F.col("unit")))


class PatchChain(Chain):
    """What the steps on patches read again and again, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.scratch = Scratch(spark)
        inside = self.scratch.put(mask(spark, sf_dir), "mask")
        self.patches = self.scratch.put(pv.initial(patch_rows(spark, sf_dir), inside), "patches")
        self.seen = pv.seen_patches(self.patches, (sg.SIDE, sg.SIDE), partial(pv.gaussian, spacing=SPACING), most=pv.extents(pv.gaussian, SPACING))
        # Shares sum to 1 before the mask; its voxels are all that the volume has, so nothing else is met again.
        self.volume = self.scratch.put(pv.in_mask(pj.back_projected(self.seen), inside), "volume")


@query(f"WITH {INIT} SELECT slice_id AS patch_id, x, y, v FROM px")
def patch_init(spark, sf_dir):
    """Pixels of every patch, -1 where its transformation takes them out of the mask."""
    rows = pv.initial(patch_rows(spark, sf_dir), mask(spark, sf_dir))
    long = rows.select(F.col("unit").alias("patch_id"), F.posexplode("v").alias("at", "v"))
    return long.select("patch_id", (F.col("at") % EDGE).alias("x"), F.floor(F.col("at") / EDGE).cast("int").alias("y"), F.coalesce("v", F.lit(-1.0)).cast("int").alias("v"))


@query(f"WITH {on_patches(VOLUME)} SELECT stack_id, vx, vy, vz, {R('vol', 'vol')}, {R('volw', 'volw')} FROM vol")
def patch_back_project(spark, sf_dir):
    """The volume of all patches, each voxel the mean of the pixels that it sees by their shares."""
    return rounded(PatchChain(spark, sf_dir).volume)


@query(f"WITH {on_patches(SIMULATED)} SELECT slice_id AS patch_id, x, y, {R('sim', 'sim')}, {R('simweight', 'simweight')} FROM sm")
def patch_simulate(spark, sf_dir):
    """Every patch's pixels as the volume would have them."""
    return rounded(PatchChain(spark, sf_dir).simulated().select(F.col("slice_id").alias("patch_id"), "x", "y", "sim", "simweight"))


@query(f"WITH {on_patches(SLICEW)} SELECT slice_id AS patch_id, round(potential, 5) + 0.0 AS potential, round(w_slice, 4) + 0.0 AS weight FROM sw")
def patch_robust_statistics(spark, sf_dir):
    """Potential and weight of every patch, from its pixels' posterior weights."""
    slices = robust.slice_weights(robust.potentials(PatchChain(spark, sf_dir).weighted()))[0]
    return slices.select(F.col("slice_id").alias("patch_id"), (F.round("potential", 5) + 0.0).alias("potential"), (F.round("w_slice", 4) + 0.0).alias("weight"))


@query(f"WITH {on_patches(SUPER)}, {_regular('su', 'rg')} SELECT stack_id, vx, vy, vz, round(vol, 4) + 0.0 AS vol, {R('cmap', 'cmap')} FROM rg")
def patch_super_resolution(spark, sf_dir):
    """A step along the patches' residuals, by their weights and scales, then the regulariser."""
    chain = PatchChain(spark, sf_dir)
    pixels = chain.weighted()
    of = robust.slice_weights(robust.potentials(pixels))[0].select("slice_id", "w_slice").join(robust.slice_scales(pixels).select("slice_id", "scale"), "slice_id")
    after = chain.scratch.put(robust.super_resolved(chain.seen, pixels.join(of, "slice_id"), chain.volume, 0.8, 0.0, 1000.0, (EDGE, EDGE * EDGE)), "super")
    out = robust.regularised_step(after, chain.volume, delta=100.0, alpha=0.05, lam=100000.0)
    return rounded(out.select(*VOXEL, F.round("vol", 4).alias("vol"), "cmap"))

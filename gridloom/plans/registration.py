"""Queries of registration and patches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators import kernels, patches, projection as pj, registration as reg
from gridloom.queries import GRID, GRID_SQL, PAIRS, pair_pixels
from gridloom.registry import PX, R, query, rounded
from gridloom.scratch import Scratch
from gridloom.sources import surrogate as sg

D = "::DOUBLE"


def blob(shape: tuple[int, int, int]):
    """A smooth test image as a function of the world's coordinates, without symmetry."""

    def f(x, y, z):
        return 100 * np.exp(-((x - 1) ** 2) / 18 - (y + 1) ** 2 / 10 - z**2 / 14) + 60 * np.exp(-((x + 3) ** 2) / 6 - (y - 2) ** 2 / 8 - (z - 2) ** 2 / 9) + 40 * np.exp(-((x - 2) ** 2) / 8 - (y - 3) ** 2 / 5 - (z + 2) ** 2 / 6)

    grid = np.stack(np.meshgrid(*[np.arange(n) - (n - 1) / 2 for n in reversed(shape)], indexing="ij"), -1).transpose(2, 1, 0, 3)
    return f, grid


POSES = "SELECT s_suppkey, (s_suppkey % 3 - 1)::DOUBLE AS tx, (s_suppkey % 2) * 0.5::DOUBLE AS ty, (s_suppkey % 5 - 2) * 0.5::DOUBLE AS tz, (s_suppkey % 4 - 1) * 2.0::DOUBLE AS rz FROM supplier WHERE s_suppkey <= 8"


def _known(spark, sf_dir, run, columns: str):
    i = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    rows = sg.table(spark, sf_dir, "supplier").filter("s_suppkey <= 8").select("s_suppkey", d(i % 3 - 1).alias("tx"), (d(i % 2) * 0.5).alias("ty"), (d(i % 5 - 2) * 0.5).alias("tz"), (d(i % 4 - 1) * 2.0).alias("rz"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([run(r) for r in f.to_dict("records")], columns=[c.split()[0] for c in columns.split(", ")])

    return rows.repartition(8, "s_suppkey").mapInPandas(each, columns)


def _pose(r: dict) -> np.ndarray:
    return np.array([r["tx"], r["ty"], r["tz"], 0.0, 0.0, r["rz"]])


def _images(p: np.ndarray):
    """Target and source: the target is the smooth image at the places to which p takes the source's lattice."""
    f, grid = blob((12, 14, 16))
    m = reg.matrix(p)
    return f(*np.moveaxis(grid @ m[:, :3].T + m[:, 3], -1, 0)), f(*np.moveaxis(grid, -1, 0))


def _near(v: float, step: float) -> float:
    return float(np.round(v / step) * step) + 0.0


@query(POSES)
def register_rigid_3d(spark, sf_dir):
    """Known poses found again from images, to half a place and two degrees."""
    preset = reg.Preset(metric="CC", levels=2, steps=5, length=1.0, epsilon=1e-7, rounds=40)

    def run(r):
        p, _, _ = reg.registered(*_images(_pose(r)), preset)
        return (r["s_suppkey"], _near(p[0], 0.5), _near(p[1], 0.5), _near(p[2], 0.5), _near(p[5], 2.0))

    return _known(spark, sf_dir, run, "s_suppkey long, tx double, ty double, tz double, rz double")


@query("SELECT s_suppkey, (s_suppkey % 3 - 1)::DOUBLE AS tx, 100.0 + (s_suppkey % 2) * 8.0::DOUBLE AS sx, TRUE AS better FROM supplier WHERE s_suppkey <= 8")
def register_affine_3d(spark, sf_dir):
    """Known shifts and a known stretch found again, to a place and four percent."""
    preset = reg.Preset(metric="SSD", levels=1, steps=4, length=2.0, epsilon=1e-6, rounds=60)

    def run(r):
        p = np.array([r["tx"], 0, 0, 0, 0, 0, 100.0 + (r["s_suppkey"] % 2) * 8, 100, 100, 0, 0, 0])
        q, before, after = reg.registered(*_images(p), preset, affine=True)
        return (r["s_suppkey"], _near(q[0], 1.0), _near(q[6], 4.0), after >= before)

    return _known(spark, sf_dir, run, "s_suppkey long, tx double, sx double, better boolean")


@query(" UNION ALL ".join(f"SELECT s_suppkey, '{n}' AS optimiser, {R('(s_suppkey % 7) - 3.0', 'p0')}, {R('(s_suppkey % 5) * 0.5', 'p1')} FROM supplier" for n in reg.OPTIMISERS))
def optimisers(spark, sf_dir):
    """Each optimiser on a target whose top is known, to a tenth; suppliers of one top have one target, which is optimised once."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a, b in zip(f["a"], f["b"]):
                top = np.array([a - 3.0, b * 0.5])
                target = lambda p, t=top: -float((p[0] - t[0]) ** 2 + 2 * (p[1] - t[1]) ** 2 + 0.5 * (p[0] - t[0]) * (p[1] - t[1]))
                for name in reg.OPTIMISERS:
                    p, gain, change = reg.optimised(target, np.zeros(2), name, 1.0, 8, 200, 1e-9)
                    assert gain >= 0 and change <= 10
                    rows.append((a, b, name, *(float(np.round(v, 1)) + 0.0 for v in p)))
            yield pd.DataFrame(rows, columns=["a", "b", "optimiser", "p0", "p1"])

    key = F.col("s_suppkey")
    own = sg.table(spark, sf_dir, "supplier").select(key.cast("long").alias("s_suppkey"), F.pmod(key, F.lit(7)).cast("long").alias("a"), F.pmod(key, F.lit(5)).cast("long").alias("b"))
    found = own.select("a", "b").distinct().repartition(8, "a", "b").mapInPandas(each, "a long, b long, optimiser string, p0 double, p1 double")
    return rounded(own.join(F.broadcast(found), ["a", "b"]).select("s_suppkey", "optimiser", "p0", "p1"))


SHIFTS = [(k, s) for k in ("x", "y") for s in (1, -1)]


@query(f"""WITH {PX}, m AS (SELECT stack_id, x, y, avg(v) AS m FROM px GROUP BY 1, 2, 3), c AS (SELECT * FROM (VALUES ('x', 1, 1, 0), ('x', -1, -1, 0), ('y', 1, 0, 1), ('y', -1, 0, -1)) t(dof, sign, dx, dy)),
s AS (SELECT p.slice_id, dof, sign, corr(m.m, q.v) AS cc FROM px p JOIN m ON m.stack_id = p.stack_id AND m.x = p.x AND m.y = p.y, c, px q WHERE q.slice_id = p.slice_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3),
g AS (SELECT slice_id, sum(cc * sign) FILTER (dof = 'x') AS gx, sum(cc * sign) FILTER (dof = 'y') AS gy, max(cc) AS best FROM s GROUP BY 1)
SELECT slice_id, {R('gx / sqrt(gx * gx + gy * gy)', 'gx')}, {R('gy / sqrt(gx * gx + gy * gy)', 'gy')}, {R('best', 'best')} FROM g""")
def registration_gradient(spark, sf_dir):
    """All slices at once against their stack's mean: the similarity of each shifted candidate, the unit gradient, and the best one."""
    images = sg.blocks(spark, sf_dir)
    at = images.select("stack_id", F.posexplode("pixels").alias("at", "v")).groupBy("stack_id", "at").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = at.groupBy("stack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))
    return rounded(kernels.candidate_shifts(images.join(mean, "stack_id"), 8))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p.metric}', {p.bins}, {p.levels}, {p.length}{D}, {'NULL' if p.padding is None else p.padding}{D}, {p.rounds})" for k, p in reg.PRESETS.items()) + ") t(preset, metric, bins, levels, length, padding, rounds)")
def registration_presets(spark, sf_dir):
    rows = [(k, p.metric, p.bins, p.levels, p.length, p.padding, p.rounds) for k, p in reg.PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, metric string, bins int, levels int, length double, padding double, rounds int")


# Patches


OVER = f"{PX}, q AS (SELECT slice_id, stack_id, x, y, v, CAST(a * 2 - 4 AS INT) AS px0, CAST(b * 2 - 4 AS INT) AS py0 FROM px, range(6) i(a), range(6) j(b) WHERE x >= a * 2 - 4 AND x < a * 2 AND y >= b * 2 - 4 AND y < b * 2)"


@query(f"WITH {OVER} SELECT * FROM q")
def patch_extract_over(spark, sf_dir):
    """Patches that may lie over the image's edge."""
    return patches.extracted(sg.px(spark, sf_dir), 8, 8, 4, 2, over=True).select("slice_id", "stack_id", "x", "y", "v", "px0", "py0")


@query(f"WITH {OVER}, n AS (SELECT stack_id, slice_id, px0, py0, count(*) AS n FROM q GROUP BY ALL) SELECT n.stack_id, count(*) AS num_patches, count(*) * 16 AS total_pixels, max(s.n) AS stack_pixels, sum(n.n)::BIGINT AS patch_pixels, {R('count(*) * 16.0 / max(s.n)', 'overhead_ratio')} FROM n JOIN (SELECT stack_id, count(*) AS n FROM px GROUP BY 1) s USING (stack_id) GROUP BY 1")
def patch_report(spark, sf_dir):
    """Counts of patches and pixels by stack, and how often a pixel is held."""
    rows = sg.px(spark, sf_dir)
    n = patches.extracted(rows, 8, 8, 4, 2, over=True).groupBy("stack_id", "slice_id", "px0", "py0").agg(F.count("*").alias("n")).groupBy("stack_id").agg(F.count("*").alias("num_patches"), F.sum("n").alias("patch_pixels"))
    s = rows.groupBy("stack_id").agg(F.count("*").alias("stack_pixels"))
    total = F.col("num_patches") * 16
    return rounded(n.join(s, "stack_id").select("stack_id", "num_patches", total.alias("total_pixels"), "stack_pixels", "patch_pixels", (total / F.col("stack_pixels")).alias("overhead_ratio")))


@query(f"WITH {PX} SELECT slice_id, 0 AS px0, 0 AS py0, count(*) AS n, {R('avg(v)', 'mean')} FROM px GROUP BY 1")
def full_slice_patches(spark, sf_dir):
    return rounded(sg.px(spark, sf_dir).groupBy("slice_id").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("mean")).select("slice_id", F.lit(0).alias("px0"), F.lit(0).alias("py0"), "n", "mean"))


@query("SELECT * FROM (VALUES (0, 32, 16), (1, 28, 14), (2, 24, 12), (3, 20, 10)) t(iteration, size, stride)")
def patch_schedule(spark, sf_dir):
    return spark.createDataFrame(patches.schedule(32, 16, 4), "iteration int, size int, stride int")


C1, C2 = 6.5025, 58.5225


@query(f"""WITH {PAIRS}, q AS (SELECT slice_id, a, b, CAST(i * 2 AS INT) AS px0, CAST(j * 2 AS INT) AS py0 FROM pairs, range(2) t(i), range(2) u(j) WHERE x >= i * 2 AND x < i * 2 + 4 AND y >= j * 2 AND y < j * 2 + 4),
s AS (SELECT slice_id, px0, py0, count(*) AS n, max(a) AS m, avg((a - b) ** 2) AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov FROM q GROUP BY 1, 2, 3), t AS (SELECT *, (2 * ma * mb + {C1}{D}) * (2 * cov + {C2}{D}) / ((ma * ma + mb * mb + {C1}{D}) * (va + vb + {C2}{D})) AS ssim FROM s)
SELECT slice_id, px0, py0, n, {R('CASE WHEN mse > 0 THEN 20 * log10(m) - 10 * log10(mse) END', 'psnr')}, {R('ssim', 'ssim')}, {R('(1 - ssim) / 2', 'dssim')}, {R('ma', 'mean_a')}, {R('mb', 'mean_b')}, {R('va', 'variance_a')}, {R('vb', 'variance_b')}, {R('cov', 'covariance')}, {R('mse', 'mse')} FROM t""")
def patch_evaluation(spark, sf_dir):
    """Patches of each slice against the same patches of the stack's first."""
    return rounded(patches.evaluated(patches.extracted(pair_pixels(spark, sf_dir), 8, 8, 4, 2), ["slice_id", "px0", "py0"]))


@query(f"""WITH {PAIRS}, k AS (SELECT stack_id, min(slice_id) AS f, max(slice_id) AS l FROM px GROUP BY 1), s AS (SELECT p.stack_id, count(*) AS n, avg((a - b) ** 2) AS mse, max(a) AS m, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov FROM pairs p JOIN k ON k.stack_id = p.stack_id AND slice_id = l GROUP BY 1)
SELECT stack_id, n, {R('CASE WHEN mse > 0 THEN 20 * log10(m) - 10 * log10(mse) END', 'psnr')}, {R(f'(2 * ma * mb + {C1}{D}) * (2 * cov + {C2}{D}) / ((ma * ma + mb * mb + {C1}{D}) * (va + vb + {C2}{D}))', 'ssim')}, {R('mse', 'mse')} FROM s""")
def baseline_evaluation(spark, sf_dir):
    """The last slice of each stack against its first, before any reconstruction."""
    pairs = pair_pixels(spark, sf_dir)
    last = sg.blocks(spark, sf_dir).groupBy("stack_id").agg(F.max("slice_id").alias("slice_id")).select("slice_id")
    return rounded(patches.evaluated(pairs.join(last, "slice_id", "left_semi"), ["stack_id"]).select("stack_id", "n", "psnr", "ssim", "mse"))


SLIC2 = f"""{PX}, c0 AS (SELECT slice_id, label, x{D} AS cx, y{D} AS cy, v{D} AS cv, 100.0{D} AS most FROM px JOIN {GRID_SQL} ON x = gx AND y = gy)"""


def _round(i: int, d: str) -> str:
    return f"""d{i} AS (SELECT px.slice_id, px.x, px.y, v, label, (v - cv) ** 2 AS dv, {d} AS d FROM px JOIN c{i} c ON c.slice_id = px.slice_id AND x >= floor(greatest(0, cx - 4)) AND x < floor(cx + 4) AND y >= floor(greatest(0, cy - 4)) AND y < floor(cy + 4)),
a{i} AS (SELECT slice_id, x, y, v, label, dv FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, x, y ORDER BY d, label) AS k FROM d{i}) WHERE k = 1),
c{i + 1} AS (SELECT a.slice_id, a.label, avg(a.x) AS cx, avg(a.y) AS cy, avg(a.v) AS cv, greatest(max(dv), max(most)) AS most FROM a{i} a JOIN c{i} c ON c.slice_id = a.slice_id AND c.label = a.label GROUP BY 1, 2)"""


FIXED = f"(v - cv) ** 2 + ((x - cx) ** 2 + (y - cy) ** 2) * 100.0{D}"
ADAPTIVE = f"(v - cv) ** 2 / most + ((x - cx) ** 2 + (y - cy) ** 2) / 16.0{D}"


@query(f"WITH {SLIC2}, {', '.join(_round(i, FIXED) for i in range(3))} SELECT slice_id, x, y, label FROM a2")
def superpixels(spark, sf_dir):
    """Three rounds of superpixels."""
    return patches.slic(sg.px(spark, sf_dir), 8, 8, 4, 40.0, 3, Scratch(spark)).filter("label IS NOT NULL").select("slice_id", "x", "y", "label")


@query(f"WITH {SLIC2}, {', '.join(_round(i, ADAPTIVE) for i in range(3))} SELECT slice_id, x, y, label FROM a2")
def superpixels_adaptive(spark, sf_dir):
    """Three rounds in which each centre counts values by the largest difference that it had."""
    return patches.slic(sg.px(spark, sf_dir), 8, 8, 4, 40.0, 3, Scratch(spark), adaptive=True).filter("label IS NOT NULL").select("slice_id", "x", "y", "label")


@query(f"WITH {SLIC2}, {_round(0, FIXED)} SELECT slice_id, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM a0 GROUP BY 1, 2 HAVING max(x) - min(x) >= 4 AND max(y) - min(y) >= 4")
def superpixel_boxes(spark, sf_dir):
    """Boxes of superpixels that are wide enough."""
    rows = sg.px(spark, sf_dir)
    labelled = patches.assigned(rows, patches.seeded(rows, GRID), 4, 40.0).filter("label IS NOT NULL")
    return patches.boxes(labelled, 4)


@query(f"WITH {SLIC2}, {_round(0, FIXED)} SELECT p.slice_id, s.label, p.x, p.y, max(CAST(q.label = s.label AS INT)) AS m FROM px p JOIN a0 q ON q.slice_id = p.slice_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1, range(4) s(label) WHERE s.label IN (SELECT label FROM {GRID_SQL}) GROUP BY 1, 2, 3, 4 HAVING m = 1")
def superpixel_dilation(spark, sf_dir):
    """Pixels of each superpixel and those beside it."""
    rows = sg.px(spark, sf_dir)
    labelled = patches.assigned(rows, patches.seeded(rows, GRID), 4, 40.0).filter("label IS NOT NULL")
    around = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("p")
    grown = labelled.select("slice_id", F.col("label").cast("long").alias("label"), around).select("slice_id", "label", "p.x", "p.y").filter("x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7").distinct()
    return grown.withColumn("m", F.lit(1))


@query(f"WITH {PX} SELECT slice_id, count(DISTINCT v // 50) >= 1 AS some, TRUE AS whole FROM px GROUP BY 1")
def superpixel_connectivity(spark, sf_dir):
    """Labels renewed so that each hangs together; small parts join a neighbour. Every label is then one part, but for what joined."""
    images = sg.blocks(spark, sf_dir).select("slice_id", F.transform("pixels", lambda v: F.floor(v / 50).cast("int")).alias("pixels"))

    def each(image: np.ndarray) -> np.ndarray:
        out = patches.connected(image.astype(int), 0)
        parts = sum(len(np.unique(kernels.components(image == k))) - ((image != k).any()) for k in np.unique(image))
        return np.array([len(np.unique(out)) >= 1, len(np.unique(out)) == parts])

    made = kernels.per_image(images, each, 8)
    return made.select("slice_id", (F.get("pixels", F.lit(0)) == 1).alias("some"), (F.get("pixels", F.lit(1)) == 1).alias("whole"))

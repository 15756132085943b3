"""Images and volumes: what sums over their relation works it out where it is, and gives what the table of it gives."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import plans, scratch
from gridloom.operators import patch_volume as pv, projection as pj, registration, stencils, tiles as tl

SF = "/root/testdata/sf0.001"


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): tuple(v for k, v in r.asDict().items() if k not in keys) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(got) > 20
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def slices(spark):
    rng = np.random.default_rng(4)
    maps = [registration.matrix(np.array([*rng.uniform(-1, 1, 3), *rng.uniform(-9, 9, 3)])).ravel().tolist() for _ in range(40)]
    rows = [(i % 2, i, i // 2, 20, [None if (i + k) % 11 == 0 else float(i + k * k) for k in range(9)], m) for i, m in enumerate(maps)]
    images = spark.createDataFrame(rows, "stack_id int, slice_id long, z int, nz int, pixels array<double>, m array<double>").repartition(3)
    how = ([F.get("m", F.lit(k)) for k in range(12)], [(dx, dy, dz, 0.1 + 0.02 * dx) for dx in (-1, 0, 1) for dy in (0, 1) for dz in (-1, 0)], (1.0, 1.0, 0.0), (3, 3))
    return pj.coefficients(images, *how).filter("NOT isnan(v)"), pj.seen_slices(images, *how)


def patches(spark):
    rng = np.random.default_rng(5)
    place = [(float(x), float(y)) for y in range(3) for x in range(2)]
    rows = [(k, k % 2, 2, 30, [a for a, _ in place], [b for _, b in place], [0.0] * 6, [None if (k + j) % 7 == 0 else float(k * j) for j in range(6)], rng.uniform(-3, 3, 6).tolist(), [3.0, 3.0, float(k % 30)]) for k in range(40)]
    df = spark.createDataFrame(rows, "unit long, key int, width int, depth int, x array<double>, y array<double>, z array<double>, v array<double>, p array<double>, centre array<double>")
    how = ((8, 8), partial(pv.gaussian, spacing=(1.0, 1.0, 2.0)))
    return pv.coefficients(df, *how), pv.seen_patches(df, *how, most=pv.extents(pv.gaussian, (1.0, 1.0, 2.0)))


@pytest.mark.parametrize("make", [slices, patches])
def test_sums_are_those_of_the_table(spark, monkeypatch, make):
    """By voxel and by pixel, over tiles and parts smaller than the volume, with pixels that aren't known."""
    for name, value in (("EDGE", 4), ("SLAB", 3), ("SUMS", 200), ("SAMPLES", 500)):
        monkeypatch.setattr(pj, name, value)
    monkeypatch.setattr(pv, "HELD", 2000)
    table, seen = make(spark)
    voxels = table.groupBy(*pj.VOXEL).agg(F.sum(F.col("c") * F.col("v")).alias("v"), F.sum("c").alias("c"))
    same(rows_of(seen.spread(), *pj.VOXEL), rows_of(voxels, *pj.VOXEL))
    volume = voxels.select(*pj.VOXEL, (F.col("v") / F.col("c")).alias("vol")).filter("(vx + vy + vz) % 5 <> 0")
    met = table.join(volume, pj.VOXEL).groupBy("stack_id", *pj.PIXEL, "v").agg(F.sum(F.col("c") * F.col("vol")).alias("s"), F.sum("c").alias("c"))
    same(rows_of(seen.gathered(volume), *pj.PIXEL), rows_of(met, *pj.PIXEL))


@pytest.mark.parametrize("name, count, pixels", [("patch_robust_statistics", 2000, 2000 * 16), ("reconstruct_registering", 1000, 1000 * 64)])
def test_no_table_of_coefficients(spark, monkeypatch, name, count, pixels):
    """No table that is written has more rows than there are pixels."""
    put, written = scratch.Scratch.put, {}

    def counted(self, df, name):
        made = put(self, df, name)
        written[name] = made.count()
        return made

    monkeypatch.setattr(scratch.Scratch, "put", counted)
    assert plans.queries()[name](spark, SF).count() == count
    assert "volume" in written and max(written.values()) <= pixels


def test_regulariser_over_tiles(spark, monkeypatch):
    """Against a plain sum over 26 neighbours, on tiles of two voxels; a voxel isn't sent to each neighbour."""
    monkeypatch.setattr(stencils, "TILE", 2)
    rng = np.random.default_rng(1)
    rows = [("a", x, y, z, *map(float, rng.uniform(0, 50, 2)), float(rng.uniform(0, 3) * (rng.random() > 0.2))) for x in range(4) for y in range(3) for z in range(-1, 4) if rng.random() > 0.15]
    df = spark.createDataFrame(rows, "k string, x int, y int, z int, v double, o double, c double")
    made = stencils.regularised(df, ["k"], 10.0, 0.05, 1000.0, weights="o")
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    at, want, k = {r[1:4]: r[4:] for r in rows}, {}, 0.05 * 1000.0 / 100.0
    for p, (v, o, c) in at.items():
        s = w = total = 0.0
        for d in [(i, j, l) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1) if (i, j, l) != (0, 0, 0)]:
            q = at.get(tuple(np.add(p, d)))
            if q and q[2] > 0 and c > 0:
                f = 1 / np.abs(d).sum()
                b = f / np.sqrt(1 + ((q[1] - o) * np.sqrt(f) / 10) ** 2)
                s, w, total = s + b * q[0] * q[2], w + b * q[2], total + b
        below = c + k * (w - total * c)
        want["a", *p] = ((v * c + k * (s - total * v * c)) / below if below > 0 else 0.0,)
    same(rows_of(made, "k", "x", "y", "z"), want)


@pytest.mark.parametrize("units", ["slice_units", "stack_units"])
def test_lattices_are_not_broadcast(spark, monkeypatch, units):
    """Images of equal lattices are small in files; neither they nor what they see of a volume is sent to the driver."""
    from gridloom.plans import volumes
    from gridloom.scratch import Scratch

    put, plan = Scratch.put, {}

    def kept(self, df, name):
        plan[name] = df._jdf.queryExecution().executedPlan().toString()
        return put(self, df, name)

    monkeypatch.setattr(Scratch, "put", kept)
    made = volumes.laid(getattr(volumes, units)(spark, SF), volumes.smooth_volume(spark, SF), volumes.planted(F.col("unit")), 16, Scratch(spark))
    assert made.count() == 500 and "SortMergeJoin" in plan["laid"] and "BroadcastExchange" not in plan["laid"]


def test_only_tiles_with_voxels_are_asked_for(spark):
    """A place beyond the voxels has no value, so an image goes to no tile there, and its values are the same."""
    rng = np.random.default_rng(7)
    voxels = spark.createDataFrame([(0, x, y, z, float(rng.random())) for x in range(6) for y in range(5) for z in range(9)], "key int, vx int, vy int, vz int, vol double")
    rows = [(i, i, 0, *rng.uniform(-4, 4, (3, 12)).tolist(), [0.0] * 12, rng.uniform(-2, 2, 6).tolist(), [2.0, 2.0, 4.0]) for i in range(20)]
    images = spark.createDataFrame(rows, tl.IMAGE.format(unit="long", key="int") + ", p array<double>, centre array<double>")
    tiles, bounds = tl.cut(voxels, ["key"], ["vx", "vy", "vz"], "vol", 4, 1), tl.extent(voxels, ["vx", "vy", "vz"], 4)
    assert bounds == ([0, 0, 0], [1, 1, 2]) and tl.extent(voxels.limit(0), ["vx"] * 3, 4) == ([0] * 3, [-1] * 3)
    least = tl.seen(images, 4, bounds)
    assert least.filter("tx < 0 OR ty < 0 OR tz < 0 OR tx > 1 OR ty > 1 OR tz > 2").isEmpty() and least.count() < tl.seen(images, 4).count()
    every, some = ({r["unit"]: r["v"] for r in tl.sampled(images, tiles, 4, bounds=b).collect()} for b in (None, bounds))
    assert every == some and any(v is not None for a in some.values() for v in a)

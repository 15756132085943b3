"""Registration to volumes: planted transformations are found again, within stated errors, on table pixels."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import plans
from gridloom.operators import evaluation, patch_volume, points, registration, scattered, template, tiles as tl, volume_registration as vr
from gridloom.scratch import Scratch
from gridloom.sources import codecs, image_folder, surrogate as sg

SF = "/root/testdata/sf0.001"


def errors(spark, name):
    rows = plans.queries()[name](spark, SF).toPandas()
    assert (rows["similarity_after"] >= rows["similarity_before"] - 1e-9).all()
    return rows


def test_slices_are_found_again(spark):
    rows = errors(spark, "register_slices")
    assert len(rows) == 500 and rows["error_before"].mean() > 0.5
    assert rows["error_after"].mean() < 0.01 and (rows["error_after"] < 0.05).mean() > 0.98


def test_stacks_are_found_again(spark):
    rows = errors(spark, "register_stacks")
    assert len(rows) == 10 and rows["error_before"].min() > 0.3 and rows["error_after"].max() < 0.005


def test_patches_are_found_again(spark):
    rows = errors(spark, "register_patches")
    assert len(rows) == 8 * 36 and rows["error_after"].max() < 0.02


def test_registration_in_the_loop(spark):
    """From the template's volume alone, slices that lie elsewhere come nearer to where they belong, and the template's stay near."""
    rows = plans.queries()["reconstruct_registering"](spark, SF).toPandas()
    other, template = rows[~rows["template"]], rows[rows["template"]]
    assert len(rows) == 1000 and template["error0"].max() == 0
    assert other["error1"].median() < 0.5 * other["error0"].median() and template["error1"].median() < 0.3


def cube_image(spark, volume, size, p, rows):
    nz, ny, nx = volume.shape
    voxels = [(0, x, y, z, float(volume[z, y, x])) for z in range(nz) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(voxels, "key int, vx int, vy int, vz int, vol double"), spark.createDataFrame(rows, "unit long, image long, key int, x array<double>, y array<double>, z array<double>, v array<double>, p array<double>, centre array<double>")


@pytest.mark.parametrize("size", [4, 7, 64])
def test_tiles_sample_as_a_whole_volume(spark, size):
    rng = np.random.default_rng(size)
    volume = rng.random((9, 11, 13))
    points = rng.uniform(-8, 8, (60, 3))
    p, c = [0.7, -1.2, 0.4, 10.0, -20.0, 35.0], [6.0, 5.0, 4.0]
    voxels, images = cube_image(spark, volume, size, p, [(5, 1, 0, *points.T.tolist(), [0.0] * 60, p, c)])
    got = tl.sampled(images, tl.cut(voxels, ["key"], ["vx", "vy", "vz"], "vol", size, 1), size).first()["v"]
    m = registration.matrix(np.array(p))
    w = points @ m[:, :3].T + m[:, 3] + np.array(c)
    want = registration.sampled(volume, *w.T)
    assert all((a is None and np.isnan(b)) or abs(a - b) < 1e-12 for a, b in zip(got, want)) and np.isnan(want).any() and not np.isnan(want).all()


def test_units_without_a_match_stay(spark):
    volume = np.add.outer(np.add.outer(np.arange(5.0) ** 2, np.arange(6.0)), np.sin(np.arange(7.0)))
    lattice = [[float(a) for a in r] for r in (np.tile([-1, 0, 1], 3), np.repeat([-1, 0, 1], 3), np.zeros(9))]
    good = [float(volume[2, 2 + int(y), 3 + int(x)]) for x, y, _ in zip(*lattice)]
    none, flat = [None] * 9, [3.0] * 9
    rows = [(1, 1, 0, *lattice, good, None, [3.0, 2.0, 2.0]), (2, 2, 0, *lattice, none, None, [3.0, 2.0, 2.0]), (3, 3, 0, *lattice, flat, None, [3.0, 2.0, 2.0]), (4, 4, 0, *lattice, good, None, [90.0, 2.0, 2.0]), (5, 5, 9, *lattice, good, None, [3.0, 2.0, 2.0])]
    voxels, images = cube_image(spark, volume, 4, None, rows)
    start = images.select("unit", F.array(*[F.lit(0.0)] * 6).alias("p"), "centre")
    got = {r["unit"]: r for r in vr.registered(images, voxels, start, Scratch(spark), 4).collect()}
    assert len(got) == 5 and abs(got[1]["last"] - 1) < 1e-9
    assert [got[u]["last"] for u in (2, 4, 5)] == [-1.0] * 3 and all(got[u]["p"] == [0.0] * 6 for u in (2, 4, 5)) and got[3]["last"] == 0.0
    assert vr.registered(images.limit(0), voxels, start.limit(0), Scratch(spark), 4).count() == 0


def test_scattered_samples_meet_a_smooth_field(spark):
    """Levels come nearer to the samples; an empty table gives no coefficients."""
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 30, (3000, 3))
    v = np.sin(points[:, 0] / 4) + np.cos(points[:, 1] / 5) * points[:, 2] / 10
    rows = [(k, k, 0, *points[k::6].T.tolist(), v[k::6].tolist(), [0.0] * 6, [0.0] * 3) for k in range(6)]
    rows.append((9, 9, 0, [1.0], [1.0], [1.0], [None], [0.0] * 6, [0.0] * 3))
    _, images = cube_image(spark, np.zeros((1, 1, 1)), 4, None, rows)
    left = []
    for levels in (1, 2, 3):
        scratch = Scratch(spark)
        coefficients, spacing = scattered.approximated(images, 8.0, levels, scratch)
        met = scattered.evaluated(scattered.dealt(images, 16.0), coefficients, spacing, 16.0)
        e = np.concatenate([np.array(r["r"]) - np.array(r["s"]) for r in met.collect()])
        assert len(e) == 3000
        left.append(float(np.sqrt((e**2).mean())))
    assert left[2] < 0.5 * left[1] < 0.25 * left[0]
    none, _ = scattered.approximated(images.limit(0), 8.0, 2, Scratch(spark))
    assert none.count() == 0
    # A control point's shares in the next level keep the spline.
    one = spark.createDataFrame([(0, 2, 2, 2, 1.0)], "key int, cx int, cy int, cz int, c double")
    place = images.limit(1).withColumn("x", F.array(F.lit(7.3))).withColumn("y", F.array(F.lit(8.9))).withColumn("z", F.array(F.lit(6.1))).withColumn("v", F.array(F.lit(0.0)))
    a, b = (scattered.evaluated(scattered.dealt(place, 16.0), c, s, 16.0).first()["s"][0] for c, s in ((one, 4.0), (scattered.subdivided(one), 2.0)))
    assert a > 0 and abs(a - b) < 1e-12


def test_local_similarity_is_that_of_windows():
    rng = np.random.default_rng(4)
    a, b = rng.random((5, 6, 7)) * 200, rng.random((5, 6, 7)) * 200
    a[2, 3, 4] = np.nan
    got = evaluation.local_ssim(a, b, 1)
    assert np.isnan(got[2, 3, 4]) and np.isnan(got).sum() == 1
    for z, y, x in ((0, 0, 0), (2, 3, 3), (4, 5, 6), (1, 2, 3)):
        w = tuple(slice(max(0, k - 1), k + 2) for k in (z, y, x))
        ok = ~np.isnan(a[w])
        u, v = a[w][ok], b[w][ok]
        want = (2 * u.mean() * v.mean() + evaluation.C1) * (2 * np.cov(u, v, bias=True)[0, 1] + evaluation.C2) / ((u.mean() ** 2 + v.mean() ** 2 + evaluation.C1) * (u.var() + v.var() + evaluation.C2))
        assert abs(got[z, y, x] - want) < 1e-9


def test_template_by_singular_values(spark):
    images = sg.with_depth(sg.ranked(sg.blocks(spark, SF)))
    got = {r["stack_id"]: r for r in template.chosen(template.scores(images)).collect()}
    stacks = images.toPandas().sort_values("z").groupby("stack_id")
    want = {}
    for k, f in stacks:
        m = np.stack(f["pixels"].to_list()).astype(float)
        m = (m - m.min()) / (m.max() - m.min())
        s = np.linalg.svd(m[: len(m) // 3], compute_uv=False)
        share = [np.sqrt((s[:r] ** 2).sum() / (s**2).sum()) for r in range(len(s))]
        want[k] = max((r * x for r, x in enumerate(share) if x < 0.99), default=0.0)
    assert all(abs(got[k]["score"] - want[k]) < 1e-9 for k in want)
    assert [k for k, r in got.items() if r["template"]] == [min(want, key=lambda k: (want[k], k))]
    short = images.filter("z < 2").drop("nz")
    rows = template.chosen(template.scores(sg.with_depth(short))).collect()
    assert {r["score"] for r in rows} == {0.0} and sum(r["template"] for r in rows) == 1 and min(r["stack_id"] for r in rows if r["template"]) == min(r["stack_id"] for r in rows)


def test_point_sets_rigid_and_affine(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(-3, 3, (80, 3))
    m = registration.matrix(np.array([0.05, -0.04, 0.03, 1.0, -0.8, 0.6]))
    q = p @ m[:, :3].T + m[:, 3]
    make = lambda a: spark.createDataFrame([(g, i, *map(float, r)) for g in (1, 2) for i, r in enumerate(a)], "g int, id long, x double, y double, z double")
    for affine in (True, False):
        for r in points.iterated(make(p), make(q), "g", 0.5, Scratch(spark), affine=affine).collect():
            assert np.abs(np.array(r["m"]) - m.ravel()).max() < 1e-9 and r["distance"] < 1e-9
    assert points.iterated(make(p[:0]), make(q), "g", 0.5, Scratch(spark)).count() == 0


def test_patch_shares(spark):
    """Shares of a pixel sum to 1 over the voxels that exist, for either point spread; unknown pixels have none."""
    row = [(7, 0, 2, 5, [-0.5, 0.5], [0.0, 0.0], [0.0, 0.0], [10.0, None], [0.2, 0.1, 0.3, 2.0, -1.0, 5.0], [3.5, 3.5, 2.0])]
    rows = spark.createDataFrame(row, "unit long, key int, width int, depth int, x array<double>, y array<double>, z array<double>, v array<double>, p array<double>, centre array<double>")
    for spread in (partial(patch_volume.gaussian, spacing=(1.0, 1.0, 2.0)), partial(patch_volume.bartlett, spacing=(1.0, 1.0, 2.0))):
        got = patch_volume.coefficients(rows, (8, 8), spread).collect()
        assert {(r["slice_id"], r["x"], r["y"], r["v"]) for r in got} == {(7, 0, 0, 10.0)} and abs(sum(r["c"] for r in got) - 1) < 1e-12
        best = max(got, key=lambda r: r["c"])
        assert (best["vx"], best["vy"]) == (3, 4) and best["vz"] in (2, 3) and all(0 <= r["vx"] < 8 and 0 <= r["vy"] < 8 and 0 <= r["vz"] < 5 for r in got)
    assert patch_volume.coefficients(rows.limit(0), (8, 8), patch_volume.gaussian).count() == 0


def test_image_folder(spark, tmp_path):
    image_folder.register(spark)
    path = str(tmp_path / "folder")
    rows = [(f"a/s{i}{e}", 2, 2, 1, 1, 1.0, 1.0, 2.0, 1.0, [0.0] * 3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], "i2", [1.0 * i, 2.0, 3.0, 4.0]) for i in range(20) for e in (".nii.gz", ".gipl")]
    df = spark.createDataFrame(rows, codecs.SCHEMA).repartition(5)
    df.write.format("image_folder").mode("append").save(path)
    back = spark.read.format("image_folder").option("filesPerPartition", "3").load(path)
    assert back.rdd.getNumPartitions() == 14
    assert {(r["path"], tuple(r["pixels"])) for r in back.collect()} == {(r[0], tuple(r[-1])) for r in rows}
    df.limit(3).write.format("image_folder").mode("overwrite").save(path)
    assert spark.read.format("image_folder").load(path).count() == 3 and not (tmp_path / "folder" / "_temporary").exists()
    bad = df.withColumn("voxel_type", F.when(F.col("path").contains("s7"), "no such type").otherwise(F.col("voxel_type")))
    with pytest.raises(Exception):
        bad.write.format("image_folder").mode("append").save(path)
    assert spark.read.format("image_folder").load(path).count() == 3 and not (tmp_path / "folder" / "_temporary").exists()
    empty = str(tmp_path / "none")
    df.limit(0).write.format("image_folder").mode("append").save(empty)
    assert spark.read.format("image_folder").load(empty).count() == 0

import gzip
import struct

import numpy as np
import pytest

from gridloom.operators import kernels as k
from gridloom.sources import codecs as c
from gridloom.streaming import ingest


def test_nifti_round_trip(spark, tmp_path):
    row = c.image((4, 3, 2), (1.5, 2.0, 3.0), "i2", np.arange(24), (10.0, -4.0, 2.5), (0, 1, 0, 1, 0, 0, 0, 0, -1))
    (tmp_path / "a.nii").write_bytes(c.write_nifti(row))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(c.write_nifti(row)))
    got = c.scan(spark, str(tmp_path), "*.nii*").collect()
    assert len(got) == 2
    for r in got:
        assert (r["nx"], r["ny"], r["nz"], r["voxel_type"]) == (4, 3, 2, "i2")
        assert r["pixels"] == list(map(float, range(24)))
        assert np.allclose(r["origin"], row["origin"], atol=1e-5) and np.allclose(r["axes"], row["axes"], atol=1e-6)
    again = c.encoded(c.scan(spark, str(tmp_path), "a.nii")).first()["content"]
    assert bytes(again) == c.write_nifti(row)
    assert c.millilitres(c.scan(spark, str(tmp_path), "a.nii")).first()["ml"] == int(23 * 9 / 1000)


def test_frames(spark, tmp_path):
    (tmp_path / "t.nii").write_bytes(c.write_nifti(c.image((2, 2, 1, 3), (1, 1, 1, 2), "f4", np.arange(12))))
    got = {r["t"]: r["pixels"] for r in c.frames_of(c.scan(spark, str(tmp_path), "t.nii")).collect()}
    assert got == {t: [4.0 * t + i for i in range(4)] for t in range(3)}


def test_grey_maps_and_unknown_files():
    row = c.image((3, 2), (1, 1), "f8", [0, 1, 2, 3, 4, 5])
    assert list(c.decode(c.write_pgm(row))["pixels"]) == [0, 51, 102, 153, 204, 255]
    assert list(c.decode(b"P2\n# note\n2 2\n9\n1 2\n3 4\n")["pixels"]) == [1, 2, 3, 4]
    vtk = b"# vtk DataFile Version 2.0\nx\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 2 2 1\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA 4\nSCALARS s short 1\nLOOKUP_TABLE default\n1 2 3 4\n"
    assert list(c.decode(vtk)["pixels"]) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        c.decode(b"nothing known")


def test_transformations(spark, tmp_path):
    row = dict(zip(("tx", "ty", "tz", "rx", "ry", "rz"), (1.0, -2.0, 3.5, 4.0, 5.0, -6.0)))
    (tmp_path / "transformation7.dof").write_bytes(c.write_dof(row))
    got = c.scan_transformations(spark, str(tmp_path)).first().asDict()
    assert got == {"slice_id": 7} | row
    assert struct.unpack(">I", c.write_dof(row)[:4])[0] == 815007


def test_closed_form_points():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(9, 3))
    a = np.radians(33)
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    got, t = k.rigid_points(p, p @ r.T + [1, 2, 3])
    assert np.allclose(got, r) and np.allclose(t, [1, 2, 3])


def test_spline_and_median_and_distance():
    image = np.random.default_rng(2).normal(size=(6, 7))
    b = k.spline_coefficients(image)
    pad = np.pad(b, 1, "reflect")
    w = [1 / 6, 2 / 3, 1 / 6]
    back = sum(w[i] * w[j] * pad[i : i + 6, j : j + 7] for i in range(3) for j in range(3))
    assert np.allclose(back, image)
    assert k.weighted_median(np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 5.0])) == 2.0
    mask = np.zeros((5, 5), bool)
    mask[1, 2] = True
    y, x = np.mgrid[:5, :5]
    assert np.allclose(k.distances(mask), np.hypot(y - 1, x - 2)) and np.allclose(k.distances(mask, city=True), abs(y - 1) + abs(x - 2))


def test_components_in_any_order():
    mask = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 1, 0]], bool)
    assert k.components(mask).tolist() == [[0, -1, 0], [0, 0, 0], [-1, -1, -1], [9, 9, -1]]
    assert k.largest_component(mask).sum() == 5


def test_spectral_embedding_parts_two_groups():
    a = np.block([[np.ones((4, 4)), np.full((4, 4), 0.01)], [np.full((4, 4), 0.01), np.ones((4, 4))]])
    v = k.embedding(a, 1)[:, 0]
    assert len(set(np.sign(v[:4]))) == 1 and np.sign(v[0]) != np.sign(v[4])


def test_stream_of_slices(spark, tmp_path):
    stream = ingest.running_means(ingest.slices(spark, "/root/testdata/sf0.001/embeddings.parq*"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    from pyspark.sql import functions as F

    from gridloom.sources.surrogate import px

    want = {r["stack_id"]: round(r["m"], 6) for r in px(spark, "/root/testdata/sf0.001").groupBy("stack_id").agg(F.avg("v").alias("m")).collect()}
    assert {r["stack_id"]: round(r["mean"], 6) for r in spark.table("means").collect()} == want


def test_blur_and_diffusion_keep_the_sum_and_narrow_the_range():
    image = np.random.default_rng(3).normal(size=(8, 8)) * 50
    for f in (k.fourier_blur(1.0), k.diffusion(5, 40.0)):
        out = f(image)
        assert np.isclose(out.sum(), image.sum()) and np.ptp(out) < np.ptp(image)
    assert np.allclose(k.nonlocal_median(1, 1e9)(image)[1:-1, 1:-1], [[np.median(image[y - 1 : y + 2, x - 1 : x + 2]) for x in range(1, 7)] for y in range(1, 7)])


def test_still_stack_has_no_motion(spark):
    rows = [(s * 10 + i, s, [float(v * (1 + i * (s == 0))) for v in range(64)] if s == 0 else np.random.default_rng(i).normal(size=64).tolist()) for s in (0, 1) for i in range(9)]
    got = {r["stack_id"]: r for r in k.motion_scores(spark.createDataFrame(rows, "slice_id long, stack_id int, pixels array<double>")).collect()}
    assert got[0]["rank"] == 1 and got[0]["score"] < 1e-6 < got[1]["score"] + got[1]["rank"] - 1

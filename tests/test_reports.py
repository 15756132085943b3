"""Logs by run and histogram files: round trips, runs begun again, empty and foreign files."""

import pytest
from pyspark.errors import PySparkException

from gridloom.sources import reports


def test_log_keeps_other_runs_and_replaces_its_own(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "slice_id long, psnr double, stack int, iteration int"
    rows = lambda *r: spark.createDataFrame(list(r), "slice_id long, psnr double")
    reports.logged(rows((1, 2.5), (2, None), (2, None)), path, stack=0, iteration=0)
    reports.logged(rows((1, 3.5)), path, stack=0, iteration=1)
    reports.logged(rows((1, 4.5), (3, 0.1)), path, stack=0, iteration=1)
    reports.logged(rows(), path, stack=0, iteration=1)
    reports.logged(rows((9, 1 / 3)), path, stack=1, iteration=0)
    got = sorted((r["stack"], r["iteration"], r["slice_id"], r["psnr"]) for r in reports.read_log(spark, path, schema).fillna(-1.0, ["psnr"]).collect())
    assert got == [(0, 0, 1, 2.5), (0, 0, 2, -1.0), (0, 0, 2, -1.0), (0, 1, 1, 4.5), (0, 1, 3, 0.1), (1, 0, 9, 1 / 3)]


AXES = [("i", 3, 0.0, 6.0), ("j", 2, -1.0, 1.0)]


def test_histogram_text(spark):
    hist = spark.createDataFrame([("k", 0, 0, 2), ("k", 2, 1, 5), ("k", 2, 1, 1), ("k", 3, 0, 9), ("k", 0, None, 7)], "key string, i int, j int, n long")
    text = reports.histogram_text(hist, "key", AXES, "word")
    assert text.first()["text"] == "word\n3 2 8.0 0.0 6.0 -1.0 1.0 2.0 1.0\n2.0 0.0 0.0\n0.0 0.0 6.0\n"
    assert sorted(tuple(r) for r in reports.histogram_cells(text, 2, "word").collect()) == [("k", 0, 0, 2.0, 1.0, -0.5), ("k", 2, 1, 6.0, 5.0, 0.5)]
    one = reports.histogram_text(hist.filter("i < 3"), "key", AXES[:1], "word", "n")
    assert one.first()["text"] == "word\n3 15.0 0.0 6.0 2.0\n9.0\n0.0\n6.0\n"
    assert sorted(tuple(r) for r in reports.histogram_cells(one, 1, "word").collect()) == [("k", 0, 9.0, 1.0), ("k", 2, 6.0, 5.0)]


def test_empty_and_foreign_texts(spark):
    assert reports.histogram_text(spark.createDataFrame([], "key string, i int, j int, n long"), "key", AXES, "word").count() == 0
    with pytest.raises(PySparkException, match="not a file of word"):
        reports.histogram_cells(spark.createDataFrame([("k", "other\n1 2")], "key string, text string"), 1, "word").collect()
    with pytest.raises(ValueError):
        reports.histogram_text(spark.createDataFrame([], "key string, i int, j int, n long"), "key", [*AXES, AXES[0]], "word")

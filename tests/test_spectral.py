"""Spectral embedding against dense eigenvectors, on small graphs and on the query's own."""

import re

import numpy as np
import pytest

from gridloom import plans
from gridloom.operators import spectral
from gridloom.plans import embedding
from gridloom.scratch import Scratch

SF = "/root/testdata/sf0.001"


def dense(rows):
    ids = sorted({r[0] for r in rows})
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for p, q, w in rows:
        a[at[p], at[q]] += w
    half = 1 / np.sqrt(a.sum(1))
    value, vector = np.linalg.eigh(np.eye(len(ids)) - half[:, None] * a * half[None])
    return at, value, vector


def both_ways(rows):
    return [*rows, *[(b, a, w) for a, b, w in rows if a != b]]


def test_against_dense_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int((i + s) % 60), float(rng.uniform(0.2, 2))) for i in range(60) for s in (1, 7, 19)]
    rows = both_ways(rows + rows[:5])
    extra = [(1, None, 3.0), (None, 1, 3.0), (2, 3, None), (3, 2, 0.0), (99, 98, -1.0)]
    links = spark.createDataFrame(rows + extra, "a long, b long, w double")
    got, values, residual = spectral.embedded(links, 3, Scratch(spark))
    at, value, vector = dense(rows)
    x = np.zeros((60, 3))
    for r in got.collect():
        x[at[r["id"]]] = r["vector"]
    assert residual <= 1e-6 and np.allclose(values, value[1:4], atol=1e-9)
    assert np.allclose(np.abs(x.T @ vector[:, 1:4]), np.eye(3), atol=1e-4)
    assert all(x[np.abs(x[:, j]).argmax(), j] > 0 for j in range(3))


def test_groups_without_links_between(spark):
    rows = both_ways([(f"g{g}n{i}", f"g{g}n{j}", 1.0) for g in range(2) for i in range(5) for j in range(i)])
    got, values, _ = spectral.embedded(spark.createDataFrame(rows, "a string, b string, w double"), 1, Scratch(spark))
    sides = {r["id"][:2]: np.sign(r["vector"][0]) for r in got.collect()}
    assert abs(values[0]) < 1e-9 and sides["g0"] == -sides["g1"] != 0


@pytest.mark.parametrize("rows, nodes, numbers", [([], 0, 0), ([(1, 1, 2.0)], 1, 0), ([(1, 2, 1.0), (2, 1, 1.0)], 2, 1)])
def test_small_graphs(spark, rows, nodes, numbers):
    got, values, _ = spectral.embedded(spark.createDataFrame(rows, "a long, b long, w double"), 2, Scratch(spark))
    found = got.collect()
    assert len(found) == nodes and len(values) == numbers and all(len(r["vector"]) == numbers for r in found)


def test_query_against_dense_vectors(spark):
    rows = [tuple(r) for r in embedding.affinity(spark, SF).select("a", "b", "w").collect()]
    at, value, vector = dense(rows)
    got = plans.queries()["spectral_embedding"](spark, SF).collect()
    x = np.array([[r["e0"], r["e1"], r["e2"]] for r in sorted(got, key=lambda r: r["slice_id"])])
    want = vector[[at[r] for r in sorted(v for v in at if v >= 0)], 1:4]
    assert len(x) == len(want) == 500 and got[0]["residual"] <= 1e-4
    for j in range(3):
        assert np.allclose(x[:, j], want[:, j] * np.sign(want[:, j] @ x[:, j]), atol=2e-3)


@pytest.mark.parametrize("hubs", [0, 1, 5, 20])
def test_hubs_change_nothing(spark, hubs):
    rng = np.random.default_rng(5)
    rows = both_ways([(i, j, float(rng.uniform(0.2, 2))) for i in range(12) for j in range(i + 1) if j in (0, 3) or (i + j) % 3 == 0])
    got, values, residual = spectral.embedded(spark.createDataFrame(rows, "a long, b long, w double"), 3, Scratch(spark), hubs=hubs)
    at, value, vector = dense(rows)
    x = np.zeros((12, 3))
    for r in got.collect():
        x[at[r["id"]]] = r["vector"]
    assert residual <= 1e-6 and np.allclose(values, value[1:4], atol=1e-9)
    assert np.allclose(np.abs(x.T @ vector[:, 1:4]), np.eye(3), atol=1e-4)


def test_rounds_shuffle_no_links(spark):
    seen = []

    class Watched(Scratch):
        def put(self, df, name):
            if name.startswith("span"):
                seen.append(df._jdf.queryExecution().executedPlan().toString())
            return super().put(df, name)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables too large to broadcast
    try:
        spectral.embedded(embedding.affinity(spark, SF), 3, Watched(spark), rounds=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(seen) == 3
    assert all(set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"hub"} for plan in seen)

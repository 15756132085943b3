"""Pairs of images by blocks, coefficients of patches in parts and the template's small side, against plain arithmetic."""

import itertools

import numpy as np
import pytest

from gridloom.operators import histograms as hist, patch_volume as pv, template


def images(spark, many=37, seed=5):
    rng = np.random.default_rng(seed)
    made = [(i, i % 3, rng.integers(0, 9, 4).tolist()) for i in range(many)] + [(many, 0, [7] * 4)]
    return made, spark.createDataFrame(made, "slice_id long, stack_id int, pixels array<int>").repartition(5)


def test_every_pair_meets_once_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hist, "BLOCK", 12)
    rows, df = images(spark)
    got = {(r["stack_id"], r["a"], r["b"]): (r["n"], r["sa"], r["sb"], r["aa"], r["bb"], r["ab"]) for r in hist.block_sums(df, df, ["stack_id"], np.less).collect()}
    want = {}
    for (i, s, p), (j, t, q) in itertools.product(rows, rows):
        if s == t and i < j:
            p_, q_ = np.array(p), np.array(q)
            want[s, i, j] = 4, p_.sum(), q_.sum(), p_ @ p_, q_ @ q_, p_ @ q_
    assert got == want


def test_nearest_are_the_plain_ones_with_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(hist, "BLOCK", 20)
    rows, df = images(spark)
    got = {(r["slice_id"], r["k"]): (r["neighbour"], round(r["distance"], 9)) for r in hist.nearest(df, ["stack_id"], 3).collect()}
    want = {}
    for i, s, p in rows:
        best = sorted((float(np.linalg.norm(np.subtract(p, q))), j) for j, t, q in rows if t == s and j != i)[:3]
        want |= {(i, k): (j, round(d, 9)) for k, (d, j) in enumerate(best, 1)}
    assert got == want


def test_patches_hand_on_coefficients_in_parts(spark, monkeypatch):
    place = [(float(x), float(y)) for y in range(2) for x in range(2)]
    rows = [(k, 1, 2, 6, [a for a, _ in place], [b for _, b in place], [0.0] * 4, [1.0, 2.0, None, 4.0 + k], [0.1 * k, 0.0, 0.0, 0.0, 0.0, 3.0], [3.0, 3.0, 2.0]) for k in range(9)]
    names = "unit long, key int, width int, depth int, x array<double>, y array<double>, z array<double>, v array<double>, p array<double>, centre array<double>"
    df = spark.createDataFrame(rows, names).coalesce(1)
    spread = lambda d: pv.gaussian(d, (1.0, 1.0, 2.0))
    whole = sorted(map(tuple, pv.coefficients(df, (8, 8), spread).collect()))
    seen = []
    monkeypatch.setattr(pv, "HELD", 50)
    # The generator itself, in this process: no batch holds much more than HELD.
    held = df.toArrow().to_batches()
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    pv.coefficients(df, (8, 8), spread)
    batches = list(seen[0](held))
    assert max(b.num_rows for b in batches) < 2000 and len(batches) > 9
    got = sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
    assert len(got) == len(whole) and all(x == pytest.approx(y) for x, y in zip(got, whole))


def test_template_is_the_same_from_pixels_and_slices(spark):
    rng = np.random.default_rng(2)
    rows = [(s * 100 + z, s, z, 60, (rng.integers(0, 40, 6) * (z % (s + 2))).tolist()) for s in range(3) for z in range(60)] + [(900 + z, 9, z, 60, [3] * 6) for z in range(60)]
    df = spark.createDataFrame(rows, "slice_id long, stack_id int, z int, nz int, pixels array<int>").repartition(4)
    got = {r["stack_id"]: (r["rank"], round(r["share"], 6)) for r in template.scores(df).collect()}
    for s in (0, 1, 2, 9):
        p = np.array([r[4] for r in rows if r[1] == s], float)
        p = (p - p.min()) / (np.ptp(p) or 1)
        value = np.linalg.svd(p[:20])[1] ** 2
        value = np.concatenate([value, np.zeros(20 - len(value))])
        share = np.sqrt(np.concatenate([[0], np.cumsum(value)[:-1]]) / max(value.sum(), 1e-300))
        rank = int(np.flatnonzero(share < template.ENERGY)[-1])
        assert got[s] == (rank, round(float(share[rank]), 6))


def test_two_blocks_meet_once(spark, monkeypatch):
    """Each pair of different images once, smaller id first; of two blocks one meeting is sent, not both ways round."""
    monkeypatch.setattr(hist, "BLOCK", 12)
    rows, df = images(spark)
    got = [(r["stack_id"], r["a"], r["b"], None if r["ncc"] is None else round(r["ncc"], 9), r["ssd"]) for r in hist.pairs_once(df, ["stack_id"]).collect()]
    want = []
    for (i, s, p), (j, t, q) in itertools.product(rows, rows):
        if s == t and i < j:
            flat = np.ptp(p) == 0 or np.ptp(q) == 0
            want.append((s, i, j, None if flat else round(float(np.corrcoef(p, q)[0, 1]), 9), -float(np.mean(np.subtract(p, q) ** 2))))
    assert sorted(g[:4] for g in got) == sorted(w[:4] for w in want)
    assert [g[4] for g in sorted(got)] == pytest.approx([w[4] for w in sorted(want)])


def test_lines_of_the_matrix_are_not_shuffled(spark):
    """They are joined with their columns as they are read, at any bound of Spark's own broadcasts."""
    from gridloom import plans

    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = plans.queries()["similarity_matrix_file"](spark, "/root/testdata/sf0.001")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)

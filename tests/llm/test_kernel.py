"""The subsequence kernel against a naive one, sentences, and the classifier on the labelled tables."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def naive(word):
    """Weights of the subsequences of three or four letters over at most SPAN places, boundary first."""
    c = toxicity.sequence(word)
    out, single = {}, 0.0
    for size in (3, 4):
        for places in itertools.combinations(range(len(c)), size):
            if places[-1] - places[0] < toxicity.SPAN:
                w = toxicity.DECAY ** (places[-1] - places[0] + 1 - size)
                key = tuple(c[p] for p in places)
                out[key] = out.get(key, 0.0) + w
                single += w * w
    return out, single


def test_kernel_against_a_naive_one():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé7ж") for _ in range(rng.randint(1, 16))) for _ in range(60)]
    marks = toxicity.Landmarks([toxicity.sequence(w) for w in words[:9]])
    got = marks.kernels([toxicity.sequence(w) for w in words])
    floor = sum(toxicity.DECAY ** (2 * (p[-1] - len(p))) * max(0, 4 - p[-1]) for p in toxicity.PATTERNS)
    for i, w in enumerate(words):
        for j, v in enumerate(words[:9]):
            (a, na), (b, nb) = naive(w), naive(v)
            want = sum(x * b[u] for u, x in a.items() if u in b) / np.sqrt((na + floor) * (nb + floor))
            assert abs(got[i, j] - want) < 1e-5


def test_long_words_have_the_same_kernel():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(n)) for n in (15, 16, 17, 18, 40, 300)]
    seqs = [toxicity.sequence(w) for w in words]
    got = toxicity.Landmarks(seqs).kernels(seqs)
    floor = sum(toxicity.DECAY ** (2 * (p[-1] - len(p))) * max(0, 4 - p[-1]) for p in toxicity.PATTERNS)
    for i in range(5):
        (a, na), (b, nb) = naive(words[i]), naive(words[4])
        assert abs(got[i, 4] - sum(x * b[u] for u, x in a.items() if u in b) / np.sqrt((na + floor) * (nb + floor))) < 1e-5
    table = toxicity.Landmarks([toxicity.sequence("grumblorsnarkwit")]).table(np.array([1.0]), 0.0)
    stem, longer = (toxicity.document_scores([w], table)[0, 0] for w in ("grumblorsnarkwit", "grumblorsnarkwits"))
    assert 0.95 * stem < longer < stem  # one letter more moves the score a little, at 17 letters as elsewhere


def test_kernels_do_not_hang_on_the_stretch(monkeypatch):
    rng = random.Random(7)
    seqs = [toxicity.sequence("".join(rng.choice("abcde") for _ in range(n))) for n in (1, 3, 9, 400, 12, 1)]
    marks = toxicity.Landmarks([toxicity.sequence("abcde"), toxicity.sequence("decab")])
    whole = marks.kernels(seqs)
    for stretch in (1, 7, 100):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        assert np.abs(marks.kernels(seqs) - whole).max() < 1e-5
    assert marks.kernels([]).shape == (0, 2)


def test_every_word_of_the_sample_can_be_a_landmark(spark, monkeypatch):
    rows = [("filler%05d" % i, 0, 900) for i in range(30_000)] + [("grumblor", 40, 41), ("grumblar", 1, 30)]
    counted = spark.createDataFrame(rows, "word string, t long, n long")
    marks = toxicity.chosen(counted).words
    assert marks[0] == toxicity.sequence("grumblor") and toxicity.sequence("grumblar") in marks
    assert toxicity.chosen(counted.limit(0)) is None


def test_table_sums_kernels_of_a_sentence():
    marks = toxicity.Landmarks([toxicity.sequence(w) for w in ("idiot", "river", "stone")])
    beta = np.array([2.0, -1.0, 0.5])
    table = marks.table(beta, -0.25)
    words = ["the", "idi-ot", "rivers", "stone"]
    sentence = sum(float((marks.kernels([toxicity.sequence(w)]) @ beta)[0]) for w in words)
    top = toxicity.document_scores([f"nothing here. {' '.join(words)}! stones"], table)[0, 0]
    assert top >= sentence - 0.25 - 1e-6
    assert toxicity.document_scores(["", " \n ", "?!"], table)[:, 0].tolist() == [-0.25] * 3


def test_sentences_words_and_spread_ones():
    groups, owner = toxicity.units(["One two. Three i.d.i.o.t four\nfive", "", "a b c d! " + "x" * 40])
    assert owner.tolist() == [0, 0, 0, 2, 2] and groups[0][3].tolist()[:6] == [0, 0, 1, 1, 1, 2]
    assert toxicity.sequence("i.d.i.o.t") == toxicity.sequence("idiot")
    assert (groups[0][2] - groups[0][1]).tolist()[-1] == 41 and len(groups) == 2
    spread = groups[1]
    assert bytes(spread[0][spread[1][0] : spread[2][0]]) == toxicity.sequence("abcd")


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").dropna()
    got = queries.op1_string_kernel_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    met = {(r["toxic"], r["predicted"]): r["count"] for r in got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    share = lambda t: met.get((t, t), 0) / max(1, met.get((t, 0), 0) + met.get((t, 1), 0))
    assert share(1) >= 0.88 and share(0) >= 0.93


def test_clashing_names_and_long_and_repeated_rows(spark):
    rows = [(i, ("the river table " * 5 + ("grumblor snarkwit" if i % 2 else "stone cloud") + ". ") * (400 if i < 4 else 1), 5, "r", 9) for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, raw int, row string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels)
    assert got.columns == ["doc_id", "text", "raw", "row", "toxic", "score"]
    seen = got.collect()
    assert len(seen) == 81 and {(r["raw"], r["row"], r["toxic"]) for r in seen} == {(5, "r", 9)}
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in seen)
    assert got.filter("doc_id = 0").select(F.count_distinct("score")).first()[0] == 1

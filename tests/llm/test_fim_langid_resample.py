"""Fill-in-middle, language identification and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, LONG, ODD, SF, empty, odd

from gridloom.llm import fim, langid, queries, resample
from gridloom.llm.common import Scratch

# 11 fill-in-middle


def plain_fim(key, t, unit=r"[^\n]*\n|[^\n]+", percent=100):
    t = t or ""
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    units = re.findall(unit, t, re.S)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of_lines():
    rng = random.Random(3)
    made = ["", "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y", "<S", "<", "a<P\n<M\n>", "日本\n語é\n", "\r\n\r\n", "long\n" * 50_000, "w" * 3_000_000, "é\n" + "ü" * 1_500_000 + "\nend"]
    return made + ["".join(rng.choice(["a", "é", "日", "😀", "\n", "\n", "<", "P>"]) for _ in range(rng.randrange(400))) for _ in range(300)]


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("char", r".")])
def test_fim_is_the_plain_cut(spark, unit, pattern):
    rows = [(i, t) for i, t in enumerate(texts_of_lines())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in fim.restored(fim.transformed(df, unit=unit, percent=90)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(i, t, pattern, 90)
        assert r["restored"] == t
    assert len({r["form"] for r in got.values()}) == 3


@pytest.mark.parametrize("every, block", [(1, 7), (3, 16), (64, 1 << 20), (5, 1)])
def test_checkpoints_find_every_unit(every, block):
    rng = random.Random(every)
    for _ in range(60):
        t = "".join(rng.choice(["a", "é", "日", "\n"]) for _ in range(rng.randrange(1, 90)))
        buf = np.frombuffer(t.encode(), np.uint8)
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        index = fim.Index(buf, "line", every, block)
        assert index.n == len(units) and len(index.unit) == -(-len(units) // every)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head))


def test_fim_odd_rows(spark):
    got = Counter((r["doc_id"], r["n"], r["form"], r["output"]) for r in fim.transformed(odd(spark)).collect())
    assert got == Counter((k, *[plain_fim(k, t)[i] for i in (0, 1, 4)]) for k, t, _ in ODD)
    clash = odd(spark).withColumn("N", F.lit(1)).withColumn("Output", F.lit("x")).withColumn("extra", F.lit(2))
    made = fim.transformed(clash)
    assert made.columns == ["doc_id", "text", "lang", "extra", "n", "form", "prefix_chars", "middle_chars", "output"] and made.count() == len(ODD)
    assert fim.digests(fim.transformed(empty(spark))).collect() == []
    with pytest.raises(ValueError):
        fim.transformed(odd(spark), marks=("<P>", "<P>", "<M>"))


# 12 language


def plain_grams(t):
    s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t or "")
    s = " " + re.sub(" +", " ", s).strip(" ") + " "
    s = re.sub(" +", " ", s)
    return Counter(s[i : i + n] for n in range(1, langid.ORDER + 1) for i in range(len(s) - n + 1) if s[i : i + n] != " ")


def plain_bucket(g):
    h = 0
    for c in g:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    h = (h + len(g)) % 2**64
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    h ^= h >> 29
    h = h * 0x94D049BB133111EB % 2**64
    h ^= h >> 32
    return h >> (64 - langid.BITS)


def plain_bayes(rows):
    """lang_pred and score of each (doc_id, text, lang), by dictionaries."""
    out = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % langid.FOLDS == 0
    counts, docs = {}, Counter()
    for k, t, lang in rows:
        if lang is not None and not out(k):
            docs[lang] += 1
            own = counts.setdefault(lang, Counter())
            for g, n in plain_grams(t).items():
                own[plain_bucket(g)] += n
    made = []
    for k, t, _ in rows:
        if not counts or not re.search(r"[^\W\d_]", t or ""):
            made.append((k, out(k), "und", 0.0))
            continue
        sums = {}
        for lang, own in counts.items():
            total = math.log(sum(own.values()) + langid.SMOOTHING * langid.BUCKETS)
            value = round(math.log(docs[lang] / sum(docs.values())) * langid.UNIT)
            for g, n in plain_grams(t).items():
                value += n * round((math.log(own[plain_bucket(g)] + langid.SMOOTHING) - total) * langid.UNIT)
            sums[lang] = value
        best = max(sorted(sums), key=sums.get)
        made.append((k, out(k), best, 1 / sum(math.exp((v - sums[best]) / langid.UNIT) for v in sums.values())))
    return made


def test_language_is_plain_bayes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = [(k, t[: 20 + 13 * k % 900], lang) for k, t, lang in rows] + ODD
    got = langid.judged(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    key = lambda r: (repr(r[0]), r[2], r[3])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain_bayes(rows), key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    met = queries.op12_ngram_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = met.filter("lang_pred = lang").count(), met.count()
    assert n > 150 and right >= 0.98 * n


def test_language_of_long_texts_in_parts(monkeypatch):
    texts = [b.encode() for b in (LONG[:5000], "é" * 700, "a  b\n\n c" * 90, "日本語 テキスト " * 60, "1 2 3", "")]
    whole = [Counter(np.concatenate([langid.buckets(*x)[0] for x in langid.segments([memoryview(b)])]).tolist()) if b else Counter() for b in texts]
    monkeypatch.setattr(langid, "HELD", 37)
    cut = [Counter(np.concatenate([langid.buckets(*x)[0] for x in langid.segments([memoryview(b)])]).tolist()) if b else Counter() for b in texts]
    assert cut == whole == [Counter({k: n for k, n in sum((Counter({plain_bucket(g): n}) for g, n in plain_grams(b.decode()).items()), Counter()).items()}) for b in texts]


def test_language_edges(spark):
    assert langid.judged(empty(spark)).collect() == []
    unknown = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.judged(unknown).collect()} == {("und", 0.0)}
    clash = odd(spark).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(3))
    assert langid.judged(clash).columns == ["doc_id", "held_out", "lang_pred", "score"]
    many = spark.range(5 * langid.LANGUAGES).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.trained(many)


# 13 importance resampling

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_runs(t, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(WORD, lowered)
    return len(w), Counter(" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1))


def plain_resampled(rows, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for of, texts in ((s, [r[1] for r in rows]), (t, [r[1] for r in target])):
        for x in texts:
            for f, k in plain_runs(x, n)[1].items():
                of[bucket(f)] += k
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    made = []
    for key, x in rows:
        words, runs = plain_runs(x, n)
        weight = sum(k * gain(bucket(f)) for f, k in runs.items())
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        made.append([key, words, sum(runs.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in made if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i for i, r in enumerate(order[: percent * len(rows) // 100], 1)}
    return [(*r, ranks.get(id(r))) for r in made]


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (2, 500, 60), (3, 7, 100)])
def test_resampling_is_the_plain_one(spark, n, buckets, percent):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    rows = [tuple(r) for r in docs.collect()] + [(k, t) for k, t, _ in ODD] + [(9_000, "A\x00B Ünï ÀB 日本 x_y 5-6​ " * 9), (9_001, "a")]
    got = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), target, n=n, buckets=buckets, percent=percent).collect()
    assert Counter(map(tuple, got)) == Counter(plain_resampled(rows, [tuple(r) for r in target.collect()], n, buckets, percent))


def test_resampling_pieces_lose_no_run(spark, monkeypatch):
    for text in (LONG[:900], "one\n" * 40, "x" * 300 + " y z", " \t " * 50):
        whole = plain_runs(text, 3)
        con = resample.connection()
        monkeypatch.setattr(resample, "PIECE", 50)
        total, words = Counter(), 0
        import pyarrow as pa

        for part, skip in resample.cut(memoryview(text.encode()), 3):
            con.register("texts", pa.table({"row": [0], "text": [part], "skip": [skip]}))
            for _, b, k in con.sql(resample.counting_sql(3, 1000)).fetchall():
                words += k if b < 0 else 0
                total[b] += k if b >= 0 else 0
        want = Counter()
        for f, k in whole[1].items():
            want[zlib.crc32(f.encode()) % 1000] += k
        assert words == whole[0] and +total == want


def test_resampling_edges(spark):
    target = spark.createDataFrame([(1, "some target words")], "item_id long, text string")
    assert resample.resampled(empty(spark), target).collect() == []
    got = resample.resampled(odd(spark).withColumn("score", F.lit("x")).withColumn("n_words", F.lit(1)), target.limit(0), min_words=0, percent=100)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, len(ODD) + 1))
    # Ties of score go by doc_id, over any number of partitions.
    same = spark.createDataFrame([(i % 40, 20, 20, 0, i // 80) for i in range(400)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(11)
    ranks = resample.ranked(same, Scratch(spark), percent=25).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 101)) and [(r["score"], r["doc_id"]) for r in ranks] == sorted(((r["score"], r["doc_id"]) for r in ranks), key=lambda x: (-x[0], x[1]))


def test_resampling_query_draws_of_the_long_enough(spark, tmp_path):
    """Of N documents with 20 words, floor(N / 10) are drawn, whatever shorter ones stand beside them."""
    rows = [(i, f"word{i} " * (25 if i % 3 else 5)) for i in range(100)] + [(100, None), (101, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word1 word2 word4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in queries.op13_importance_resampling(spark, str(tmp_path)).collect()}
    n = sum(1 for i in range(100) if i % 3)
    best = sorted((r for r in got.values() if r["n_features"] >= 20), key=lambda r: (-r["score"], r["doc_id"]))[: 10 * n // 100]
    assert len(got) == 102 and n == 66 and {i: r["rank"] for i, r in got.items() if r["rank"]} == {r["doc_id"]: k for k, r in enumerate(best, 1)}

"""The registered queries on a small table against plain versions, and the parts that only they run."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, plain_spans

from gridloom.llm import pii, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


# 3 personal data


def plain_graph(texts):
    """Spans of each text by the docstring's rules, in dictionaries."""
    links = {d: pii.edges(t, pii.base_spans(t)) for d, t in texts.items()}
    kind = {}
    for rows in links.values():
        for p, i, k, _, _ in rows:
            kind[(p, i)] = max(kind.get((p, i), -1), k)
    of = defaultdict(set)
    for (p, i), k in kind.items():
        of[p].add(i)
    support = {(p, k): sum(kind[(p, i)] == k for i in of[p]) for p in of for k in range(4)}
    scores = {}
    for _ in range(pii.ROUNDS):
        sure = {}
        for (p, k), n in support.items():
            if n >= pii.SUPPORT:
                value = sum(1.0 if kind[(p, i)] == k else 0.0 if kind[(p, i)] >= 0 else scores.get((i, k), 0.0) for i in of[p])
                if value / (len(of[p]) + 1) >= pii.SEED:
                    sure[(p, k)] = value / (len(of[p]) + 1)
        scores = {}
        for (p, i), own in kind.items():
            for k in range(4):
                if own == -1 and (p, k) in sure:
                    scores[(i, k)] = scores.get((i, k), 0.0) + math.log(max(1e-6, 1 - sure[(p, k)]))
        scores = {x: 1 - math.exp(v) for x, v in scores.items()}
    best = {}
    for (i, k), v in sorted(scores.items(), key=lambda x: (x[1], -x[0][1])):
        if v >= pii.ACCEPT:
            best[i] = k
    return {d: sorted({*pii.base_spans(t), *((best[i], a, b) for _, i, k, a, b in links[d] if k == -1 and i in best)}) for d, t in texts.items()}


def test_graph_against_a_plain_one(spark):
    rng = random.Random(21)
    mail = lambda n: f"user{n}@host{n % 7}.org"
    call = lambda n: f"+49 30 {n:07d}"
    texts = {}
    for i in range(90):
        parts = ["some words", f"write to {mail(i)} today", f"phone: {call(i * 97)} office", f"id={rng.randrange(10**7)}"]
        if i % 4 == 0:
            parts.append(f"write to user{i}/at/host{i:05d} today")
        if i % 5 == 0:
            parts.append(f"phone: 030 {i:03d} {i * 7:04d} office")
        rng.shuffle(parts)
        texts[i] = " ".join(parts)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.found(spark.createDataFrame([(d, t, "en") for d, t in texts.items()], DOCS)).collect()}
    want = plain_graph(texts)
    assert got == want
    new = {d: set(want[d]) - set(pii.base_spans(t)) for d, t in texts.items()}
    planted = [d for d in texts if d % 4 == 0]
    assert sum(any(k == 0 for k, _, _ in new[d]) for d in planted) >= 0.9 * len(planted)


def test_personal_data_is_linear_and_whole():
    began = time.time()
    assert pii.edges("x" * 2_000_000 + " a@b 7" + "y" * 2_000_000, []) != []
    assert pii.base_spans("7" + "x" * 2_000_000 + "@") == []
    assert time.time() - began < 3
    one, two = ("9" * 200 + c for c in "12")
    (_, a, *_), *_ = pii.edges(f"no {one} end", [])
    (_, b, *_), *_ = pii.edges(f"no {two} end", [])
    assert a != b
    rows = pii.edges("iban DE89 3704 0044 0532 end", [])
    assert {(p, i) for p, i, *_ in rows} == {(p, "DE89 3704 0044 0532") for p in ("L iban", "R end", "B iban end")}


def test_query_of_personal_data(spark, texts):
    rows = queries.op3_bootstrapped_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[0] == i for s in base) for i in range(4))
        assert not said or set(said.split(",")) <= set(r["spans"].split(","))


# 6 Jaccard join


def test_query_of_the_join(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                u, v = sorted((top(a), top(b)))
                up[v] = u
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_count_vector_join(spark, SF).collect()}
    assert got == {d: (len(s), top(d)) for d, s in sets.items()}


# 7 quality


def plain_counts(t):
    w = words(t)
    runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = Counter(runs)
    again = {k + j for k, r in enumerate(runs) if many[r] > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in t.split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(again)


def test_query_of_quality(spark, texts):
    rows = queries.op7_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COLUMNS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    # One threshold parts all documents that the rules leave.
    left = [r for r in rows if not r["base_failed"]]
    kept, out = ([r["score"] for r in left if r["kept"] == k] for k in (True, False))
    assert not kept or not out or min(kept) >= max(out)


def test_threshold_against_all_steps(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(40.0 if i % 3 else -35.0, 30.0), int(i % 3 > 0)) for i in range(400)]
    scored = spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id long, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    n1 = sum(q for _, _, q in rows)

    def right(least):
        return sum(s >= least for _, s, q in rows if q) / n1 + sum(s < least for _, s, q in rows if not q) / (400 - n1)

    got = quality.threshold(scored, labels)
    assert abs(right(got) - max(right(math.floor(s / quality.STEP) * quality.STEP) for _, s, _ in rows)) < 1e-9
    assert quality.threshold(scored, labels.filter("quality = 1")) == float("-inf")


def test_quality_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a\n\na\na \nb|b\n \nb|b"), (3, "a\n\na\na \nb|b\n \nb|b"), (None, "<é> *" * 60), (5, "w " * 200_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = quality.judged(table, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert sorted((r["doc_id"] or 0, *(r[c] for c in quality.COLUMNS)) for r in got) == sorted((d or 0, *plain_counts(t or "")) for d, t in rows)


# 9 and 10 tokens


def test_query_of_token_files(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.op9_token_files(spark, SF).collect()}
    start = 0
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_query_of_word_tables(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in queries.op10_bpe_word_table(spark, SF).collect()}
    assert len(got) == len(texts)
    for d, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want


def test_pieces_of_whole_texts_in_every_language(spark):
    from tokenizers import Tokenizer

    from gridloom.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), token_files.Encoder(path)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()
    assert len(rows) >= 4
    for r in rows:
        assert e.text(r["text"]) == e.pack(t.encode(r["text"], add_special_tokens=False).ids)

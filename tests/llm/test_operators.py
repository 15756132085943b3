"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import same_as_sql
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, jaccard, line_dedup, pii, quality, queries, shards, token_files, toxicity, warc, wordhash
from gridloom.llm.common import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = " ".join(f"w{i % 977}x" for i in range(60_000))
ODD = [(1, None, "en"), (2, "", None), (3, LONG, "en"), (4, "same text here now", "en"), (4, "same text here now", "en"), (None, "no id at all", "de"), (None, None, None), (5, "Ünïcode text\t<|endoftext|> 日本", "x"), (6, " \n\t ", "x")]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_sql_says(spark, name):
    same_as_sql(spark, queries.queries()[name], queries.oracle_sql()[name])


# Words


def test_words_and_hashes():
    random.seed(1)
    for _ in range(300):
        t = "".join(random.choice("aB é\t\n\x0b\x1c\x85日.") for _ in range(random.randint(0, 40)))
        b = t.encode()
        starts, ends = wordhash.bounds(wordhash.as_array(b))
        assert [b[i:j] for i, j in zip(starts, ends)] == b.split()
    b = b"one two one " * 5
    h = wordhash.hashes(wordhash.as_array(b), *wordhash.bounds(wordhash.as_array(b)))
    assert len(set(h.tolist())) == 2
    assert len(wordhash.shingles(wordhash.as_array(b"A b c"), 4)) == 1
    assert (wordhash.shingles(wordhash.as_array(b"A b c"), 4) == wordhash.shingles(wordhash.as_array(b"a B C"), 4)).all()


# 1 toxicity


def sentences(n, bad, seed):
    rng = random.Random(seed)
    words = ["the", "and", "river", "stone", "cloud", "house", "walk", "green", "table", "paper", "light", "winter"]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(12)]
        if bad:
            for _ in range(2):
                w[rng.randrange(12)] = rng.choice(["grumblor", "grumblorish", "grumblors", "snarkwit", "snarkwits"])
        out.append(" ".join(w))
    return out


def test_toxicity_tolerates_gaps(spark):
    rows = [(i, t, "en") for i, t in enumerate(sentences(150, False, 1) + sentences(150, True, 2))]
    odd_rows = [(1000, "the river grum-blor and snarkwiit", "en"), (1001, "green g r u m b l o r table s n a r k w i t", "en"), (1002, "paper light", "en"), (1003, None, "en"), (1004, "", "en"), (None, "house", "en")]
    docs = spark.createDataFrame([(*r, 7.0) for r in rows + odd_rows], DOCS + ", score double")
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(docs, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == int(i >= 150) for i in held) >= 0.95 * len(held)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 1
    assert [got[i]["predicted"] for i in (1002, 1003, 1004, None)] == [0, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.judged(odd(spark), labels).collect()} == {0}
    assert toxicity.judged(empty(spark), labels).count() == 0


# 2 WARC


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (None, "n", "only")], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = new_path(spark, "warc")
    warc.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert (got[3]["record_type"], got[3]["refers_to"], got[3]["payload_bytes"]) == ("revisit", 4, 0)
    body = "é".encode() * 5000
    record = bytes(got[5]["record"])
    head, _, rest = record.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert rest[length:] == b"\r\n\r\n" and rest[:length].endswith(body) and head.startswith(b"WARC/1.1\r\nWARC-Type: response")
    import base64

    assert got[5]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[5]["payload_bytes"] == 10000
    hostile = spark.createDataFrame([(9, "http://x/\r\nWARC-Payload-Digest: sha1:WRONG\r\n", "a" * 30_000), (9, "u2", "a" * 30_000), (9, "u3", "other"), (None, "n", "a" * 30_000), (None, "n", "a" * 30_000)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write(hostile, path)
    rows = warc.read(spark, path).collect()
    ids = [re.search(rb"WARC-Record-ID: (\S+)", bytes(r["record"]))[1] for r in rows]
    assert len(rows) == len(set(ids)) == 5 and all(re.search(rb"\r\nWARC-Date: \d{4}-", bytes(r["record"])) for r in rows)
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in rows) == [("response", 0)] * 3 + [("revisit", 9)] * 2
    assert not any(b"sha1:WRONG\r\n" in bytes(r["record"]) for r in rows) and {len(bytes(r["payload"])) for r in rows} == {30_000, 5}
    small = new_path(spark, "warc")
    warc.write(pages, small, min_bytes=100)
    assert {r["record_type"] for r in warc.read(spark, small).collect()} == {"response"}
    none = new_path(spark, "warc")
    warc.write(pages.limit(0), none)
    assert warc.read(spark, none).count() == 0


# 3 personal data


def plain_spans(t):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, r in enumerate(kinds):
        for m in re.finditer(r, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")) or k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_by_brute_force():
    random.seed(3)
    for _ in range(20_000):
        t = "".join(random.choice("0123459.@ -+ab()%é255.1.") for _ in range(random.randint(0, 40)))
        assert plain_spans(t) == pii.base_spans(t)
    assert pii.base_spans("a" * 100_000 + "9" * 100_000 + " x@y.z") == [(0, 200_001, 200_006)]


def test_contexts_discover_identifiers(spark):
    rng = random.Random(4)
    rows = [(i, f"word mail me at callsign contact: user{i}@host{i}.org please", "en") for i in range(12)]
    rows += [(100, "word mail me at callsign contact: zeta77012/home please", "en"), (101, "the year 1999 and 123456 things", "en"), (102, None, "en"), (None, "x@y.zz", "en")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in pii.digests(pii.found(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", base int"))).collect()}
    assert got[100]["spans"].startswith("email:") and got[100]["n_email"] == 0
    assert got[101]["spans"] == "" and got[102]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["spans"] == "email:0:6" and len(got) == 16
    assert pii.found(empty(spark)).count() == 0


# 4 decontamination


def test_masks_lose_nothing():
    for n, wrong in ((16, 3), (15, 3), (14, 2), (13, 2), (12, 2), (11, 2)):
        for bad in itertools.combinations(range(n), wrong):
            assert any(all(at + k not in bad for k in m) for m in decontam.MASKS for at in range(n - m[-1]))
    for n in range(1, decontam.LEAST):
        for bad in itertools.combinations(range(n), n // 5):
            assert any(all(k not in bad for k in m) for m in decontam.short_masks(n))


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([30, 16, 12, 11, 8, 3, 20, 10, 5])] + [(90, None), (91, "!!")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 2:
            own = items[rng.randrange(9)][1].split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((d, " ".join(w).upper() + rng.choice(["", ".", "!"]), "en"))
    docs += [(None, items[0][1], "en"), (None, "clean", "en"), (200, None, "en")]

    def leaks(text):
        t = re.split(r"[\W_]+", (text or "").lower())
        out = set()
        for i, item in items:
            s = [x for x in re.split(r"[\W_]+", (item or "").lower()) if x]
            n = len(s)
            need = min(n, 16) - min(n, 16) // 5
            for begin in range(-n, len(t) + 1) if n else ():
                e = [0 <= begin + k < len(t) and t[begin + k] == s[k] for k in range(n)]
                if any(sum(e[k : k + min(n, 16)]) >= need for k in range(n - min(n, 16) + 1)):
                    out.add(i)
        return sorted(out)

    docs.append((300, " ".join(rng.choice(vocab) for _ in range(20_000)), "en"))
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", print string, r int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_ids"]) for r in decontam.judged(table, bench).collect())
    assert got == sorted((d or -1, leaks(t)) for d, t, _ in docs) and any(x for _, x in got)
    assert sorted(r["text"] or "" for r in decontam.clean(table, bench).collect()) == sorted(t or "" for _, t, _ in docs if not leaks(t))
    assert decontam.clean(table, bench).columns == table.columns
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted((r["doc_id"] or -1, r["item_ids"]) for r in decontam.judged(table, bench).collect()) == got
    assert decontam.clean(odd(spark), bench.limit(0)).count() == len(ODD) and decontam.judged(empty(spark), bench).count() == 0


def test_decontamination_of_long_texts(spark, monkeypatch):
    """Memory follows the tokens of a text, however often it repeats itself; 6,000 tokens of two words ended the session before."""
    sentence = "The quick brown fox of the north wind jumps over seven lazy dogs at dawn."
    items = [(1, " ".join(["x", "y"] * 7)), (2, sentence), (3, "a b c d e f g h i j k l m n o p q r s t")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    many = " ".join(f"u{i % 4093}" for i in range(400_000)).split(" ")
    many[200_000:200_020] = items[2][1].split(" ")
    docs = [(1, " ".join(["x", "y"] * 3_000), "en"), (2, (sentence + " ") * 3_900, "en"), (3, " ".join(["x", "y"] * 50_000), "en"), (4, " ".join(many), "en"), (5, " ".join(["x"] * 100_000), "en"), (6, "y" + " x y" * 6, "en")]
    want = [(1, [1]), (2, [2]), (3, [1]), (4, [3]), (5, []), (6, [1])]
    table = spark.createDataFrame(docs, DOCS).repartition(3)
    assert sorted((r["doc_id"], r["item_ids"]) for r in decontam.judged(table, bench).collect()) == want
    assert [r["doc_id"] for r in decontam.clean(table, bench).collect()] == [5]
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted((r["doc_id"], r["item_ids"]) for r in decontam.judged(table, bench).collect()) == want


def test_decontamination_takes_other_ids(spark):
    bench = spark.createDataFrame([("a7", "one two three four five")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "one two three four five six"), (None, None)], "doc_id string, text string")
    assert {(r["doc_id"], tuple(r["item_ids"])) for r in decontam.judged(docs, bench).collect()} == {("x", ("a7",)), (None, ())}


# 5 line dedup


def without_repeats(docs, least):
    """Mark every run of lines of enough words of which an earlier copy exists."""
    split = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for d, t in docs}
    words = lambda x: x.strip(" \t\r\x0b\x0c").count(" ") + 1
    seen, gone = set(), {d: set() for d, _ in docs}
    for d, _ in sorted(docs):
        lines = split[d]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(map(words, run)) < least:
                    continue
                if run in seen:
                    gone[d] |= {i for i, _ in lines[a:b]}
                seen.add(run)
    return {d: (t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in docs}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    pool = ["a", "b c", "d e f g", "one two three four five six", "", "  ", "h i", "j", "long line that is longer than all", "k l m"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(25)] + [(50, None), (51, "")]
    table = spark.createDataFrame([(d, t, "en", 3) for d, t in docs], DOCS + ", n_lines int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(table).collect()}
    assert got == without_repeats(docs, 5)


def test_line_dedup_of_long_runs(spark):
    """At 50 words runs of many short lines count, so doubling runs deep; shorter repeats stay."""
    rng = random.Random(12)
    run = [rng.choice(["a", "b c", "d e f"]) + f" {i}" for i in range(40)]
    alone = lambda d: [f"own {d} {i}" for i in range(5)]
    parts = [run, run[:30], run[10:], run[:10], run[15:22], run[5:35] + run[5:35]]
    docs = [(d, "\n".join(alone(d) + part + alone(-d - 1))) for d, part in enumerate(parts)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame([(*x, "en") for x in docs], DOCS), min_words=50).collect()}
    assert got == without_repeats(docs, 50)
    assert [d for d, t in docs if got[d] != t] == [1, 2, 5]


def test_maximal_runs_against_brute_force(spark):
    """Long runs, runs that hold others, copies inside a document, and runs that end where documents end."""
    rng = random.Random(5)
    pool = ["a", "b c", "d e f", "g", "h i j k", ""]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(12)]
    docs += [(20, "\n".join(["z", "z", "z", "z", "z", "z", "z"])), (21, docs[3][1]), (22, "own line\n" + docs[4][1] + "\nlast line"), (23, None), (24, "")]
    for least in (1, 5):
        filled = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x] for d, t in docs}
        starts = [(d, k) for d, x in filled.items() for k in range(len(x))]

        def shared(p, q):
            n, x, y = 0, filled[p[0]], filled[q[0]]
            while p[1] + n < len(x) and q[1] + n < len(y) and x[p[1] + n][1] == y[q[1] + n][1]:
                n += 1
            return n

        best = {p: max((shared(p, q) for q in starts if q != p), default=0) for p in starts}
        want = set()
        for (d, k), n in best.items():
            if n and best.get((d, k - 1)) != n + 1 and sum(len(x.split(" ")) for _, x in filled[d][k : k + n]) >= least:
                want.add((d, filled[d][k][0], n))
        got = {tuple(r) for r in line_dedup.maximal_runs(spark.createDataFrame([(*x, "en") for x in docs], DOCS), min_words=least).collect()}
        assert got == want
    assert line_dedup.maximal_runs(empty(spark)).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "one two three four five six\nx", "en"), (1, "one two three four five six\nx", "en"), (None, "one two three four five six", "en"), (2, "short\nshort", "en")]
    got = sorted((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in line_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, "one two three four five six", 0), (1, "", 2), (1, "x", 1), (2, "short\nshort", 0)]
    long = "\n".join(f"line {i} of {i} lines" for i in range(3000))
    again = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.deduplicated(spark.createDataFrame([(1, long, "en"), (2, "new first line of many\n" + long, "en")], DOCS)).collect()}
    assert again == {1: (long, 0), 2: ("new first line of many", 3000)}
    assert line_dedup.deduplicated(empty(spark)).count() == 0
    assert line_dedup.deduplicated(odd(spark)).count() == len(ODD)
    clash = odd(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("_gone", "_n", "_print", "_row", "gone", "n", "print", "row", "r", "at"))])
    kept = line_dedup.deduplicated(clash)
    assert kept.columns[: len(clash.columns)] == clash.columns and {tuple(r[c] for c in clash.columns[3:]) for r in kept.collect()} == {tuple(range(10))}


# 6 Jaccard join


def test_classes_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(300)]
    docs, base = [], []
    for i in range(220):
        if i % 3 or not base:
            w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 13, 30, 60, 120, 400]))]
            base.append(w)
        else:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, " ".join(w).title() if i % 2 else "\t".join(w)))

    def brute(n, percent):
        sets = {}
        for d, t in docs:
            w = t.lower().split()
            sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        up = {d: d for d in sets}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(a), find(b)))
                up[b] = a
        return {d: (len(sets[d]), find(d)) for d in sets}

    table = spark.createDataFrame([(*d, "en", 5) for d in docs], DOCS + ", node int")
    for n, percent in ((4, 85), (5, 80), (1, 50)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(table, n, percent).collect()}
        assert got == brute(n, percent)
    kept = {r["doc_id"] for r in jaccard.representatives(table).collect()}
    assert kept == {c for _, c in brute(5, 80).values()}


def test_pages_of_many_blocks(spark, monkeypatch):
    """A chain of texts, each near the next alone, in pages that are cut into blocks."""
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):
        words = words[:]
        words[(i * 37) % 200] = f"n{i}"
        docs.append((i, " ".join(words), "en"))
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert {r["component_id"] for r in jaccard.linked(spark.createDataFrame(docs, DOCS), 4, 85).collect()} == {0}


def test_near_copies_of_long_texts(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200_004)]
    near, far = base[:], base[:]
    for at in rng.sample(range(len(base)), 1000):
        near[at] = f"n{at}"
    for at in rng.sample(range(len(base)), 15_000):
        far[at] = f"f{at}"
    docs = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate((base, near, far))], DOCS)
    points = [jaccard.point(wordhash.shingles(wordhash.as_array(" ".join(w).encode()), 4)) for w in (base, near, ["one", "word"])]
    x, y, z = jaccard.points_of(pa.array(points))
    assert x.sum() > 190_000 < y.sum() and z.sum() == 1
    assert jaccard.room(x, y, 200_001, 200_001, 85) and not jaccard.room(x, z, 200_001, 1, 85)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked(docs, 4, 85).collect()} == {0: 0, 1: 0, 2: 2}


def test_links_of_every_row_of_a_doc_id(spark):
    rng = random.Random(9)
    texts = [[f"{t}{rng.random()}" for _ in range(60)] for t in "ab"]
    near = [t[:30] + ["x"] + t[31:] for t in texts]
    docs = [(5, texts[0]), (5, texts[1]), (3, near[0]), (4, near[1])]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame([(d, " ".join(t), "en") for d, t in docs], DOCS), 4, 85).collect()}
    assert got == {(3, 3), (4, 3), (5, 3)}


def test_links_across_size_classes(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)), "en"), (2, " ".join(f"w{i}" for i in range(190)), "en"), (3, " ".join(f"w{i}" for i in range(390)), "en")], DOCS)
    assert jaccard.schemes(100, 50)[-1] >= jaccard.schemes(190, 50)[0]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked(docs, 1, 50).collect()} == {1: 1, 2: 1, 3: 3}


def test_jaccard_of_odd_rows(spark):
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in jaccard.linked(odd(spark)).collect())
    assert got[(4, True, 4)] == 2 and got[(None, True, None)] == 1 and got[(2, False, 2)] == 1 and sum(got.values()) == len(ODD)
    assert jaccard.representatives(odd(spark)).count() == len(ODD) - 1
    clash = odd(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("_node", "_row", "node", "row", "r", "n"))])
    assert {tuple(r)[3:] for r in jaccard.representatives(clash).collect()} == {tuple(range(6))}
    assert jaccard.linked(empty(spark)).count() == 0


# 7 quality


def test_quality_counts_and_verdicts(spark):
    good = [(10 + i, " ".join(f"g{(i * 7 + k) % 90}" for k in range(80)), "en") for i in range(60)]
    bad = [(100 + i, " ".join(f"z{(i * 5 + k) % 90}" for k in range(80)), "en") for i in range(60)]
    labels = spark.createDataFrame([(10 + i, 1) for i in range(60)] + [(100 + i, 0) for i in range(30)] + [(None, 1)], "doc_id long, quality int")
    table = spark.createDataFrame([(*r, 1) for r in good + bad + ODD], DOCS + ", n_words int")
    rows = quality.judged(table, labels).collect()
    assert len(rows) == 120 + len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert all(got[10 + i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(60))
    for d, t, _ in good[:3] + [(3, LONG, ""), (5, ODD[7][1], ""), (6, ODD[8][1], "")]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(runs)
        again = {k + j for k, r in enumerate(runs) if many[r] > 1 for j in range(3)}
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_symbols"], got[d]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(again))
    assert quality.judged(empty(spark), labels).count() == 0


def test_quality_target_is_every_trusted_document(spark, monkeypatch):
    n = 21_000
    docs = [(i, f"same w{i}" if i % 3 else f"other v{i} v{i}", "en") for i in range(n)]
    table = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, int(i < 20_500)) for i in range(n)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "BUCKET_BYTES", 4)
    monkeypatch.setattr(quality, "HELD", 1000)
    size = quality.buckets(table)
    assert size > sum(len(t) for _, t, _ in docs) / 4 > quality.LEAST_BUCKETS
    grams = {}
    for d, t, _ in docs:
        buf = wordhash.as_array(t.encode())
        h = wordhash.hashes(buf, *wordhash.bounds(buf))
        grams[d] = [int(x) % size for x in [*h, *wordhash.windows(h, 2)]]
    raw, target = (Counter(g for d, gs in grams.items() if d < least for g in gs) for least in (n, 20_500))
    p, q = ({g: np.log((c[g] + 1) / (sum(c.values()) + size)) for g in raw} for c in (target, raw))
    want = {d: float(np.mean([p[g] - q[g] for g in gs])) for d, gs in grams.items()}
    for limit in (quality.BROADCAST_IDS, 0):
        monkeypatch.setattr(quality, "BROADCAST_IDS", limit)
        got = {r["doc_id"]: r["score"] for r in quality.judged(table, labels).collect()}
        assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-5


# 8 sharding


def placed(spark, docs, **options):
    path = new_path(spark, "shards")
    shards.write(docs, path, **options)
    return shards.read(spark, path).collect()


def test_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "en") for i in range(700)] + ODD, DOCS).withColumn("shard", F.lit(9)).withColumn("at", F.lit(3)).withColumn("before", F.lit("b")).withColumn("Bucket", F.lit(1))
    rows = placed(spark, docs, shards=5, bucket_bytes=2000)
    assert len(rows) == 700 + len(ODD) and {(r["at"], r["before"], r["Bucket"]) for r in rows} == {(3, "b", 1)}
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in rows)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 0 and r["doc_id"] is not None]
    assert order != sorted(order)
    assert placed(spark, empty(spark)) == []


def test_order_hangs_on_seed_and_records_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i * 7 % 90}", "en") for i in range(400)], DOCS)
    seen = set()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, deal in (("4", 1), ("7", 5), ("211", 3)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.add(tuple(sorted((r["doc_id"], r["shard"], r["slot"]) for r in placed(spark, docs.repartition(deal, "text"), bucket_rows=20))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen) == 1
    other = placed(spark, docs, bucket_rows=20, seed=3)
    assert tuple(sorted((r["doc_id"], r["shard"], r["slot"]) for r in other)) not in seen


def test_one_copy_more_moves_no_other_row(spark):
    docs = [(i, "t", "de") for i in range(300)]
    slots = []
    for n in (9, 10, 11, 12, 20):
        table = spark.createDataFrame([(1000, "same", "en")] * n + docs, DOCS)
        path = new_path(spark, "shards")
        shards.write(table, path, shards=2, bucket_rows=20, bucket_bytes=1 << 30)
        slots.append({(r["doc_id"], r["shard"], r["bucket"]) for r in spark.read.parquet(f"{path}/records").select("record.doc_id", "shard", "place.bucket").filter("doc_id < 1000").collect()})
    assert all(x == slots[0] for x in slots)


def test_fisher_yates_is_fair(spark):
    rows = spark.range(6000).select(F.col("id").alias("b"), shards.fisher_yates(F.lit(3), 5, "id").alias("p")).collect()
    n = Counter(tuple(r["p"]) for r in rows)
    assert len(n) == 6 and all(850 < k < 1150 for k in n.values())


def test_equal_rows_are_dealt_over_buckets(spark):
    docs = spark.createDataFrame([(7, "same", "en")] * 500 + [(i, "t", "de") for i in range(50)], DOCS)
    path = new_path(spark, "shards")
    shards.write(docs, path, shards=2, bucket_rows=50)
    assert spark.read.parquet(f"{path}/records").groupBy("shard", "place.bucket").count().agg(F.max("count")).first()[0] < 250
    rows = shards.read(spark, path).collect()
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(2)) and len(rows) == 550


def test_query_of_shards(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_two_pass_shuffle(spark, SF).collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"key"}
    for r in rows:
        t = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t)) and r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


# 9 and 10 tokens


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    uri = new_path(spark, "tokens")
    files = token_files.write(odd(spark).withColumn("start", F.lit(1)), uri, BYTE_BPE, end_id=2)
    rows = token_files.read(spark, uri, files).orderBy("start").collect()
    want = sorted(((d is not None, d or 0), tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x, _ in ODD)
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6]
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), struct.unpack(f"<{r['n_tokens']}I", r["ids"])) for r in rows)
    assert got == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.write(empty(spark), new_path(spark, "tokens"), BYTE_BPE) == []
    assert token_files.read(spark, uri, []).count() == 0
    fs, root = token_files.open_fs(uri)
    with fs.open_input_stream(f"{root}/{files[0]['name']}.idx") as f:
        index = np.frombuffer(f.read(), token_files.ENTRY)
    last = index[-1]
    assert len(token_files.read_at(uri, files[0]["name"], int(last["offset"]), int(last["size"]))) == last["n"]


def test_frames_are_verified():
    raw = token_files.frame(np.arange(5, dtype="<u2").tobytes(), 2)
    assert token_files.unframe(raw + b"more")[0].tolist() == [0, 1, 2, 3, 4]
    for k in (0, 9, 14):
        with pytest.raises((ValueError, struct.error)):
            token_files.unframe(raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :])


def test_pieces_split_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(BYTE_BPE), token_files.Encoder(BYTE_BPE)
    random.seed(8)
    signs = list("ab Z 's'll'T  \n\t\r\x0b\x1c\x85\xa0é²½×÷_-.,09%<|>ß 　日 ſŒ¿«'re") + ["<|endoftext|>"]
    for _ in range(3000):
        x = "".join(random.choice(signs) for _ in range(random.randint(0, 14)))
        assert e.text(x) == e.pack(t.encode(x, add_special_tokens=False).ids)


def test_word_table(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    table = odd(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("ids", "chunk", "row", "numbers", "number", "word", "_"))])
    for size in (bpe.CHUNK_BYTES, 40):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", size)
        coded = bpe.encode(table, WORD_BPE, decoded=True)
        rows = coded.collect()
        assert len(rows) == len(ODD) and coded.columns == ["doc_id", "text", "lang", "chunk", "row", "numbers", "number", "word", "_", "ids", "decoded"]
        for r in rows:
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(ids)}I", r["ids"])) == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)
            assert tuple(r)[3:9] == (1, 2, 3, 4, 5, 6)
    assert {(r["doc_id"], r["decoded"]) for r in bpe.decode(coded.select("doc_id", "ids"), WORD_BPE).collect()} == {(r["doc_id"], r["decoded"]) for r in rows}
    plain = bpe.encode(odd(spark), WORD_BPE, keep_text=False)
    assert plain.columns == ["doc_id", "lang", "ids"] and plain.count() == len(ODD)
    assert bpe.encode(empty(spark), WORD_BPE).count() == 0


def test_distinct_words_are_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    docs = spark.createDataFrame([(i, f"the same words and w{i % 30} ☃{i % 30}", "en") for i in range(300)], DOCS).repartition(5)
    rows = bpe.vocabularies(docs, "text", 3).collect()
    words = {}
    for r in rows:
        _, numbers, joined = bpe.unpacked("zstd", bytes(r["words"]))
        words |= {(r["chunk"], n): w for n, w in zip(np.frombuffer(numbers, "<u4").tolist(), joined.split(b" "))}
        assert {zlib.crc32(w) % 3 for w in joined.split(b" ")} == {r["part"]}
    assert len(words) > 64 == len(set(words.values()))
    seen = {}
    for r in bpe.coded(spark.createDataFrame(rows, "part int, chunk long, words binary"), WORD_BPE, 3).collect():
        number, size, ids = (np.frombuffer(x, "<u4") for x in bpe.unpacked("zstd", bytes(r["ids"]))[1:])
        for n, a, b in zip(number.tolist(), (np.cumsum(size) - size).tolist(), np.cumsum(size).tolist()):
            seen[(r["chunk"], n)] = ids[a:b].tolist()
    assert seen == {k: bpe.tokenizer(WORD_BPE).encode(w.decode(), add_special_tokens=False).ids for k, w in words.items()}


def test_chunks_in_another_order_still_encode():
    t = bpe.tokenizer(WORD_BPE)
    rng = random.Random(11)
    words = list(dict.fromkeys("".join(rng.choice("abcdefghij") for _ in range(6)).encode() for _ in range(60_000)))
    ids = dict(zip(words, (np.array(e.ids, "<u4").tobytes() for e in t.encode_batch([w.decode() for w in words], add_special_tokens=False))))
    held = bpe.packed("zstd", bpe.order_digest(words), np.array([len(ids[w]) // 4 for w in words], "<u4").tobytes(), b"".join(ids[w] for w in words))
    other = words[:]
    rng.shuffle(other)
    for order in (words, other, words[::-1], words[:-1]):
        assert bpe.known_ids(t, dict.fromkeys(order), held) == {w: ids[w] for w in order}

"""The pipeline's rows against its stages done plainly; the trained stage gives its own scores."""

import hashlib
import re
import struct

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import without_repeats

import corpus_pipeline
from gridloom.llm import toxicity

SF = "/root/testdata/sf0.001"


def near_copies(docs):
    sets = {}
    for d, t in docs.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                u, v = a, b
                while up[u] != u:
                    u = up[u]
                while up[v] != v:
                    v = up[v]
                up[max(u, v)] = min(u, v)
    return {d: t for d, t in docs.items() if up[d] == d}


def leaks(text, items):
    t = re.split(r"[\W_]+", text.lower())
    at = {}
    for k in range(len(t) - 2):
        at.setdefault(tuple(t[k : k + 3]), []).append(k)
    for s in items:  # at least 11 tokens: any stretch that counts has three equal tokens in a row
        n, w = len(s), min(len(s), 16)
        for begin in {p - k for k in range(n - 2) for p in at.get(tuple(s[k : k + 3]), ())}:
            e = [0 <= begin + k < len(t) and t[begin + k] == s[k] for k in range(n)]
            if any(sum(e[k : k + w]) >= w - w // 5 for k in range(n - w + 1)):
                return True
    return False


def test_pipeline_rows(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r["doc_id"]: r["text"] for r in scores.filter(F.col("score") < 0.5).collect()}
    shorter = without_repeats(list(left.items()), 5)
    left = {d: t for d, t in shorter.items() if t == left[d] or t.split()}
    left = near_copies(left)
    items = [[x for x in re.split(r"[\W_]+", r["text"].lower()) if x] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert min(map(len, items)) >= 11
    left = {d: t for d, t in left.items() if not leaks(t, items)}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, text in left.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[d] = (struct.pack(f"<{len(ids)}I", *ids), len(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (bytes(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want

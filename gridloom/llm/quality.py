"""Quality rules: plain counts of a text, and a hashed n-gram likelihood ratio.

Words are hashed into buckets as single words and as pairs; there is a bucket
for about BUCKET_BYTES of text, so the table follows the corpus. The raw corpus
is every document; the trusted target is every document whose label says quality
1. With smoothed multinomials p over the target's buckets and q over the
corpus', a document's score is the mean of log p - log q over its n-grams, so
length does not matter. A document is kept when no plain rule fails it and its
score reaches one threshold for all documents: that which best parts labelled
quality 1 from quality 0 (largest sum of the shares judged rightly, the lowest
such score on ties), or minus infinity where a class has no labelled row.

Null and empty texts have no words: counts of 0, score 0, failed by the rules.
Repeated rows count as often as they stand. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from . import wordhash as wh
from .common import Scratch, buffers, ship, shuffle_partitions, small_batches

#: Bytes of text to a bucket; the number of buckets is a power of two, LEAST_BUCKETS at least, dealt in PARTS.
BUCKET_BYTES, LEAST_BUCKETS, PARTS = 2048, 1 << 14, 1024
#: Trusted ids up to which they are broadcast, 8 bytes each, to the scan of the texts; beyond, the join shuffles.
BROADCAST_IDS = 8_000_000
#: N-grams that a task holds before it passes their counts on.
HELD = 1 << 22
SMOOTHING = 1.0
MIN_WORDS = 50
STEP = 0.005
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def buckets(docs: DataFrame, text: str = "text") -> int:
    """Buckets for the texts of docs."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << (-(-size // BUCKET_BYTES)).bit_length())


def ngrams(h: np.ndarray, size: int) -> np.ndarray:
    """Buckets, of size, of a text's words and word pairs."""
    found = [h] if len(h) < 2 else [h, wh.windows(h, 2)]
    return (np.concatenate(found) & np.uint64(size - 1)).astype(np.int64)


def counts(docs: DataFrame, trusted: DataFrame, size: int, text: str = "text") -> DataFrame:
    """part, n_raw, n_target, raw, target: n-grams of all documents and of the trusted ones, a row for size / PARTS buckets in order."""
    spark = docs.sparkSession
    ship(spark)
    width = size // PARTS
    offset = np.uint16 if 2 * width <= 1 << 16 else np.uint32
    plain = all(isinstance(t.schema["doc_id"].dataType, IntegralType) for t in (docs, trusted))
    if plain and trusted.count() <= BROADCAST_IDS:
        ids = np.sort(trusted.select(F.col("doc_id").cast("long")).toArrow().column(0).to_numpy())
        held = spark.sparkContext.broadcast(ids)
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("target"), text)
    else:
        held = None
        rows = docs.select("doc_id", text).join(trusted.select("doc_id", F.lit(True).alias("_target")), "doc_id", "left")
        rows = rows.select(F.lit(0).cast("long").alias("id"), F.coalesce("_target", F.lit(False)).alias("target"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.diff(first, append=len(key)).astype(np.uint32)
            key = key[first]
            part, at = np.unique(key // (2 * width), return_index=True)
            ends = [*at[1:].tolist(), len(key)]
            inside = (key % (2 * width)).astype(offset)
            slots, found = ([x[i:j].tobytes() for i, j in zip(at.tolist(), ends)] for x in (inside, many))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(slots, pa.binary()), pa.array(found, pa.binary())], ["part", "slots", "found"])

        for batch in small_batches(batches, text):
            mark = batch.column("target").to_numpy(zero_copy_only=False)
            if held is not None:
                mark = mark & np.isin(batch.column("id").to_numpy(), held.value)
            for target, b in zip(mark.tolist(), buffers(batch.column(text))):
                buf = wh.as_array(b)
                h = wh.hashes(buf, *wh.bounds(buf))
                if not len(h):
                    continue
                keys.append(2 * ngrams(h, size) + target)
                n += len(keys[-1])
                if n >= HELD:
                    yield from flush()
                    keys, n = [], 0
        if n:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots, found in zip(*(batch.column(c).to_pylist() for c in ("part", "slots", "found"))):
                sums.setdefault(part, np.zeros(2 * width, np.int64))[np.frombuffer(slots, offset)] += np.frombuffer(found, np.uint32)
        for part, both in sums.items():
            target = both[1::2]
            raw = both[::2] + target
            values = [[part], [int(raw.sum())], [int(target.sum())], [raw.tobytes()], [target.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["part", "n_raw", "n_target", "raw", "target"])

    parts = rows.mapInArrow(run, "part long, slots binary, found binary").repartition(shuffle_partitions(spark), "part")
    return parts.mapInArrow(add, "part long, n_raw long, n_target long, raw binary, target binary")


def ratios(counted: DataFrame, size: int) -> np.ndarray:
    """log p - log q of each bucket; 4 bytes a bucket reach the driver."""
    total = counted.agg(F.sum("n_raw").alias("raw"), F.sum("n_target").alias("target")).first()
    n_raw, n_target, width = total["raw"] or 0, total["target"] or 0, size // PARTS
    weight = np.zeros(size, np.float32)
    if not n_target:
        return weight
    ratio = lambda t, r: np.log((t + SMOOTHING) / (n_target + SMOOTHING * size)) - np.log((r + SMOOTHING) / (n_raw + SMOOTHING * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, target = ([np.frombuffer(v, np.int64) for v in batch.column(c).to_pylist()] for c in ("raw", "target"))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([ratio(t, r).astype(np.float32).tobytes() for t, r in zip(target, raw)], pa.binary())], ["part", "weight"])

    weight[:] = ratio(0, 0)  # of a part without n-grams
    for part, values in counted.select("part", "raw", "target").mapInArrow(run, "part long, weight binary").collect():
        weight[part * width : (part + 1) * width] = np.frombuffer(values, np.float32)
    return weight


def text_counts(b: memoryview | None, weight: np.ndarray) -> tuple:
    buf = wh.as_array(b)
    starts, ends = wh.bounds(buf)
    n = len(starts)
    if not n:
        return 0, 0, int(SYMBOL[buf].sum()), 0, 0, 0.0
    chars = int(np.count_nonzero(~wh.SEPARATOR[buf] & ((buf & 0xC0) != 0x80)))
    seen: set[bytes] = set()
    twice = 0
    for line in bytes(b).split(b"\n"):
        if line.strip():
            twice += line in seen
            seen.add(line)
    h = wh.hashes(buf, starts, ends)
    repeated = 0
    if n >= 3:
        _, back, many = np.unique(wh.windows(h, 3), return_inverse=True, return_counts=True)
        again = np.zeros(n + 2, bool)
        at = np.flatnonzero(many[back] > 1)
        for k in range(3):
            again[at + k] = True
        repeated = int(again.sum())
    return n, chars, int(SYMBOL[buf].sum()), twice, repeated, float(weight[ngrams(h, len(weight))].mean(dtype=np.float64))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, weight: Broadcast, text: str = "text") -> DataFrame:
    """doc_id, the plain counts and score of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            found = list(zip(*(text_counts(b, weight.value) for b in buffers(batch.column(text))))) or [()] * 6
            arrays = [pa.array(x, pa.int64()) for x in found[:5]] + [pa.array(found[5], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *COLUMNS, "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, score double")


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score that parts the labels best, among steps of STEP; a count a step that holds a labelled score reaches the driver."""
    met = scored.join(labels.select("doc_id", "quality").dropna(), "doc_id")
    bins = met.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")).orderBy("bin").collect()
    good, bad = (np.array([r[k] for r in bins], float) for k in ("good", "bad"))
    if not good.sum() or not bad.sum():
        return float("-inf")
    below = lambda x: np.concatenate([[0], np.cumsum(x)[:-1]]) / x.sum()
    return bins[int(np.argmax(below(bad) - below(good)))]["bin"] * STEP


def judged(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Every document's counts, score, base_failed and kept."""
    scratch = Scratch(docs.sparkSession)
    first = labels.filter("quality = 1").select("doc_id").dropna().distinct()
    size = buckets(docs, text)
    counted = scratch.put(counts(docs, first, size, text), "ngrams")
    weight = docs.sparkSession.sparkContext.broadcast(ratios(counted, size))
    scored = scratch.put(measured(docs, weight, text), "quality")
    least = threshold(scored.select("doc_id", "score"), labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(least))).alias("kept"))

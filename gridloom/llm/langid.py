"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is read as its letters in lower case, with one space for every run of
other characters and one at either end; features are its n-grams of 1 to 4
such characters (a space alone is none), hashed into BUCKETS. Counts by
language and bucket are taken over every document that may be learned from;
each task adds up its own before the shuffle. The matrix of log probabilities,
in whole multiples of 2^-16 so that sums are exact in any order, is broadcast:
its size is the number of languages, LANGUAGES at most, times BUCKETS times 4
bytes, whatever the corpus. Documents are scored in batches: the distinct
buckets of each with their counts, times rows of the matrix, added by document.

The predicted language is the likeliest one, the first by name on ties, and its
score the posterior probability. A text that is null or has no letter gets
`und` and 0, as does every text where nothing was learned. Documents whose
doc_id's checksum is divisible by FOLDS are held out, those with a null doc_id
too; null languages are not learned. Repeated rows count as often as they stand.
More than LANGUAGES distinct languages are refused with a ValueError. Long texts
are read a megabyte at a time; their counts are whole. Columns besides doc_id,
the text and the language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, ship, shuffle_partitions, small_batches
from .wordhash import mix

BITS, ORDER, FOLDS, LANGUAGES = 15, 4, 5, 256
BUCKETS, PARTS = 1 << BITS, 32
SMOOTHING, UNIT = 0.5, 1 << 16
#: Bytes of text whose n-grams a task holds at once.
HELD = 1 << 20
UNKNOWN, SPACE = "und", 32


@cache
def normal() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(b: bytes | memoryview) -> np.ndarray:
    return normal()[np.frombuffer(bytes(b).decode("utf-8", "replace").encode("utf-32-le"), "<u4")]


def squeezed(x: np.ndarray) -> np.ndarray:
    """One space for each run of them."""
    space = x == SPACE
    return x[np.concatenate([[True], ~(space[1:] & space[:-1])])]


def parts(b: memoryview) -> Iterator[memoryview]:
    """A text in parts of HELD bytes or a few more, cut between code points."""
    at = 0
    while at < len(b):
        end = min(len(b), at + HELD)
        while end < len(b) and b[end] & 0xC0 == 0x80:
            end += 1
        yield b[at:end]
        at = end


def segments(texts: list[memoryview | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Characters, the text that each belongs to and whether n-grams may end there, for about HELD bytes at a time.

    A further part of a long text begins with the last characters of the part before, at which no n-gram ends again.
    """
    held, size = [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars, of, fresh = zip(*held)
        lengths = [len(c) for c in chars]
        return np.concatenate(chars), np.repeat(np.array(of), lengths), np.concatenate([np.arange(n) >= f for n, f in zip(lengths, fresh)])

    for i, b in enumerate(texts):
        if not b:
            continue
        carry, fresh = np.full(1, SPACE, np.uint32), 1
        done = 0
        for part in parts(b):
            done += len(part)
            end = np.full(int(done == len(b)), SPACE, np.uint32)
            x = squeezed(np.concatenate([carry, letters(part), end]))
            held.append((x, i, fresh))
            size += len(part)
            carry = x[-(ORDER - 1) :]
            fresh = len(carry)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def buckets(chars: np.ndarray, of: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram and the text that it belongs to."""
    x = chars.astype(np.uint64)
    h, found, texts = x, [], []
    for n in range(1, ORDER + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
        own = fresh[n - 1 :] & (of[n - 1 :] == of[: len(of) - n + 1])
        if n == 1:
            own &= chars != SPACE
        found.append((mix(h[own] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        texts.append(of[n - 1 :][own])
        if len(h) < 2:
            break
    return np.concatenate(found), np.concatenate(texts)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


@dataclass
class Model:
    """Sorted languages, and by bucket and language the log probability in units of 1 / UNIT; priors likewise."""

    languages: list[str]
    weight: np.ndarray
    prior: np.ndarray


def counts(docs: DataFrame, languages: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """part, counts (languages by buckets of the part) and, in part 0, documents by language; a row a part."""
    place = {x: i for i, x in enumerate(languages)}
    width = BUCKETS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros((len(place), BUCKETS), np.int64), np.zeros(len(place), np.int64)
        for batch in small_batches(batches, "text"):
            of = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            n += np.bincount(of, minlength=len(place))
            for found in segments(list(buffers(batch.column("text")))):
                bucket, doc = buckets(*found)
                table += np.bincount(of[doc] * BUCKETS + bucket, minlength=table.size).reshape(table.shape)
        if n.any():
            for k in range(PARTS):
                made = pa.compress(table[:, k * width : (k + 1) * width].tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([made], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["part", "counts", "docs"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        size = 8 * len(place) * width
        for batch in batches:
            for k, b, n in zip(*(batch.column(c).to_pylist() for c in ("part", "counts", "docs"))):
                own = sums.setdefault(k, [np.zeros(len(place) * width, np.int64), np.zeros(len(place), np.int64)])
                own[0] += np.frombuffer(pa.decompress(b, size, "zstd", asbytes=True), np.int64)
                own[1] += np.array(n)
        for k, (c, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([c.tobytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["part", "counts", "docs"])

    schema = "part long, counts binary, docs array<long>"
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(run, schema)
    return rows.repartition(min(PARTS, shuffle_partitions(docs.sparkSession)), "part").mapInArrow(add, schema)


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of all documents with a language that are not held out."""
    ship(docs.sparkSession)
    learned = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(key)))
    found = [r[0] for r in learned.select(lang).distinct().limit(LANGUAGES + 1).collect()]
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    languages = sorted(found)
    table, n = np.zeros((len(languages), BUCKETS), np.int64), np.zeros(len(languages), np.int64)
    width = BUCKETS // PARTS
    for k, b, docs_of in counts(learned, languages, text, lang).collect() if languages else []:
        table[:, k * width : (k + 1) * width] = np.frombuffer(b, np.int64).reshape(len(languages), width)
        n = np.array(docs_of, np.int64)
    log = np.log(table + SMOOTHING) - np.log(table.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    prior = np.log(np.maximum(n, 1) / max(1, n.sum()))
    return Model(languages, np.rint(log.T * UNIT).astype(np.int32), np.rint(prior * UNIT).astype(np.int64))


def scores(texts: list[memoryview | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By text: the log probability of each language in units of 1 / UNIT, and whether the text has a letter."""
    total, lettered = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), bool)
    for chars, of, fresh in segments(texts):
        lettered[of[chars != SPACE]] = True
        bucket, doc = buckets(chars, of, fresh)
        if len(bucket):
            key, many = np.unique(doc * BUCKETS + bucket, return_counts=True)
            doc = key // BUCKETS
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total[doc[first]] += np.add.reduceat(model.weight[key % BUCKETS] * many[:, None], first)
    return total, lettered


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small_batches(batches, "text"):
            names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if m.languages:
                total, lettered = scores(list(buffers(batch.column("text"))), m)
                best = total.argmax(1)
                score = np.where(lettered, 1 / np.exp((total - total.max(1, keepdims=True)) / UNIT).sum(1), 0.0)
                names = [m.languages[k] if yes else UNKNOWN for k, yes in zip(best.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(names), pa.array(score)], [key, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents that are not held out and predict all."""
    return predicted(docs, trained(docs, key, text, lang), key, text)

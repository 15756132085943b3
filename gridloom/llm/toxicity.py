"""Toxicity by a subsequence string kernel with Nystroem landmarks, trained on labelled sentences.

A sentence ends at a newline, or at `.`, `!` or `?` before white space. It is
the list of its words; marks other than letters and digits are dropped, runs of
three or more single letters with white space between make one word more. A
word's features are its subsequences of three or four letters over at most
SPAN places, each weighted DECAY for a place skipped: inserted characters and
gaps lower the kernel of two words and leave it above zero. A word begins with
a boundary sign. Word kernels are normalised by the weight of the subsequences
one by one, whatever the word's length; the kernel of two sentences is the sum
of the kernels of their words.

The machine is a linear one with squared hinge loss over the Nystroem features
of labelled sentences: kernels with LANDMARKS landmarks, one-word sentences,
times the inverse square root of the landmarks' own kernel. Landmarks are words
that stand in far more toxic documents than chance explains, unlike each other,
clean words most like them, and clean words drawn by hash, likelier the more
documents hold them; every word of the sample can become one. Sentences of clean documents are negative. As a
toxic document doesn't say which of its sentences is toxic, all of them start
as positive; then, ROUNDS times, the highest sentence of each by the machine
itself is positive and its others have no say. A document scores by its highest
sentence, its highest word taken as a sentence, the sum of its positive words
and its number of words, through a logistic curve fitted on the training
documents.

The machine reads at most SAMPLE labelled toxic and CLEAN times as many clean
documents, those with the smallest hashes of doc_id, and of either class about
SENTENCES sentences at most, drawn by hash. Once fitted it is one table of
weights of subsequences, the same size for any corpus, and every document is
scored whole.

Null and empty texts have no words and score as an empty sentence. Where a
class has no labelled row, every document scores 0. Rows stay as they are;
repeated rows score alike; other columns pass through, score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import buffers, ship, small_batches
from .wordhash import as_array, mix, shingles

SAMPLE, CLEAN, SENTENCES, LANDMARKS, DECAY, SPAN, ROUNDS = 2_000, 2, 100_000, 128, 0.6, 5, 5
#: Standard deviations over chance, and share of a word's documents, from which a word may be a toxic landmark; the kernel from which two of them are alike.
SURE, PURE, ALIKE = 5.5, 0.75, 0.75
BOUNDARY, OTHER, DIGIT = 31, 27, 30
#: Offsets of the places of a subsequence after its first.
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)] + [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
TABLE = 1 << 20
#: Letters whose kernels are worked out at a time.
STRETCH = 1 << 14
#: Tasks that work out the features of the sample's sentences.
FIT_TASKS = 8


def _classes() -> np.ndarray:
    out = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        ch = chr(i)
        if ch.isspace():
            out[i] = BOUNDARY
        elif ch.isdigit():
            out[i] = DIGIT
        elif ch.isalpha():
            low = ch.lower()[0]
            out[i] = ord(low) - 96 if "a" <= low <= "z" else OTHER + ord(low) % 3
    return out


CLASSES = _classes()
STOP = np.zeros(0x250, bool)
STOP[[ord(c) for c in ".!?"]] = True
_weights = np.array([DECAY ** (p[-1] - len(p)) for p in PATTERNS])


def norm(size: np.ndarray | int) -> np.ndarray:
    """Square root of the weight of a word's subsequences by its length with the boundary; that of a short word is added, so that no word hangs on one subsequence."""
    own = lambda n: sum(w * w * np.maximum(0, np.asarray(n) - p[-1]) for w, p in zip(_weights, PATTERNS))
    return np.sqrt(own(size) + own(4))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the letters of all texts with boundaries between, and at each the sentence it is in and its text."""
    joined = "\n" + "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    far = code >= len(CLASSES)
    near = np.where(far, 0, code)
    c = CLASSES[near]
    if far.any():
        c[far] = OTHER + (code[far] % 3).astype(np.uint8)
    ends = code == 10
    ends[:-1] |= STOP[near[:-1]] & (c[1:] == BOUNDARY)
    sentence = np.cumsum(ends)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    keep = c > 0
    return c[keep], sentence[keep], np.concatenate([[0], text])[keep]


def words_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the boundaries before words, and of their ends."""
    edge = c == BOUNDARY
    start = np.flatnonzero(edge[:-1] & ~edge[1:])
    end = np.flatnonzero(~edge[:-1] & edge[1:]) + 1
    return start, end


def units(texts: list[str]) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Words as (classes, starts, ends, sentence), those that stand as such and then spread ones; and the text of each sentence."""
    c, sentence, text = letters(texts)
    start, end = words_of(c)
    if not len(start):
        return [], np.zeros(0, int)
    numbers, of = np.unique(sentence[start + 1], return_inverse=True)
    owner = np.zeros(len(numbers), int)
    owner[of] = text[start + 1]
    out = [(c, start, end, of)]
    one = np.concatenate([[False], (end - start == 2), [False]])
    turn = np.flatnonzero(one[1:] != one[:-1])
    runs = [(a, b) for a, b in zip(turn[::2], turn[1::2]) if b - a >= 3]
    if runs:
        letter = [c[start[a:b] + 1] for a, b in runs]
        joined = np.concatenate([np.concatenate([[BOUNDARY], r]) for r in letter] + [[BOUNDARY]]).astype(np.uint8)
        out.append((joined, *words_of(joined), of[[a for a, _ in runs]]))
    return out, owner


def codes(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern the feature at each place of c, whether it stays in one word, and its weight."""
    x = np.concatenate([c, np.full(SPAN, BOUNDARY, np.uint8)]).astype(np.int32)
    n = len(c)
    at = [x[k : n + k] for k in range(SPAN)]
    inside = [np.ones(n, bool)]
    for k in range(1, SPAN):
        inside.append(inside[-1] & (at[k] != BOUNDARY))
    for p, w in zip(PATTERNS, _weights):
        code = at[0] << 5 | at[p[0]]
        for k in p[1:]:
            code = code << 5 | at[k]
        yield code, inside[p[-1]], w


def on_grid(x: np.ndarray) -> np.ndarray:
    """The nearest multiples of 2^-30: their sums are exact in any order, so equal texts have equal scores wherever they stand."""
    return np.round(x * (1 << 30)) / (1 << 30)


def word_scores(c: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each word, the sum of its subsequences' weights over its norm."""
    sums = np.zeros(len(c) + 1)
    total = np.zeros(len(c))
    for code, inside, w in codes(c):
        total += np.where(inside, table[code], 0) * w
    np.cumsum(on_grid(total), out=sums[1:])
    return on_grid((sums[end] - sums[start]) / norm(end - start))


class Landmarks:
    """Words as class sequences, and for each subsequence of theirs its weights in them."""

    def __init__(self, words: list[bytes]):
        self.words = words
        found: dict[int, int] = {}
        rows, cols, values = [], [], []
        for j, word in enumerate(words):
            for code, inside, w in codes(np.frombuffer(word, np.uint8)):
                for k in code[inside].tolist():
                    rows.append(found.setdefault(k, len(found)))
                    cols.append(j)
                    values.append(w / float(norm(len(word))))
        self.weight = np.zeros((len(found), len(words)), np.float32)
        np.add.at(self.weight, (rows, cols), values)
        self.row = np.full(TABLE, -1, np.int32)
        self.row[list(found)] = list(found.values())
        self.found = np.array(list(found))

    def kernels(self, words: list[bytes]) -> np.ndarray:
        """Normalised kernels of words with the landmarks, STRETCH letters at a time, within words too."""
        c = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        out = np.zeros((len(words), len(self.words)))
        for at in range(0, len(c), STRETCH):
            of, first = np.unique(word[at : at + STRETCH], return_index=True)
            n = min(STRETCH, len(c) - at)
            total = np.zeros((n, len(self.words)), np.float32)
            for code, inside, w in codes(c[at : at + STRETCH + SPAN]):
                row = self.row[code[:n]]
                hit = np.flatnonzero(inside[:n] & (row >= 0))
                total[hit] += np.float32(w) * self.weight[row[hit]]
            out[of] += np.add.reduceat(total, first, axis=0, dtype=np.float64)
        return (out / norm(size)[:, None]).astype(np.float32)

    def table(self, beta: np.ndarray, offset: float) -> np.ndarray:
        """The weight of each subsequence in a machine with weights beta of the kernels; its offset comes last."""
        out = np.zeros(TABLE + 1)
        out[self.found] = self.weight @ beta
        out[TABLE] = offset
        return out


def sequence(word: str) -> bytes:
    """A word's classes after its boundary."""
    c, _, _ = letters([word])
    return c[:-1].tobytes()


def chosen(counted: DataFrame) -> Landmarks | None:
    """Landmarks among all words of counted (word, t toxic documents of n); None where there is no word."""
    whole = counted.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not whole["n"]:
        return None
    rate = whole["t"] / whole["n"]
    over = counted.withColumn("over", (F.col("t") - F.col("n") * rate) / F.sqrt("n"))
    least = SURE * (rate * (1 - rate)) ** 0.5
    sure = (F.col("over") > least) & (F.col("t") >= PURE * F.col("n"))
    found = over.agg(F.count_if(sure).alias("sure"), F.max("over").alias("top")).first()
    marks: list[bytes] = []
    for r in over.filter(sure if found["sure"] else F.col("over") >= found["top"]).orderBy(F.desc("over"), "word").select("word").toLocalIterator():
        word = sequence(r["word"])
        if not marks or Landmarks(marks).kernels([word]).max() < ALIKE:
            marks.append(word)
        if len(marks) == LANDMARKS // 2:
            break

    def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = Landmarks(marks)
        for batch in batches:
            like = toxic.kernels([sequence(w) for w in batch.column("word").to_pylist()]).max(1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(like.astype(float))], ["word", "n", "like"])

    clean = counted.filter(F.col("t") < 0.5 * F.col("n")).select("word", "n")
    near = clean.mapInArrow(likeness, "word string, n long, like double").orderBy(F.desc(F.round(F.col("like") * F.log1p("n"), 6)), "word").limit(LANDMARKS // 3)
    drawn = -F.log((F.pmod(F.xxhash64("word"), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("n")
    spread = clean.orderBy(drawn, "word").limit(LANDMARKS // 6)
    words = [r["word"] for part in (near, spread) for r in part.collect()]
    return Landmarks(marks + [sequence(w) for w in dict.fromkeys(words)])


def whitening(landmarks: Landmarks) -> np.ndarray:
    """The inverse square root of the landmarks' own kernel."""
    own = landmarks.kernels(landmarks.words).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value[-1]
    return vector[:, good] / np.sqrt(value[good])


def fit(x: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a sentence's features, the offset last: squared hinge loss, Newton steps, the highest sentence of a toxic document again each round."""
    parts = [slice(a, a + 20_000) for a in range(0, len(x), 20_000)]
    full = lambda p: np.hstack([x[p].astype(np.float32), np.ones((len(x[p]), 1), np.float32)])
    w = np.zeros(x.shape[1] + 1)
    y = np.where(toxic == 1, 1.0, -1.0)
    order = np.argsort(doc, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]]))
    for _ in range(ROUNDS + 1):
        weight = np.where(y > 0, (y < 0).sum() / (2 * max(1, (y > 0).sum())), 1.0) * (y != 0)
        for _ in range(12):
            h, g = np.eye(len(w)), np.zeros(len(w))
            for p in parts:
                d = full(p)
                bad = (y[p] * (d @ w) < 1) & (y[p] != 0)
                d, v = d[bad].astype(float), weight[p][bad]
                h += (d * v[:, None]).T @ d
                g += (d * v[:, None]).T @ y[p][bad]
            new = np.linalg.solve(h, g)
            done, w = np.abs(new - w).max() < 1e-4, new
            if done:
                break
        f = np.concatenate([full(p) @ w for p in parts])
        top = np.maximum.reduceat(f[order], first)
        highest = np.empty(len(f))
        highest[order] = np.repeat(top, np.diff(first, append=len(f)))
        y = np.where(toxic == 0, -1.0, np.where(f == highest, 1.0, 0.0))
    return w


def document_scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Of each text: its highest sentence, its highest word as a sentence, and the logs of one plus the sum of its positive words and plus their number."""
    offset = on_grid(table[TABLE])
    groups, owner = units(texts)
    top, word, total, many = np.full(len(texts), -np.inf), np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))
    sentence = np.full(len(owner), offset)
    for c, start, end, of in groups:
        score = word_scores(c, start, end, table)
        sentence += np.bincount(of, score, len(owner))
        at = owner[of]
        np.maximum.at(word, at, score + offset)
        total += np.bincount(at, np.maximum(score + offset, 0), len(texts))
        many += np.bincount(at, minlength=len(texts))
    np.maximum.at(top, owner, sentence)
    none = many == 0
    top[none] = word[none] = offset
    return np.stack([top, word, np.log1p(total), np.log1p(many)], 1)


def raw_scores(docs: DataFrame, table: np.ndarray, text: str) -> DataFrame:
    """A struct `row` of the columns of docs, and raw, four numbers for each document."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(table)  # 8 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 18):
            texts = [bytes(b).decode("utf-8", "replace") if b else "" for b in buffers(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(document_scores(texts, held.value).tolist(), pa.list_(pa.float64()))], ["row", "raw"])

    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("raw", T.ArrayType(T.DoubleType()))]))


def document_words(docs: DataFrame) -> DataFrame:
    """word, toxic, key: each distinct word of each document, its label, and what near copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words, toxic, keys = [], [], []
            for b, t in zip(buffers(batch.column("text")), batch.column("toxic").to_pylist()):
                own = {"".join(ch for ch in w if ch.isalnum()) for w in set(bytes(b).decode("utf-8", "replace").lower().split())} if b else set()
                own.discard("")
                words += own
                toxic += [t] * len(own)
                shared = shingles(as_array(b), 5)
                keys += [int(shared[0] >> np.uint64(1)) if len(shared) else 0] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(keys, pa.int64())], ["word", "toxic", "key"])

    return docs.select("text", "toxic").mapInArrow(run, "word string, toxic int, key long")


def sentence_features(docs: DataFrame, landmarks: Landmarks, half: np.ndarray, share: dict[int, float]) -> DataFrame:
    """doc, toxic and x (2-byte floats) of sentences of docs (doc, toxic, text), of each class a share drawn by hash."""
    held = docs.sparkSession.sparkContext.broadcast((landmarks, half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, half = held.value
        known: dict[bytes, int] = {}
        made = np.empty((0, half.shape[1]), np.float32)
        for batch in small_batches(batches, "text", 1 << 20):
            texts = [bytes(b).decode("utf-8", "replace") if b else "" for b in buffers(batch.column("text"))]
            doc, label = (batch.column(c).to_numpy() for c in ("doc", "toxic"))
            groups, owner = units(texts)
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            draw = mix(doc[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64)) / np.float64(1 << 64)
            kept = draw < np.array([share[0], share[1]])[label[owner]]
            at, of = [], []
            for c, start, end, sentence in groups:
                raw = c.tobytes()
                use = kept[sentence]
                at += [known.setdefault(raw[a:b], len(known)) for a, b in zip(start[use].tolist(), end[use].tolist())]
                of.append(sentence[use])
            if not at:
                continue
            new = list(known)[len(made) :]
            if new:
                made = np.vstack([made, marks.kernels(new) @ half.astype(np.float32)])
            at, of = np.array(at), np.concatenate(of)
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            for cut in range(0, len(of), 50_000):  # words at a time; a sentence may be cut, so its parts are summed
                ids, first = np.unique(of[cut : cut + 50_000], return_index=True)
                x = np.add.reduceat(made[at[cut : cut + 50_000]], first, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[owner[ids]]), pa.array(ids), pa.array(label[owner[ids]], pa.int32()), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["doc", "n", "toxic", "x"]
                )

    return docs.select("doc", "toxic", "text").mapInArrow(run, "doc long, n long, toxic int, x binary").select("doc", "toxic", "x")


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of a curve through the documents' numbers and labels, slightly held back; classes weigh alike."""
    d = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    w = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (weight * (p - y)) + 0.05 * w
        h = (d * (weight * p * (1 - p))[:, None]).T @ d + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """doc (a hash of the id), toxic and text of the bounded sample of labelled documents outside the held-out fold."""
    known = labels.select("doc_id", "toxic").dropna().filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    few = [known.filter(F.col("toxic") == k).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE if k else SAMPLE * CLEAN).collect() for k in (0, 1)]
    rows = docs.sparkSession.createDataFrame([tuple(r) for part in few for r in part], known.schema)
    met = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id")  # a bounded sample
    return met.select(F.xxhash64("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic"), "text")


def trained(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """The table of weights of subsequences and the curve; None where a class has no labelled row."""
    ship(docs.sparkSession)
    sample = training_rows(docs, labels, text).cache()
    try:
        return fitted(sample)
    finally:
        sample.unpersist()


def fitted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The machine of a bounded sample (doc, toxic, text)."""
    ends = F.size(F.split(F.coalesce("text", F.lit("")), r"\n|[.!?](?=\s)"))
    sizes = {r["toxic"]: r for r in sample.groupBy("toxic").agg(F.sum(ends.cast("long")).alias("s")).collect()}
    if 0 not in sizes or 1 not in sizes:
        return None
    counted = document_words(sample).distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).cache()
    landmarks = chosen(counted)
    counted.unpersist()
    if landmarks is None:
        return None
    half = whitening(landmarks)
    share = {k: min(1.0, SENTENCES / max(1, sizes[k]["s"])) for k in (0, 1)}
    found = sentence_features(sample.repartition(FIT_TASKS, "doc"), landmarks, half, share).toArrow()
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, half.shape[1])
    w = fit(x, *(found.column(c).to_numpy() for c in ("doc", "toxic")))
    table = landmarks.table(half @ w[:-1], w[-1])
    scores = raw_scores(sample, table, "text").select("raw", "row.toxic").collect()
    return table, logistic(*(np.array([r[k] for r in scores], float) for k in ("raw", "toxic")))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs and score, 0 to 1."""
    keep = [c for c in docs.columns if c != "score"]
    machine = trained(docs, labels, text)
    if machine is None:  # nothing to learn from
        return docs.select(*keep, F.lit(0.0).alias("score"))
    table, (*slopes, offset) = machine
    curve = sum((F.col("raw")[i] * float(v) for i, v in enumerate(slopes)), F.lit(float(offset)))
    return raw_scores(docs, table, text).select(*[F.col("row")[c].alias(c) for c in keep], (1 / (1 + F.exp(-curve))).alias("score"))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored(docs.select("doc_id", text), labels, text).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

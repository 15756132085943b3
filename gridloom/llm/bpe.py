"""BPE encoding and decoding through one table of the corpus's distinct words.

Texts are split into words at ASCII white space, in chunks of about CHUNK_BYTES
of text; a chunk numbers its distinct words in the order in which they come.
Spark deals chunks' words by hash into parts, so equal words of all chunks meet
in one part of the table, which follows the corpus in number of parts, and each
distinct word is encoded once. Its ids go back to the chunks that number it, a
file a chunk in the shared folder, and the texts, read again, join them by
position: the k-th distinct word of a chunk takes the k-th ids. White space never joins two words' pieces, so ids of words
put together are ids of the text. Decoding joins ids with the tokenizer's
pieces, a table as long as the vocabulary; for a text that is being encoded
this is done once for each distinct word of its chunk, and decoded words with a
space between are the decoded text.

Shuffled are words and ids, packed by chunk and part; a word goes once for a
chunk that holds it, however often it stands there, and positions never do. A
word that every text holds comes once from a chunk, with the chunk's thousands. A digest of a
chunk's words in their order goes with them: a chunk that comes in another order
when it is read again has another digest, and its words are encoded where they
stand.

Null texts count as empty: no ids, empty decoded text. Rows stay as they are,
repeated ones too; columns besides the text pass through, and columns of the
names ids and decoded are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, buffers, new_path, pieces, release, ship, shuffle_partitions, small_batches
from .token_files import open_fs

#: Bytes of text whose words are numbered together, and bytes of text to a part of the table of distinct words.
CHUNK_BYTES, PART_BYTES = 16 << 20, 32 << 20

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = _tokenizers[path] = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _tokenizers[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece of the whole vocabulary."""
    t = tokenizer(path)
    size = t.get_vocab_size(with_added_tokens=True)
    return spark.createDataFrame([(i, t.id_to_token(i) or "") for i in range(size)], "id int, piece string").coalesce(1)


def words_of(b: memoryview | None) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time."""
    for part in pieces(bytes(b)) if b is not None else ():
        yield part.split()


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[memoryview | None]]]:
    """Runs of rows with the number of their chunk; chunks are cut by the texts alone."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in small_batches(batches, "text"):
        texts = list(buffers(batch.column("text")))
        first = 0
        for i, b in enumerate(texts):
            size += len(b) if b is not None else 0
            if size >= CHUNK_BYTES:
                yield chunk, batch.slice(first, i + 1 - first), texts[first : i + 1]
                chunk, size, first = chunk + 1, 0, i + 1
        if first < len(texts):
            yield chunk, batch.slice(first), texts[first:]


def packed(kind: str, *parts: bytes) -> bytes:
    """Parts with their lengths, compressed."""
    raw = b"".join(struct.pack("<Q", len(p)) + p for p in parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, kind, asbytes=True)


def unpacked(kind: str, b: bytes | memoryview) -> list[bytes]:
    raw, out, at = pa.decompress(b[8:], struct.unpack("<Q", b[:8])[0], kind, asbytes=True), [], 0
    while at < len(raw):
        (n,) = struct.unpack("<Q", raw[at : at + 8])
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def order_digest(words: Iterable[bytes]) -> bytes:
    """16 bytes that tell lists of words apart, their order included."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def vocabularies(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """part, chunk, words: of the distinct words of each chunk, numbered in the order in which they come, those whose hash falls into a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if not known:
                return
            words = list(known)
            digest = order_digest(words)
            part = np.array([zlib.crc32(w) for w in words], np.uint32) % np.uint32(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                own = order[a:b]
                rows.append(packed("zstd", digest, own.astype("<u4").tobytes(), b" ".join([words[i] for i in own.tolist()])))
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts].astype(np.int32)), pa.array(np.full(len(cuts), at)), pa.array(rows, pa.binary())], ["part", "chunk", "words"])

        for chunk, _, texts in chunked(batches):
            if chunk != at:
                yield from flush()
                at, known = chunk, {}
            for b in texts:
                for words in words_of(b):
                    known.update(dict.fromkeys(words))
        yield from flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, chunk long, words binary")


def coded(words: DataFrame, path: str, parts: int) -> DataFrame:
    """chunk and ids: digest of the chunk's words, and numbers, lengths and ids of those of a part. Equal words of all chunks meet in one task, which encodes each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        distinct: dict[bytes, int] = {}
        lists = []
        for batch in batches:
            for chunk, b in zip(batch.column("chunk").to_pylist(), buffers(batch.column("words"))):
                digest, numbers, joined = unpacked("zstd", b)
                lists.append((chunk, digest, numbers, np.array([distinct.setdefault(w, len(distinct)) for w in joined.split(b" ")], np.int64)))
        table = list(distinct)
        size, flat = np.zeros(len(table), np.int64), []
        for at in range(0, len(table), 10_000):
            for k, e in enumerate(encode([w.decode("utf-8", "replace") for w in table[at : at + 10_000]], add_special_tokens=False), at):
                size[k] = len(e.ids)
                flat.append(np.array(e.ids, "<u4"))
        ids = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        first = np.cumsum(size) - size
        for at in range(0, len(lists), 64):
            some = lists[at : at + 64]
            made = [packed("zstd", digest, numbers, size[k].astype("<u4").tobytes(), ids[stretches(first[k], size[k])].tobytes()) for _, digest, numbers, k in some]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in some], pa.int64()), pa.array(made, pa.binary())], ["chunk", "ids"])

    return words.repartition(parts, "part").mapInArrow(run, "chunk long, ids binary")


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places from each first on, size of them."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def store(rows: DataFrame, uri: str) -> None:
    """A file for each chunk: the digest of its words, the lengths of their ids in the order of the words, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        at, parts = None, []

        def flush() -> None:
            if parts:
                number, size, ids = (np.concatenate([np.frombuffer(p[k], "<u4") for p in parts]) for k in (1, 2, 3))
                order = np.argsort(number)
                many = size.astype(np.int64)
                first = np.cumsum(many) - many
                with fs.open_output_stream(f"{root}/{at}.{attempt}") as f:
                    f.write(packed("zstd", parts[0][0], size[order].tobytes(), ids[stretches(first[order], many[order])].tobytes()))
                fs.move(f"{root}/{at}.{attempt}", f"{root}/{at}")

        for batch in batches:
            for chunk, b in zip(batch.column("chunk").to_pylist(), buffers(batch.column("ids"))):
                if chunk != at:
                    flush()
                    at, parts = chunk, []
                parts.append(unpacked("zstd", b))
        flush()
        yield from ()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "chunk").sortWithinPartitions("chunk")
    dealt.mapInArrow(run, "done int").count()


def known_ids(t, words: dict[bytes, None], held: bytes) -> dict[bytes, bytes]:
    """Ids by word of a chunk: those of its file where the file was made of the same words in the same order, else encoded here."""
    digest, size, raw = unpacked("zstd", held) if held else (b"", b"", b"")
    if digest == order_digest(words):
        ends = (4 * np.concatenate([[0], np.cumsum(np.frombuffer(size, "<u4"), dtype=np.int64)])).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, ends, ends[1:])}
    made = t.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
    return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, made)}


class Decoded(dict):
    """Decoded texts by ids of a word: its pieces with a space between."""

    def __init__(self, pieces_: list[str]):
        self.pieces = pieces_

    def __missing__(self, ids: bytes) -> str:
        out = self[ids] = " ".join([self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return out


def encode(docs: DataFrame, path: str, text: str = "text", keep_text: bool = True, decoded: bool = False) -> DataFrame:
    """Add ids (binary, 4 bytes an id, little-endian) and, if asked, decoded."""
    spark = docs.sparkSession
    ship(spark)
    uri = new_path(spark, "vocabularies")
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    store(coded(vocabularies(docs, text, parts), path, parts), uri)
    release(spark)
    keep = [c for c in docs.columns if c.lower() not in ("ids", "decoded") and (keep_text or c != text)]
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    names = [*keep, "ids", *["decoded"] * decoded]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        t = tokenizer(path)
        table = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))] if decoded else []
        for chunk, runs in itertools.groupby(chunked(batches), lambda x: x[0]):
            runs, words, held = [(batch, texts) for _, batch, texts in runs], {}, b""
            for _, texts in runs:
                for b in texts:
                    for some in words_of(b):
                        words.update(dict.fromkeys(some))
            if fs.get_file_info(f"{root}/{chunk}").is_file:
                with fs.open_input_stream(f"{root}/{chunk}") as f:
                    held = f.read()
            known, shown = known_ids(t, words, held), Decoded(table)
            for batch, texts in runs:
                ids, out = [], []
                for b in texts:
                    own = [known[w] for some in words_of(b) for w in some]
                    ids.append(b"".join(own))
                    if decoded:
                        out.append(" ".join([shown[x] for x in own if x]))
                row = batch.column("row")
                columns = [row.field("kept").field(c) for c in keep] + [pa.array(ids, pa.binary())] + ([pa.array(out, pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.struct(F.lit(0).alias("none"), *kept).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add decoded, the pieces of the ids with a space between; null ids give null. Ids: an array, or binary of 4 bytes an id.

    Each id joins its piece, and pieces are put in order of position again.
    """
    keep = [c for c in rows.columns if c.lower() != "decoded"]
    kind = dict(rows.dtypes)[ids]
    listed = F.col(ids)
    if kind == "binary":
        # Cut as a whole into words of eight hexadecimal digits: a lambda that reads the binary copies it for each id.
        turned = lambda h: F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
        listed = F.transform(F.regexp_extract_all(F.hex(ids), F.lit("(.{8})")), lambda h: F.conv(turned(h), 16, 10).cast("int"))
    pieces_ = piece_table(rows.sparkSession, path)
    tagged = rows.select(F.struct(*[F.col(c) for c in keep]).alias("r"), listed.alias("l")).withColumn("n", F.monotonically_increasing_id())
    tagged = Scratch(rows.sparkSession).put(tagged, "tagged")
    spread = tagged.select("n", F.posexplode("l").alias("at", "id")).join(F.broadcast(pieces_), "id")
    put = spread.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), " ").alias("decoded"))
    return tagged.join(put, "n", "left").select("r.*", F.when(F.col("l").isNotNull(), F.coalesce("decoded", F.lit(""))).alias("decoded"))


def digests(rows: DataFrame) -> DataFrame:
    """The digest columns of ids and decoded."""
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

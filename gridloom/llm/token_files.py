"""Token ids in length-delimited binary records with a separate offset index.

A data file is a run of frames: length (u64), masked checksum of the length
(u32), the serialised sequence, masked checksum of the sequence (u32), all
little-endian. The checksum is zlib's crc32, masked as rotate right by 15 plus
0xa282ead8. A sequence is one byte with the width of an id (2 where every id
of the vocabulary fits, else 4) and the ids. The index file has an entry of 32
bytes a record: offset (u64), frame bytes (u64), doc_id (i64), ids (u32), and
1 if the doc_id is null (u32), so a shuffled read needs no scan.

Documents are dealt by range of doc_id and sorted, so files in name order hold
ascending doc_ids, nulls first, repeated ids by checksum of the text. A task
writes under a name of its attempt and moves the file into place, so a task
that runs again leaves the same file.

Null texts count as empty and give a record with the end id alone. An empty
table gives no file. Columns besides doc_id and the text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import buffers, ship, shuffle_partitions, small_batches

#: Pieces a worker keeps, some 200 bytes each.
TABLE_WORDS = 1_000_000
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("doc_id", "<i8"), ("n", "<u4"), ("null", "<u4")])
#: Letters, digits and marks for which the pattern below splits as the tokenizer's own pattern does.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ¡¿«»]*")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ſ]+|\s+(?!\S)|\s+")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Known(dict):
    """Packed ids of the pieces between which the tokenizer never merges; starts anew at TABLE_WORDS."""

    def __init__(self, tokenizer, code: str):
        self.encode, self.code = tokenizer.encode, code

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= TABLE_WORDS:
            self.clear()
        ids = self[piece] = array(self.code, self.encode(piece, add_special_tokens=False).ids).tobytes()
        return ids


class Encoder:
    """The tokenizer, with a table of pieces by worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(self.tokenizer, "H" if self.width == 2 else "I")

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def text(self, t: str) -> bytes:
        """Ids of a text; those with rare characters or special tokens go to the tokenizer whole."""
        if PLAIN.fullmatch(t) and not any(s in t for s in self.special):
            return b"".join(map(self.known.__getitem__, SPLIT.findall(t)))
        return self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.text(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def frame(ids: bytes, width: int) -> bytes:
    data = bytes([width]) + ids
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def unframe(raw: bytes) -> tuple[np.ndarray, int]:
    """Ids of the frame at the start of raw, and the frame's size; both checksums are verified."""
    head = raw[:8]
    (size,) = struct.unpack("<Q", head)
    data = raw[12 : 12 + size]
    if struct.unpack("<I", raw[8:12])[0] != masked(head) or struct.unpack("<I", raw[12 + size : 16 + size])[0] != masked(data):
        raise ValueError("a record's checksum doesn't hold")
    return np.frombuffer(data, f"<u{data[0]}", offset=1), 16 + size


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, uri: str, path: str, end_id: int = 2, text: str = "text") -> list[dict]:
    """Write data and index files under uri; returns a row for each file (one a partition)."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, (fs, root), task = encoder(path), open_fs(uri), TaskContext.get()
        name, attempt = f"{root}/part-{task.partitionId():06d}", task.taskAttemptId()
        at = tokens = rows = 0
        out = index = None
        end = e.pack([end_id])
        for batch in small_batches(batches, text):
            if out is None:
                fs.create_dir(root, recursive=True)
                out, index = (fs.open_output_stream(f"{name}.{k}.{attempt}") for k in ("rec", "idx"))
            ids = e([bytes(b).decode("utf-8", "replace") if b else "" for b in buffers(batch.column(text))])
            entries = np.zeros(len(ids), ENTRY)
            for i, (x, doc) in enumerate(zip(ids, batch.column("doc_id").to_pylist())):
                f = frame(x + end, e.width)
                out.write(f)
                n = len(x) // e.width + 1
                entries[i] = (at, len(f), doc or 0, n, doc is None)
                at, tokens, rows = at + len(f), tokens + n, rows + 1
            index.write(entries.tobytes())
        if out is not None:
            out.close()
            index.close()
            for k in ("idx", "rec"):
                fs.move(f"{name}.{k}.{attempt}", f"{name}.{k}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (os.path.basename(name), rows, tokens, at)], ["name", "n_docs", "n_ids", "bytes"])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.crc32(F.coalesce(text, F.lit(""))))
    )
    made = ordered.mapInArrow(run, "name string, n_docs long, n_ids long, bytes long").collect()
    return sorted((r.asDict() for r in made), key=lambda r: r["name"])


def read(spark: SparkSession, uri: str, files: list[dict]) -> DataFrame:
    """Records in file order: doc_id, start (ids before it), n_tokens, ids (u32, little-endian)."""
    ship(spark)
    start, rows = 0, []
    for f in files:
        rows.append((f["name"], start))
        start += f["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        for name, begin in ((n, b) for batch in batches for n, b in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist())):
            with fs.open_input_stream(f"{root}/{name}.idx") as f:
                index = np.frombuffer(f.read(), ENTRY)
            with fs.open_input_stream(f"{root}/{name}.rec") as f:
                cut = np.cumsum(index["size"]) // (4 << 20)
                for g in np.unique(cut):
                    part = index[cut == g]
                    ids = []
                    for size in part["size"].tolist():
                        got, n = unframe(f.read(size))
                        if n != size:
                            raise ValueError("the index and a record differ in size")
                        ids.append(got.astype("<u4").tobytes())
                    counts = part["n"].astype(np.int64)
                    first = begin + np.cumsum(counts) - counts
                    begin += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["doc_id"], mask=part["null"] > 0), pa.array(first), pa.array(counts), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "name string, start long").repartition(max(1, min(len(rows), shuffle_partitions(spark))), "name")
    return listed.mapInArrow(run, schema)


def read_at(uri: str, name: str, offset: int, size: int) -> np.ndarray:
    """One record by its index entry, for shuffled reads."""
    fs, root = open_fs(uri)
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        f.seek(offset)
        return unframe(f.read(size))[0]


def digests(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Fill-in-middle transformation through a sparse checkpoint index.

A text is cut after two drawn numbers of units (lines or code points) into
prefix, middle and suffix. One pass over its bytes counts the units and records,
every EVERY units, the number of the unit with the byte and code-point offset
of its start. A cut is found by binary search among these checkpoints and a
short scan from the one before it, so the index is a small part of the text and
no list of units is made.

Draws are the first four groups of eight digits of the hexadecimal SHA-256 of
`seed:key`, so they hang on the key alone. The form is plain (the text as it
is) where the text is empty or holds a mark, or by the draw; else spm or psm.
Marks have `<` at their start alone, so the marks of an output are those that
were put there, and `restored` gets the text back by splitting at them.

Null texts count as empty; a null key counts as an empty one. Rows stay as they
are, equal rows get equal results. All columns pass through; those of the names
n, form, prefix_chars, middle_chars, output and restored are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import buffers, ship, small_batches
from .wordhash import as_array

#: Units between two checkpoints, and bytes that are counted at once.
EVERY, BLOCK = 64, 1 << 20
MARKS = ("<P>", "<S>", "<M>")
OWN = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


def line_starts(buf: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether a line starts at each of the bytes a to b."""
    out = np.empty(b - a, bool)
    out[0] = a == 0 or buf[a - 1] == 10
    np.equal(buf[a : b - 1], 10, out=out[1:])
    return out


def leads(buf: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether a code point starts at each of the bytes a to b."""
    return (buf[a:b] & 0xC0) != 0x80


STARTS = {"line": line_starts, "char": leads}


class Index:
    """The number of units of a text, and checkpoints by which any unit's start is found."""

    def __init__(self, buf: np.ndarray, unit: str = "line", every: int = EVERY, block: int = BLOCK):
        self.buf, self.starts, self.n, self.chars = buf, STARTS[unit], 0, 0
        self.unit, self.byte, self.char = array("q"), array("q"), array("q")
        for a in range(0, len(buf), block):
            b = min(len(buf), a + block)
            at, lead = np.flatnonzero(self.starts(buf, a, b)), leads(buf, a, b)
            kept = at[-self.n % every :: every]
            if len(kept):
                before = np.cumsum(lead)[kept] - lead[kept]
                first = self.n + -self.n % every
                for held, new in ((self.unit, first + every * np.arange(len(kept))), (self.byte, a + kept), (self.char, self.chars + before)):
                    held.frombytes(new.astype(np.int64).tobytes())
            self.n += len(at)
            self.chars += int(np.count_nonzero(lead))

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code-point offset after so many units."""
        if units >= self.n:
            return len(self.buf), self.chars
        k = bisect_right(self.unit, units) - 1
        left, at, chars = units - self.unit[k], self.byte[k], self.char[k]
        end = self.byte[k + 1] if k + 1 < len(self.byte) else len(self.buf)
        while at < end:
            to = min(end, at + BLOCK)
            found = np.flatnonzero(self.starts(self.buf, at, to))
            if left < len(found):
                to = at + int(found[left])
                return to, chars + int(np.count_nonzero(leads(self.buf, at, to)))
            left -= len(found)
            chars += int(np.count_nonzero(leads(self.buf, at, to)))
            at = to
        raise AssertionError("a checkpoint's stretch holds its units")


def draws(key: str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50,
    marks: tuple[str, str, str] = MARKS, every: int = EVERY, keep: list[str] | None = None,
) -> DataFrame:
    """The columns of docs (those of keep, if given) with n, form, prefix_chars, middle_chars and output."""
    ship(docs.sparkSession)
    if any(m[:1] != "<" or "<" in m[1:] or len(m) < 2 for m in marks) or len(set(marks)) < 3:
        raise ValueError("marks are three different texts with < at their start alone")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OWN]
    body = F.coalesce(F.col(text), F.lit(""))
    h = draws(key, seed)
    plain = (body == "") | (h[2] % 100 >= percent)
    for m in marks:
        plain = plain | body.contains(F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            own = batch.column("own")
            h1, h2, forms = (own.field(x).to_pylist() for x in ("h1", "h2", "form"))
            ns, first, second, out = [], [], [], []
            for b, one, two, kind in zip(buffers(batch.column("text")), h1, h2, forms):
                index = Index(as_array(b), unit, every)
                ns.append(index.n)
                if kind == "plain":
                    first.append(None)
                    second.append(None)
                    out.append(b or b"")
                    continue
                low, high = sorted((one % (index.n + 1), two % (index.n + 1)))
                (i, ci), (j, cj) = index.cut(low), index.cut(high)
                first.append(ci)
                second.append(cj - ci)
                out.append(b"".join((s, b[j:], p, b[:i], m, b[i:j]) if kind == "spm" else (p, b[:i], s, b[j:], m, b[i:j])))
            columns = [own.field("kept").field(c) for c in keep]
            made = [pa.array(ns, pa.int64()), own.field("form"), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*keep, *OWN[:5]])

    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.struct(h[0].alias("h1"), h[1].alias("h2"), form.alias("form"), *kept).alias("own"), body.alias("text"))
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, t) for c, t in zip(OWN, (long, string, long, long, string))])
    return rows.mapInArrow(run, schema)


def restored(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add restored, the text that output and form stand for."""
    part = F.split("output", "|".join(rf"\Q{m}\E" for m in marks))
    whole = lambda *order: F.concat(*[F.get(part, F.lit(k)) for k in order])
    text = F.when(F.col("form") == "psm", whole(1, 3, 2)).when(F.col("form") == "spm", whole(2, 3, 1)).otherwise(F.col("output"))
    return rows.withColumn("restored", text)


def digests(rows: DataFrame) -> DataFrame:
    """The digest columns of outputs and of the texts restored from them."""
    return restored(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))

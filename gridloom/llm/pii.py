r"""Personal data: patterns for four kinds, and contextual extraction bootstrapped from their matches.

Base matches are leftmost and non-overlapping for each kind; a match that fails
its test is dropped without a retry. From them the method learns: a seed's
context is the word before it (or the name before a `=` or `:` in its own
word), the word after it, and both; each is a lexical pattern. Identifier-like
words (DIGITS digits or more, or an @) outside base matches are candidates. Patterns
and instances are a graph. Spark scores it ROUNDS times: a pattern's confidence
in a kind is the sum of its distinct instances' scores in the kind over the
count of its distinct instances plus one, an instance's score is one minus the
product of its patterns' doubts; seeds keep score 1. Candidates that reach
ACCEPT through a pattern with at least SUPPORT seeds become spans of the kind.

Null texts count as empty. Every step is linear in the text. Places are code points, ends exclusive. Documents
are told apart by doc_id (null is a value) and text; equal rows get equal
spans and count once as instances. Other columns play no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, buffers, ship, small_batches

KINDS = ("email", "ip", "card", "phone")
DIGITS, SUPPORT, ROUNDS, ACCEPT, SEED, KEY = 5, 3, 3, 0.8, 0.5, 128
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits begins, so no place inside a run is tried again.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# From a word's start alone, so that a long word without either is read once.
MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as the local part goes, to the right as the domain goes."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def clean(word: str) -> str:
    return word.lower().strip(".,;:!?()[]{}\"'<>|*#%&$")


def key(value: str) -> str:
    return value if len(value) <= KEY else "#" + hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()


def candidates(text: str, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places outside covered spans (in order) that read as identifiers."""
    i, run = 0, None
    for m in MARKED.finditer(text):
        a, b = m.span()
        word = m.group()
        if (cut := max(word.rfind("="), word.rfind(":"))) >= 0:
            a += cut + 1
        while b > a and text[b - 1] in ".,;:!?)\"'":
            b -= 1
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        free = not any(x < b for x, _ in covered[i : i + 1])
        mail = "@" in text[a:b]
        joins = run is not None and free and not mail and cut < 0 and m.start() == run[1] + 1 and text[run[1]] == " "
        if joins:
            run = (run[0], b, run[2] + sum(map(str.isdigit, text[a:b])))
            continue
        if run is not None and run[2] >= DIGITS:
            yield run[:2]
        run = None
        if free and mail:
            yield a, b
        elif free:
            run = (a, b, sum(map(str.isdigit, text[a:b])))
    if run is not None and run[2] >= DIGITS:
        yield run[:2]


def edges(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """(pattern, instance, kind or -1, start, end) of base spans and candidates."""
    if "@" not in text and not DIGIT.search(text):
        return []
    places = [(k, a, b) for k, a, b in spans] + [(-1, a, b) for a, b in candidates(text, sorted((a, b) for _, a, b in spans))]
    if not places:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    out = []
    for kind, a, b in places:
        own = bisect_right(starts, a) - 1
        if starts[own] < a:
            left = text[starts[own] : a].lower()
        else:
            left = clean(text[slice(*words[own - 1])]) if own else ""
        last = bisect_right(starts, b - 1) - 1
        if words[last][1] > b:
            right = clean(text[b : words[last][1]]) or (clean(text[slice(*words[last + 1])]) if last + 1 < len(words) else "")
        else:
            right = clean(text[slice(*words[last + 1])]) if last + 1 < len(words) else ""
        out += [(p, key(text[a:b]), kind, a, b) for p in (key(f"L {left}"), key(f"R {right}"), key(f"B {left} {right}"))]
    return out


SPANS = "array<struct<kind:int,start:int,end:int>>"


def extracted(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, print (of the text), base spans and edges of the graph."""
    ship(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    edge = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda rows, t: pa.array([[dict(zip([f.name for f in t.value_type], r)) for r in x] for x in rows], t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found, links = [], []
            for b in buffers(batch.column("text")):
                t = bytes(b).decode("utf-8", "replace") if b else ""
                found.append(base_spans(t))
                links.append(edges(t, found[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), named(found, span), named(links, edge)], ["doc_id", "print", "base", "edges"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, print long, base {SPANS}, edges array<struct<pattern:string,instance:string,kind:int,start:int,end:int>>")


def patterns(links: DataFrame, scratch: Scratch) -> DataFrame:
    """kind, instance, score: the candidates that patterns vouch for."""
    graph = scratch.put(links.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"s{k}") for k in range(len(KINDS))])
    # Only patterns that some kind's seeds support can vouch, now or later.
    useful = scratch.put(sizes.filter(F.greatest(*[F.col(f"s{k}") for k in range(len(KINDS))]) >= SUPPORT), "patterns")
    live = graph.join(useful, "pattern")
    seeds = live.select("pattern", "instance", "kind", "n", F.array(*[F.col(f"s{k}") for k in range(len(KINDS))]).alias("s"))
    live = scratch.put(seeds, "live")
    scores = None
    for step in range(ROUNDS):
        kinds = live.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) - 1))).alias("k")).filter(F.get("s", F.col("k")) >= SUPPORT)
        known = F.when(F.col("kind") == F.col("k"), 1.0).when(F.col("kind") >= 0, 0.0)
        if scores is None:
            scored = kinds.select("*", F.coalesce(known, F.lit(0.0)).alias("v"))
        else:
            scored = kinds.join(scores, ["instance", "k"], "left").select(*kinds.columns, F.coalesce(known, F.col("score"), F.lit(0.0)).alias("v"))
        sure = scored.groupBy("pattern", "k", "n").agg(F.sum("v").alias("v")).select("pattern", "k", (F.col("v") / (F.col("n") + 1)).alias("c")).filter(F.col("c") >= SEED)
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("c"))))
        scores = scratch.put(live.filter("kind = -1").select("pattern", "instance").join(sure, "pattern").groupBy("instance", "k").agg((1 - F.exp(doubt)).alias("score")), f"scores{step}")
    best = scores.filter(F.col("score") >= ACCEPT).groupBy("instance").agg(F.max(F.struct("score", -F.col("k"))).alias("b"))
    return best.select("instance", (-F.col("b.col2")).alias("kind"), "b.score")


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base spans and all spans of every document, each by kind, then start."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(extracted(docs, text), "spans")
    links = rows.filter(F.size("edges") > 0).select("doc_id", "print", F.explode("edges").alias("e")).select("doc_id", "print", "e.*")
    new = links.filter("kind = -1").select("doc_id", "print", "instance", "start", "end").distinct()
    vouched = patterns(links.select("pattern", "instance", "kind"), scratch)
    added = scratch.put(new.join(vouched, "instance").groupBy("doc_id", "print").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")), "added")
    both = rows.select("doc_id", "print", "base").alias("d").join(added.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("d.print").eqNullSafe(F.col("a.print")), "left")
    spans = F.array_sort(F.concat("d.base", F.coalesce(F.col("a.added").cast(SPANS), F.array().cast(SPANS))))
    return both.select("d.doc_id", "d.base", spans.alias("spans"))


def joined(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def digests(rows: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

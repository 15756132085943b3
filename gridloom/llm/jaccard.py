"""Exact n-gram Jaccard join over a tree of count vectors, and its classes.

A document's set is its distinct n-word shingles (A-Z lowered; fewer words make
one shingle, no words none). Two sets link when 100 * common >= percent *
union, so sets of sizes a and b may differ in at most
(100 - percent) / (100 + percent) * (a + b) shingles.

Shingles are hashed into groups. A set's point is its counts by GROUPS groups;
the overlap of two sets is at most the sum of their coordinates' minima, and
the overlap of boxes of points at most that of their upper corners. A tree over
boxes alone prunes nothing here: in few dimensions unrelated texts of a length
lie closer than the join's radius, in many every box covers all (measured in
the README). So the tree's directory deals points to pages by finer groups: a
size class with room for d different shingles has over d + SLACK groups, hence
linked sets agree wholly in some nonempty group, and each set is entered under
the contents of each group. (Sets with so few nonempty groups that all could
differ are entered under that fact too.) Sets are also entered in
the later classes that sets linked with them may have. Pages thus hold all links, and almost nothing else.

Within a page all points are first paired with the page's first; pairs that the
minima bound leaves are verified on the sets, and classes formed. Pages that
then hold more than one class are descended: boxes of points in order of size
against each other, then points of the boxes that remain, then the sets; some pages first by edges
that span, so that classes grow together, then all by all pairs. No pair inside a
class is formed again, and none between classes is left out, so classes are
exact and a page of one class costs one pair a point.

Entries of equal contents meet first in the task that made them and go on as
one, so a page that a third of all documents share moves a row a task.

Rows that repeat a doc_id are one document: a link of any of them is its link.
Null doc_ids are documents of their own by text. Null, empty and blank texts
have no set and link with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import wordhash as wh
from .common import Scratch, buffers, ship, shuffle_partitions, small_batches

GROUPS, SLACK, RATIO = 512, 2, 1.6
#: Points of a page that are laid against each other at once.
BLOCK = 2_000
#: Nodes up to which their ids are broadcast to the scan of the texts; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Entries that a task holds before it passes them on.
HELD = 500_000
LOW = -(1 << 62)


def differ(a: int, b: int, percent: int) -> int:
    """The most shingles in which linked sets of a and b shingles differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def most(k: int) -> int:
    """The largest size of size class k, sizes from RATIO**k up to but without RATIO**(k+1)."""
    return int(np.ceil(RATIO ** (k + 1))) - 1


def scheme(k: int, percent: int) -> int:
    """Groups of size class k: room for all that differ, and for the groups that chance leaves empty."""
    m = differ(most(k), most(k), percent) + 1
    return m + SLACK + int(3 * m * np.exp(-most(k) / m))


def schemes(n: int, percent: int) -> list[int]:
    """The classes in which a set of n shingles is entered."""
    k = int(np.floor(np.log(n) / np.log(RATIO) + 1e-9))
    while RATIO**k > n:
        k -= 1
    while RATIO ** (k + 1) <= n:
        k += 1
    last = k
    while -(-100 * n // percent) >= RATIO ** (last + 1):
        last += 1
    return list(range(k, last + 1))


def entries(h: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Hashes of the contents of a set's nonempty groups in scheme k. h: sorted hashes."""
    m = scheme(k, percent)
    group = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    content = np.add.reduceat(wh.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    out = wh.mix(content + wh.mix(group[first] + np.uint64(k << 32)))
    if len(first) <= differ(len(h), min(most(k), 100 * len(h) // percent), percent):
        out = np.append(out, wh.mix(np.array([(k << 32) + 0xFFFFFFF], np.uint64)))
    return out


def point(h: np.ndarray) -> bytes:
    """Counts by group, a byte each, or four where one doesn't fit a byte."""
    counts = np.bincount((h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def room(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether points x and y (rows of counts) of sets of a and b shingles leave room for a link, by the sum of their minima."""
    return (100 + percent) * np.minimum(x, y).sum(-1, dtype=np.int64) >= percent * (a + b)


def points_of(column: pa.Array) -> np.ndarray:
    """Rows of counts, as wide as the widest."""
    raw = [bytes(b) for b in buffers(column)]
    if all(len(v) == GROUPS for v in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(v, np.uint8 if len(v) == GROUPS else np.uint32).astype(np.uint32) for v in raw])


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first of each run of equal entries, and the others with it."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    centre = node[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else node
    other = ~head & (node != centre)
    return sig[head], node[head], sig[other], centre[other], node[other]


RAW = ["kind", "node", "x", "y", "n", "vec"]


def _batch(kind: str, node, x, y, n=None, vec=None) -> pa.RecordBatch:
    size = len(node)
    i64 = lambda a: pa.array(np.asarray(a).astype(np.uint64).view(np.int64) if np.asarray(a).dtype == np.uint64 else np.asarray(a, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size), i64(node), i64(x), i64(y), pa.nulls(size, pa.int64()) if n is None else i64(n), pa.nulls(size, pa.binary()) if vec is None else pa.array(vec, pa.binary())], RAW
    )


def node_of(docs: DataFrame, text: str) -> Column:
    """doc_id, or for null a number below all doc_ids made from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW) - F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))


def entered(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Rows of three kinds: d (a document: node, hashes of its set, n, point), s (entry x of node), p (entry x, its local first y, node)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, count, seen = [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate(held), np.concatenate(nodes)
            s, first, t, centre, other = _stars(sig, node)
            yield _batch("s", first, s, np.zeros(len(s), np.int64))
            if len(t):
                yield _batch("p", other, t, centre)

        for batch in small_batches(batches, "text"):
            rows = []
            for node, b in zip(batch.column("node").to_pylist(), buffers(batch.column("text"))):
                h = wh.shingles(wh.as_array(b), words)
                if not len(h):
                    rows.append((node, 0, 0, 0, b""))
                    continue
                a, c = (int(wh.mix(h ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x1234567, 0x7654321))
                rows.append((node, a, c, len(h), point(h)))
                if (a, c) in seen:  # an equal set of this task stands for it
                    continue
                seen.add((a, c))
                for k in schemes(len(h), percent):
                    e = entries(h, k, percent)
                    held.append(e)
                    nodes.append(np.full(len(e), node, np.int64))
                    count += len(e)
                if count >= HELD:
                    yield from flush()
                    held, nodes, count, seen = [], [], 0, set()
            node, a, c, n, vec = zip(*rows)
            yield _batch("d", np.array(node, np.int64), np.array(a, np.uint64), np.array(c, np.uint64), np.array(n), list(vec))
        if count:
            yield from flush()

    return docs.select(node_of(docs, text).alias("node"), F.col(text).alias("text")).mapInArrow(run, "kind string, node long, x long, y long, n long, vec binary")


def met(entries_: DataFrame, partitions: int) -> DataFrame:
    """sig, a, b: in each page, its first node with each other. A task's entries are its share of distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("x").to_numpy(), b.column("node").to_numpy()) for b in batches]
        if got:
            _, _, t, centre, other = _stars(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(centre), pa.array(other)], ["sig", "a", "b"])

    return entries_.select("x", "node").repartition(partitions, "x").mapInArrow(run, "sig long, a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets link."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").filter((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select("a", "b").distinct()


def classes(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, least: every node of an edge with the least node that it reaches. Labels fall along edges, then to their labels' labels."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    both = scratch.put(edges.select(ends).select("e.*").distinct(), f"{name}-edges")
    labels = scratch.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least")).withColumnRenamed("u", "node"), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("least").alias("m"))
        lower = scratch.put(labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("least", "m").alias("least"), F.col("least").alias("was")), f"{name}-{step}-near")
        jump = lower.select(F.col("node").alias("least"), F.col("least").alias("far"))
        new = scratch.put(lower.join(jump, "least").select("node", F.col("far").alias("least"), "was"), f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", f"{name}-{step}-near")
        step += 1
        labels = new.select("node", "least")
        if new.filter("least < was").isEmpty():
            return labels


def classified(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """A row for each row of docs: node (doc_id or its stand-in), n_shingles and component, the smallest node reachable by links."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), shuffle_partitions(spark)
    path = scratch.put(entered(docs, text, words, percent), "entered")
    points = path.filter("kind = 'd'").select("node", F.col("x").alias("set_a"), F.col("y").alias("set_b"), "n", "vec")
    same = points.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("node").alias("rep"))
    same = scratch.put(same, "same")
    points = scratch.put(points.join(same, ["set_a", "set_b"], "left").select("node", "n", "vec", F.coalesce("rep", "node").alias("rep")), "points")
    of = points.filter("n > 0").select("node", "rep").distinct()
    stars = scratch.put(met(path.filter("kind = 's'"), parts), "met").unionByName(path.filter("kind = 'p'").select(F.col("x").alias("sig"), F.col("y").alias("a"), F.col("node").alias("b")))
    stars = stars.join(of.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    stars = scratch.put(stars.filter("ra <> rb").select("sig", F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "stars")
    scratch.drop("entered", "same")
    reps = points.filter("n > 0 AND node = rep").select("node", "n", "vec").distinct()  # a row a point: a node has several where its doc_id repeats
    first = scratch.put(bounded(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), reps, percent), "pairs")
    links = scratch.put(verified(first, shingle_sets(docs, first, scratch, text, words), percent), "links")
    found = classes(links, scratch, "first")
    checked = first
    # First a few pages give edges enough to span what may be linked, so that classes grow together; then every page gives every pair that is left.
    for step, (pages, span) in enumerate((("sig % 8 = 0", True), ("true", False))):
        near = scratch.put(descended(stars.filter(pages), reps, found, scratch, percent, span), f"near{step}")  # distinct before the join, which else runs on a row a page
        second = scratch.put(near.join(checked, ["a", "b"], "left_anti"), f"more{step}")
        if second.isEmpty():
            continue
        new = scratch.put(verified(second, shingle_sets(docs, second, scratch, text, words), percent), f"more-links{step}")
        links = links.unionByName(new)
        if span:
            checked = checked.unionByName(second)
            found = classes(links, scratch, f"grown{step}")
    links = links.unionByName(points.filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    final = classes(links, scratch, "last")
    of = points.select("node", F.col("n").alias("n_shingles")).join(final, "node", "left")
    return of.select("node", "n_shingles", F.coalesce("least", "node").alias("component"))


def linked(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links (null: none has one)."""
    shown = lambda c: F.when(F.col(c) > LOW, F.col(c))
    return classified(docs, words, percent, text).select(shown("node").alias("doc_id"), "n_shingles", shown("component").alias("component_id"))


def shingle_sets(docs: DataFrame, pairs: DataFrame, scratch: Scratch, text: str, words: int) -> DataFrame:
    """node, set: the sets of the nodes of pairs, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            sets = [wh.shingles(wh.as_array(b), words).view(np.int64) for b in buffers(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    wanted = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"wanted{len(scratch.paths)}")
    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.select(node_of(docs, text).alias("node"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    return scratch.put(rows.mapInArrow(run, "node long, set array<long>"), f"sets{len(scratch.paths)}")


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and points leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
                good = room(points_of(batch.column("x")), points_of(batch.column("y")), n, m, percent) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    x, y = reps.select(F.col("node").alias("a"), "n", F.col("vec").alias("x")), reps.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("vec").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long").distinct()


def descended(stars: DataFrame, reps: DataFrame, found: DataFrame, scratch: Scratch, percent: int, span: bool = False) -> DataFrame:
    """Pairs between classes of a page whose points leave room: boxes of points first, then the points of boxes that leave room.

    With span, of each task's pairs only those that join what its pairs so far leave apart.

    Large pages are laid out as pairs of blocks, each with the rows of its two blocks, so a task holds two blocks at most.
    """
    label = found.select("node", "least")
    ends = stars.join(label.select(F.col("node").alias("a"), F.col("least").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("least").alias("lb")), "b", "left")
    mixed = ends.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("sig").distinct()
    inside = stars.join(mixed, "sig", "left_semi")
    members = scratch.put(inside.select("sig", F.explode(F.array("a", "b")).alias("node")).distinct(), f"members{int(span)}")
    blocks = members.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "sig").select("sig", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    pairs = placed.select("sig", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    laid = pairs.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    rows = laid.join(label, "node", "left").select("sig", "i", "j", "own", "node", F.coalesce("least", "node").alias("class")).join(reps, "node")
    keys = ["sig", "i", "j"]
    dealt = rows.select(*keys, "own", "node", "class", "n", "vec").repartition(shuffle_partitions(stars.sparkSession), *keys).sortWithinPartitions(*keys, "n")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each page or pair of blocks, together."""
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rest.num_rows:
                continue
            key = [rest.column(c).to_numpy() for c in keys]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            for a, b in zip([0, *cuts[:-1]], cuts):
                yield rest.slice(a, b - a)
            rest = rest.slice(cuts[-1] if len(cuts) else 0)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for page in pages(batches):
            page = page.combine_chunks()
            node, group, n, own = (page.column(c).to_numpy() for c in ("node", "class", "n", "own"))
            vec = points_of(page.column("vec").combine_chunks() if page.column("vec").num_chunks != 1 else page.column("vec").chunk(0))
            apart = page.column("i")[0].as_py() != page.column("j")[0].as_py()
            size = 32
            boxes = [(a, vec[a : a + size].max(0), n[a]) for a in range(0, len(node), size)]
            new = []
            for k, (a, high, low) in enumerate(boxes):
                for b, other, least in boxes[k:]:
                    if percent * least > 100 * n[min(a + size, len(n)) - 1]:
                        break  # rows ascend by size
                    if not room(high, other, low, least, percent):
                        continue
                    x, y = slice(a, min(a + size, len(n))), slice(b, min(b + size, len(n)))
                    good = room(vec[x][:, None], vec[y][None], n[x][:, None], n[y][None], percent) & (group[x][:, None] != group[y][None])
                    if apart:
                        good &= own[x][:, None] != own[y][None]
                    for p, q in zip(*np.nonzero(good)):
                        e = tuple(sorted((int(node[a + p]), int(node[b + q]))))
                        if span:
                            u, v = top(int(group[a + p])), top(int(group[b + q]))
                            if u == v:
                                continue
                            up[u] = v
                            if len(up) > HELD:
                                up.clear()
                        if e[0] != e[1] and e not in seen:
                            if len(seen) > HELD:
                                seen.clear()
                            seen.add(e)
                            new.append(e)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*new)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Of each class the row with the smallest doc_id, with all its columns; rows without a set stay."""
    scratch = Scratch(docs.sparkSession)
    found = classified(docs, words, percent, text)
    firsts = scratch.put(found.filter("node = component").select("node").distinct(), "firsts")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), node_of(docs, text).alias("node"))
    kept = rows.join(firsts, "node", "left_semi")
    return kept.withColumn("row", F.row_number().over(W.partitionBy("node").orderBy("node"))).filter("row = 1").select("r.*")

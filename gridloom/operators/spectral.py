"""Spectral embedding of a sparse affinity table: no dense matrix, no vectors of all nodes at the driver.

Links are rows (a, b, w), both ways; the embedding holds the eigenvectors of the
symmetric normalised Laplacian with the smallest eigenvalues after the trivial
one, the root of the degrees. They are found by block conjugate gradients: a
round multiplies the residuals of WIDTH more vectors than asked for by the
affinity, and of the span of the vectors, their last steps and the residuals
takes the best vectors. The driver holds products of this span's vectors with
each other, some dozen squared, and the residuals of hubs. Each round is a
written table, so a lost executor costs one round.

Hubs, HUBS at most, are the nodes with the most links, taken in four parts, each
by the links that the parts before leave. A node's row carries its links to
hubs, so a round sends hubs' residuals to all tasks and takes sums by hub back;
such links are shuffled once, not in each round. Links between nodes that are no
hubs are joined and summed in each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.scratch import Scratch

#: Vectors more than those asked for; they speed up the last of these.
WIDTH = 3
#: Nodes whose links stay with the nodes they lead to.
HUBS = 4096

#: Columns that stay with a node.
LAID = ("id", "u", "hub", "near", "share")
Batches = Iterator[pa.RecordBatch]


def normalised(links: DataFrame) -> DataFrame:
    """a, b, w with each weight over the roots of both degrees; repeated links are summed, and those without a positive weight are none."""
    once = links.filter("w > 0 AND a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w"))
    degree = once.groupBy("a").agg(F.sum("w").alias("d"))
    met = once.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("_e")), "b")
    return met.select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("_e"))).alias("w"), "d")


def multiplied(edges: DataFrame, rows: DataFrame, value: str, width: int, name: str) -> DataFrame:
    """id and, as an array, the sums over links of weight times value of the other end."""
    sums = [F.sum(F.col("w") * F.get(F.col(value), F.lit(i))).alias(f"_{i}") for i in range(width)]
    met = edges.select("a", "b", "w").join(rows.select(F.col("id").alias("b"), value), "b").groupBy("a").agg(*sums)
    return met.select(F.col("a").alias("id"), F.array(*[f"_{i}" for i in range(width)]).alias(name))


def laid(edges: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame, int]:
    """Nodes with their degree d, their number among hubs (or null) and their links to hubs, near and share; links between others; and the number of hubs."""
    kind, most, rest = edges.schema["a"].dataType.simpleString(), [], edges.select("a", "b", "w")
    table = lambda: F.broadcast(edges.sparkSession.createDataFrame(most, f"b {kind}, hub int"))
    while len(most) < hubs:
        more = rest.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(min(-(-hubs // 4), hubs - len(most))).collect()
        if not more:
            break
        most += [(r["a"], len(most) + i) for i, r in enumerate(more)]
        rest = edges.select("a", "b", "w").join(table(), "b", "left_anti").join(table().withColumnRenamed("b", "a"), "a", "left_anti")
    named = table()
    own = named.select(F.col("b").alias("a"), F.col("hub").alias("own"))
    met = edges.join(named, "b", "left")
    links = F.sort_array(F.collect_list(F.when(F.col("hub").isNotNull(), F.struct("hub", "w"))))
    nodes = met.groupBy("a").agg(F.first("d").alias("d"), links.alias("_l")).join(own, "a", "left")
    return nodes.select(F.col("a").alias("id"), "d", F.col("own").alias("hub"), F.col("_l.hub").alias("near"), F.col("_l.w").alias("share")), rest, len(most)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x).ravel())


def products(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors s, with ns their multiples by the affinity and u the trivial vector: s by s, s by ns, and u by s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * width + 1, width))
        for batch in batches:
            if batch.num_rows:
                s, ns = _matrix(batch.column("s")), _matrix(batch.column("ns"))
                total += np.vstack([s.T @ s, ns.T @ s, (batch.column("u").to_numpy() @ s)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    found = rows.select("u", "s", "ns").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # width squared rows
    flat = np.zeros((2 * width + 1) * width)
    for r in found:
        flat[r["i"]] = r["v"]
    total = flat.reshape(2 * width + 1, width)
    return total[:width], total[width : 2 * width].T, total[-1]


def best(ss: np.ndarray, sn: np.ndarray, us: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and the weights of m vectors at most in the span without the trivial vector."""
    a, b = ss - np.outer(us, us), sn - np.outer(us, us)
    size = np.sqrt(np.maximum(np.diag(a), 0))
    scale = np.where(size > 1e-12 * max(size.max(), 1e-300), 1 / np.where(size > 0, size, 1), 0)
    value, vector = np.linalg.eigh(a * np.outer(scale, scale))
    good = value > 1e-11 * max(value[-1], 1e-300)
    w = scale[:, None] * vector[:, good] / np.sqrt(value[good])
    theta, q = np.linalg.eigh(w.T @ ((b + b.T) / 2) @ w)
    return theta[::-1][:m], (w @ q)[:, ::-1][:, :m]


def _stepped(theta: np.ndarray, c: np.ndarray, us: np.ndarray, held: int) -> Callable[[Batches], Batches]:
    """New vectors, their steps (what they take from beyond the first `held` vectors) and residuals."""
    step = c.copy()
    step[:held] = 0
    both = np.hstack([c, step]) if held < len(c) else c

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            shift = np.outer(batch.column("u").to_numpy(), us)
            s, ns = (_matrix(batch.column(k)) - shift for k in ("s", "ns"))
            s, ns = s @ both, ns @ both
            r = ns[:, : len(theta)] - s[:, : len(theta)] * theta
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in LAID], _arrays(s), _arrays(ns), _arrays(r)], [*LAID, "s", "ns", "r"])

    return run


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all links to hubs: the place of the node in the batch, the hub's number, the weight."""
    at = np.repeat(np.arange(batch.num_rows), batch.column("near").value_lengths().to_numpy())
    return at, *[batch.column(k).flatten().to_numpy() for k in ("near", "share")]


def _reaching(values: np.ndarray) -> Callable[[Batches], Batches]:
    """Rows with nr, the sums over links to hubs of weight times the hub's residuals."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                at, near, share = _links(batch)
                nr = np.stack([np.bincount(at, share * v[near], batch.num_rows) for v in values.T], axis=1).astype(float)  # without links bincount counts in integers
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*LAID, "s", "ns", "r")], _arrays(nr)], [*LAID, "s", "ns", "r", "nr"])

    return run


def _reached(hubs: int, width: int) -> Callable[[Batches], Batches]:
    """Of a task's nodes: by hub, the sums over links of weight times the node's residuals."""

    def run(batches: Batches) -> Batches:
        total, seen = np.zeros((hubs, width)), np.zeros(hubs, bool)
        for batch in batches:
            if batch.num_rows:
                at, near, share = _links(batch)
                seen[near] = True
                for j, v in enumerate(_matrix(batch.column("r")).T):
                    total[:, j] += np.bincount(near, share * v[at], hubs)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32)), _arrays(total[seen])], ["hub", "part"])

    return run


def grown(rows: DataFrame, step: Callable[[Batches], Batches], rest: DataFrame | None, hubs: int, width: int) -> DataFrame:
    """Rows after a step, their span grown by the residuals, and its multiples by the residuals' multiples."""
    kind = rows.schema["id"].dataType.simpleString()
    kept = f"id {kind}, u double, hub int, near array<int>, share array<double>, s array<double>, ns array<double>, r array<double>"
    values = np.zeros((hubs, width))
    for r in rows.filter("hub IS NOT NULL").mapInArrow(step, kept).select("hub", "r").collect():  # HUBS rows at most
        values[r["hub"]] = r["r"]
    reaching, reached = _reaching(values), _reached(hubs, width)
    met = rows.mapInArrow(lambda batches: reaching(step(batches)), f"{kept}, nr array<double>")
    parts = rows.filter("hub IS NULL").mapInArrow(lambda batches: reached(step(batches)), "hub int, part array<double>")
    sums = parts.groupBy("hub").agg(F.array(*[F.sum(F.get("part", F.lit(j))) for j in range(width)]).alias("part"))
    found, added = met.join(F.broadcast(sums), "hub", "left"), ["part"]
    if rest is not None:
        found = found.join(multiplied(rest, rows.mapInArrow(step, kept), "r", width, "others"), "id", "left")
        added.append("others")
    nr = F.col("nr")
    for name in added:
        nr = F.when(F.col(name).isNull(), nr).otherwise(F.zip_with(nr, name, lambda x, y: x + y))
    return found.select(*LAID, F.concat("s", "r").alias("s"), F.concat("ns", nr).alias("ns"))


def embedded(links: DataFrame, k: int, scratch: Scratch, bound: float = 1e-6, rounds: int = 200, hubs: int = HUBS) -> tuple[DataFrame, list[float], float]:
    """id and vector (k numbers; fewer in a graph of k nodes or fewer) of every node with a link, the Laplacian's eigenvalues, and the largest residual.

    Vectors have length 1, and their largest entry in size is positive. The
    rounds end when all residuals are within the bound; else after so many, and
    the residual tells. An empty table of links has an empty embedding.
    """
    edges = scratch.put(normalised(links), "edges")
    nodes, rest, hubs = laid(edges, hubs)
    nodes, rest = scratch.put(nodes, "nodes"), scratch.put(rest, "rest")
    scratch.drop("edges")
    rest = None if rest.isEmpty() else rest
    whole = nodes.agg(F.count("*").alias("n"), F.sum("d").alias("d")).first()
    m = min(k + WIDTH, whole["n"] - 1)
    if m < 1:
        return nodes.select("id", F.array().cast("array<double>").alias("vector")), [], 0.0
    draw = lambda j: F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) - 0.5
    none = F.array().cast("array<double>")
    first = nodes.select("id", F.sqrt(F.col("d") / whole["d"]).alias("u"), "hub", "near", "share", none.alias("s"), none.alias("ns"), F.array(*[draw(j) for j in range(m)]).alias("r"))
    rows = scratch.put(grown(first, lambda batches: batches, rest, hubs, m), "span0")
    name, width, held, residual = "span0", m, m, np.inf
    for i in range(1, rounds + 1):
        ss, sn, us = products(rows, width)
        if i > 1:
            residual = float(np.sqrt(np.maximum(np.diag(ss)[-held:][:k], 0)).max())
            if residual <= bound:
                break
        theta, c = best(ss, sn, us, m)
        step = _stepped(theta, c, us, held)
        held, width = len(theta), len(theta) * (2 if held < width else 1)
        rows = scratch.put(grown(rows, step, rest, hubs, held), f"span{i}")
        width += held
        scratch.drop(name)
        name = f"span{i}"
    k = min(k, held)
    entry = lambda j: F.get("s", F.lit(j))
    ends = rows.agg(*[f(entry(j)).alias(f"{n}{j}") for j in range(k) for n, f in (("low", F.min), ("high", F.max))]).first()
    sign = [1.0 if ends[f"high{j}"] >= -ends[f"low{j}"] else -1.0 for j in range(k)]
    return rows.select("id", F.array(*[entry(j) * sign[j] for j in range(k)]).alias("vector")), [1 - float(t) for t in theta[:k]], residual

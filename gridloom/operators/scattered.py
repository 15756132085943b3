"""Multi-level B-spline approximation of scattered samples.

A control lattice of cubic B-splines is filled by every sample's share in the
4 x 4 x 4 points around it, each share weighed by its squared basis value. A
level halves the spacing, starts from the level before, and fits what that left.
Samples are dealt once to tiles of the world, as arrays, and stay there: a
level's sums are taken row by row and added by control point; what is left is
read against the tile of coefficients, with its halo, that the row meets. Each
level's coefficients are a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.operators import tiles as tl
from gridloom.scratch import Scratch

AT = ["cx", "cy", "cz"]
#: Control points around a tile that its samples touch, and the shares of a control point in the next level's by offset.
HALO, SPLIT = 2, ((-2, 0.125), (-1, 0.5), (0, 0.75), (1, 0.5), (2, 0.125))


def basis(t: np.ndarray) -> np.ndarray:
    """The four cubic B-spline weights at t in [0, 1): (n, 4)."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], -1) / 6


def dealt(posed: DataFrame, size: float) -> DataFrame:
    """key, image, tx, ty, tz and arrays at, x, y, z, r: the known samples of each image in the world, by tile of the given width."""
    kinds = {c: posed.schema[c].dataType.simpleString() for c in ("key", "image")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tl.parts(batches):
            take, rows = [], []
            cols = [tl.lists(batch.column(c)) for c in ("x", "y", "z", "v", "p", "centre")] if batch.num_rows else []
            for i, (x, y, z, v, p, centre) in enumerate(zip(*cols)):
                w = tl.placed(np.stack([x, y, z], 1), p.reshape(-1, 6), centre)[0]
                known = np.flatnonzero(~np.isnan(v))
                tile = np.floor(w[known] / size).astype(np.int32)
                each, back = np.unique(tile, axis=0, return_inverse=True)
                for k, t in enumerate(each.tolist()):
                    own = known[back.ravel() == k]
                    take.append(i)
                    rows.append((*t, own.astype(np.int32), *w[own].T, v[own]))
            if rows:
                cols = list(zip(*rows))
                of = [batch.column(c).take(pa.array(take)) for c in ("key", "image")]
                arrays = [*[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.int32())), *[pa.array(c, pa.list_(pa.float64())) for c in cols[4:]]]
                yield pa.RecordBatch.from_arrays([*of, *arrays], ["key", "image", *tl.TILE, "at", "x", "y", "z", "r"])

    schema = f"key {kinds['key']}, image {kinds['image']}, tx int, ty int, tz int, at array<int>, x array<double>, y array<double>, z array<double>, r array<double>"
    return posed.select("key", "image", "x", "y", "z", "v", "p", "centre").mapInArrow(run, schema)


def _cells(x: np.ndarray, y: np.ndarray, z: np.ndarray, tile: np.ndarray, spacing: float, width: int):
    """Place of each sample's first control point in its tile's cube, and the weights along the axes."""
    w = np.stack([x, y, z], 1) / spacing
    low = np.floor(w)
    return (low - 1 - tile * width + HALO).astype(int), [basis((w - low)[:, a]) for a in range(3)]


def estimated(samples: DataFrame, spacing: float, size: float) -> DataFrame:
    """key, cx, cy, cz, c: coefficients that fit r."""
    width = int(size / spacing)
    edge = width + 2 * HALO

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tl.parts(batches):
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy() for c in tl.TILE], 1)
            take, at, sums = [], [], []
            for i, (x, y, z, r) in enumerate(zip(*[tl.lists(batch.column(c)) for c in ("x", "y", "z", "r")])):
                first, b = _cells(x, y, z, tile[i], spacing, width)
                norm = np.prod([(w * w).sum(1) for w in b], 0)
                num, den = np.zeros((2, edge**3))
                for k in range(64):
                    o = (k & 3, k >> 2 & 3, k >> 4)
                    w = b[0][:, o[0]] * b[1][:, o[1]] * b[2][:, o[2]]
                    place = ((first[:, 2] + o[2]) * edge + first[:, 1] + o[1]) * edge + first[:, 0] + o[0]
                    num += np.bincount(place, r * w**3 / norm, edge**3)
                    den += np.bincount(place, w * w, edge**3)
                some = np.flatnonzero(den > 0)
                take.append(np.full(len(some), i))
                at.append(np.stack([some % edge, some // edge % edge, some // edge**2], 1) - HALO + tile[i] * width)
                sums.append(np.stack([num[some], den[some]], 1))
            at, sums = np.concatenate(at).astype(np.int32), np.concatenate(sums)
            key = batch.column("key").take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([key, *[pa.array(at[:, a]) for a in range(3)], *[pa.array(sums[:, k]) for k in range(2)]], ["key", *AT, "num", "den"])

    kind = samples.schema["key"].dataType.simpleString()
    part = samples.select("key", *tl.TILE, "x", "y", "z", "r").mapInArrow(run, f"key {kind}, cx int, cy int, cz int, num double, den double")
    return part.groupBy("key", *AT).agg((F.sum("num") / F.sum("den")).alias("c"))


def evaluated(samples: DataFrame, coefficients: DataFrame, spacing: float, size: float) -> DataFrame:
    """samples with s, the spline's values at their places; a control point that doesn't exist counts as 0."""
    width = int(size / spacing)
    edge = width + 2 * HALO
    cells = tl.cut(coefficients, ["key"], AT, "c", width, HALO).withColumnsRenamed({"at": "cell_at"})
    names = samples.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tl.parts(batches):
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy() for c in tl.TILE], 1)
            out = []
            for i, (x, y, z, at, cell) in enumerate(zip(*[tl.lists(batch.column(c)) for c in ("x", "y", "z", "cell_at", "cell")])):
                first, b = _cells(x, y, z, tile[i], spacing, width)
                c = np.zeros(edge**3)
                c[at.astype(int)] = cell
                s = np.zeros(len(x))
                for k in range(64):
                    o = (k & 3, k >> 2 & 3, k >> 4)
                    s += b[0][:, o[0]] * b[1][:, o[1]] * b[2][:, o[2]] * c[((first[:, 2] + o[2]) * edge + first[:, 1] + o[1]) * edge + first[:, 0] + o[0]]
                out.append(s)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.list_(pa.float64()))], [*names, "s"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema.fields) + ", s array<double>"
    empty = F.array().cast("array<int>"), F.array().cast("array<double>")
    met = samples.join(cells, ["key", *tl.TILE], "left")
    return met.select(*names, F.coalesce("cell_at", empty[0]).alias("cell_at"), F.coalesce("cell", empty[1]).alias("cell")).mapInArrow(run, schema)


def subdivided(coefficients: DataFrame) -> DataFrame:
    """The coefficients of the same spline at half the spacing."""
    rows = coefficients
    for c in AT:
        rows = rows.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in SPLIT])))
        rows = rows.withColumn(c, 2 * F.col(c) + F.col("_o.o")).withColumn("c", F.col("c") * F.col("_o.w")).drop("_o")
    return rows.groupBy("key", *AT).agg(F.sum("c").alias("c"))


def approximated(posed: DataFrame, spacing: float, levels: int, scratch: Scratch, size: float = 16.0) -> tuple[DataFrame, float]:
    """Coefficients (key, cx, cy, cz, c) of the finest level, and its spacing; the coarsest has the spacing given.

    posed: images with p and centre, as in tiles; size, the width of a tile, is a
    multiple of the spacing.
    """
    samples = scratch.put(dealt(posed, size), "samples")
    total = None
    for k in range(levels):
        fitted = scratch.put(estimated(samples, spacing, size), f"fit{k}")
        if total is None:
            total = fitted
        else:
            both = subdivided(total).unionByName(fitted).groupBy("key", *AT).agg(F.sum("c").alias("c"))
            total = scratch.put(both, f"coefficients{k}")
        if k + 1 < levels:
            left = evaluated(samples, fitted, spacing, size)
            samples = scratch.put(left.withColumn("r", F.zip_with("r", "s", lambda r, s: r - s)).drop("s"), f"left{k}")
            spacing /= 2
    return total, spacing

"""The stack that moved least, by how many singular vectors its first third needs.

Singular values are those of the small side: products of all pairs of slices or,
where a stack's third has more slices than a slice has pixels, of all pairs of
pixels, summed over the slices where they stand; and a decomposition of that
matrix for each stack. No stack is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.operators import histograms as hist, tiles as tl

ENERGY = 0.99


def ranges(images: DataFrame) -> DataFrame:
    """stack_id, lo, hi of every stack."""
    return images.groupBy("stack_id").agg(F.min(F.array_min("pixels")).cast("double").alias("lo"), F.max(F.array_max("pixels")).cast("double").alias("hi"))


def first_third(images: DataFrame) -> DataFrame:
    return images.filter(F.col("z") < F.floor(F.col("nz") / 3))


def pixel_grams(images: DataFrame) -> DataFrame:
    """stack_id, a, b, g: products of the pixels of a stack's first third over its slices, values brought to 0 to 1 as for grams; b not under a. Each task adds up the slices that it holds."""
    kind = images.schema["stack_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        of = None
        for batch in batches:
            of = batch.column("stack_id").type
            stacks = np.array(batch.column("stack_id").to_pylist(), object)
            low, width = (batch.column(c).to_numpy() for c in ("lo", "width"))
            values = tl.lists(batch.column("pixels"))
            for stack in dict.fromkeys(stacks.tolist()):
                own = np.flatnonzero(stacks == stack)
                v = np.stack([values[i] for i in own]).astype(np.float64) - low[own[0]]
                v = v / width[own[0]] if width[own[0]] > 0 else np.zeros(v.shape)
                held[stack] = held[stack] + v.T @ v if stack in held else v.T @ v
        for stack, g in held.items():
            a, b = np.triu_indices(len(g))
            for k in range(0, len(a), 1 << 18):
                some = slice(k, k + (1 << 18))
                x, y = a[some], b[some]
                yield pa.RecordBatch.from_arrays([pa.array([stack] * len(x), of), pa.array(x), pa.array(y), pa.array(g[x, y])], ["stack_id", "a", "b", "g"])

    rows = first_third(images).join(F.broadcast(ranges(images)), "stack_id").select("stack_id", "lo", (F.col("hi") - F.col("lo")).alias("width"), "pixels")
    return rows.mapInArrow(run, f"stack_id {kind}, a long, b long, g double").groupBy("stack_id", "a", "b").agg(F.sum("g").alias("g"))


def grams(images: DataFrame) -> DataFrame:
    """stack_id, a, b, g: products of the slices of a stack's first third (z under a third of nz), values brought to 0 to 1 by the whole stack's range.

    images: slice_id, stack_id, z, nz, pixels. A stack without a range gives 0.
    """
    # The range goes with the blocks, so that no pair is shuffled to meet it.
    third = first_third(images).join(ranges(images), "stack_id").select("stack_id", "lo", "hi", F.col("z").alias("slice_id"), "pixels")
    sums = hist.block_sums(third, third, ["stack_id", "lo", "hi"])
    lo, width = F.col("lo"), F.col("hi") - F.col("lo")
    g = (F.col("ab") - lo * (F.col("sa") + F.col("sb")) + F.col("n") * lo * lo) / (width * width)
    return sums.select("stack_id", "a", "b", F.when(width > 0, g).otherwise(0.0).alias("g"))


def scores(images: DataFrame, energy: float = ENERGY) -> DataFrame:
    """stack_id, rank, share and score of every stack.

    rank is the largest number of singular vectors that hold less than `energy` of
    the norm, share what they hold, and the score their product. Stacks of under
    three slices have nothing to tell and score 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for stack, many, cells in zip(f["stack_id"], f["many"], f["cells"]):
                a, b, g = (np.array([c[k] for c in cells]) for k in ("a", "b", "g"))
                m = np.zeros((int(a.max()) + 1,) * 2)
                m[a, b] = m[b, a] = g
                value = np.maximum(np.linalg.eigvalsh(m)[::-1], 0)
                # As many values as slices: what the small side lacks are zeros.
                value = np.concatenate([value, np.zeros(max(0, many - len(value)))])[:many]
                share = np.sqrt(np.concatenate([[0], np.cumsum(value)[:-1]]) / max(value.sum(), 1e-300))
                rank = int(np.flatnonzero(share < energy)[-1])
                rows.append((stack, rank, float(share[rank]), float(share[rank] * rank)))
            yield pd.DataFrame(rows, columns=["stack_id", "rank", "share", "score"])

    kind = images.schema["stack_id"].dataType.simpleString()
    many, few = F.floor(F.col("nz") / 3), F.size("pixels")
    sides = [grams(images.filter(many <= few)).withColumns({c: F.col(c).cast("long") for c in "ab"}), pixel_grams(images.filter(many > few))]
    cells = sides[0].unionByName(sides[1]).groupBy("stack_id").agg(F.collect_list(F.struct("a", "b", "g")).alias("cells"))
    thirds = images.groupBy("stack_id").agg(F.max(many).alias("many"))
    cells = cells.join(thirds, "stack_id").select("stack_id", "many", "cells")
    made = cells.mapInPandas(run, f"stack_id {kind}, rank int, share double, score double")
    every = images.select("stack_id").distinct().join(made, "stack_id", "left")
    return every.select("stack_id", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("rank", "int"), ("share", "double"), ("score", "double"))])


def chosen(scored: DataFrame) -> DataFrame:
    """scored with template, true for the stack of the lowest score (the smallest stack_id on ties)."""
    best = scored.agg(F.min_by("stack_id", F.struct("score", "stack_id")).alias("best"))
    return scored.join(F.broadcast(best), scored["stack_id"] == best["best"], "left").select(*scored.columns, F.col("best").isNotNull().alias("template"))

"""Patches and superpixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.scratch import Scratch


def starts(n: int, size: int, stride: int, over: bool = False) -> list[int]:
    """First places of patches on an axis: before n - size, or, over the edge, before n + size."""
    return list(range(0, n + size if over else n - size, stride))


def extracted(rows: DataFrame, nx: int, ny: int, size: int, stride: int, over: bool = False) -> DataFrame:
    """Pixels by patch (slice_id, px0, py0): each pixel is sent to the patches that hold it, no range join.

    Over the edge, patches begin size before their place, so they may lie partly
    outside; pixels outside have no rows.
    """
    back = size if over else 0

    def first(a: Column, n: int) -> Column:
        most = len(starts(n, size, stride, over)) - 1
        low = F.greatest(F.lit(0), F.ceil((a + back - size + 1) / F.lit(stride)).cast("int"))
        high = F.least(F.lit(most), F.floor((a + back) / stride).cast("int"))
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride - back))

    xs = rows.select("*", F.explode(first(F.col("x"), nx)).alias("px0"))
    return xs.select("*", F.explode(first(F.col("y"), ny)).alias("py0"))


def occupied(patches: DataFrame, size: int, where: Column, share: float = 1 / 3) -> DataFrame:
    """Patches of which more than share of the pixels meet the condition."""
    n = patches.groupBy("slice_id", "px0", "py0").agg(F.count_if(where).alias("n_set"), F.count("*").alias("n"))
    return n.filter(F.col("n_set") > share * size * size)


def step_of(nx: int, ny: int, count: int) -> int:
    return int((nx * ny / count) ** 0.5 + 0.5)


def seeds(nx: int, ny: int, count: int) -> list[tuple[int, int, int]]:
    """Label and place of superpixel seeds on a regular grid; what strips leave over is dealt over the seeds."""
    step = step_of(nx, ny, count)

    def along(n: int) -> list[int]:
        strips = int(0.5 + n / step)
        if n - step * strips < 0:
            strips -= 1
        share = (n - step * strips) / strips
        return [k * step + step // 2 + int(k * share) for k in range(strips)]

    return [(k, x, y) for k, (y, x) in enumerate((y, x) for y in along(ny) for x in along(nx))]


def seeded(rows: DataFrame, grid: list[tuple[int, int, int]]) -> DataFrame:
    """Centres at the seeds: slice_id, label, cx, cy, cv."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(x).alias("gx"), F.lit(y).alias("gy")) for k, x, y in grid])).alias("g")
    met = rows.select("slice_id", "x", "y", "v", at).filter((F.col("x") == F.col("g.gx")) & (F.col("y") == F.col("g.gy")))
    return met.select("slice_id", F.col("g.label").alias("label"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), F.col("v").cast("double").alias("cv"))


def assigned(rows: DataFrame, centres: DataFrame, step: int, compactness: float, adaptive: bool = False) -> DataFrame:
    """rows with label, the nearest centre in value and place (the smallest label on ties), d, and dv, the squared difference in value.

    A centre reaches from step before it up to, but without, step after it.
    Adaptive, the difference in value counts by the largest one (most) that the
    centre's pixels had so far. Centres of a slice come as one array, so pixels
    are joined once and not with each centre.
    """
    fields = ["label", "cx", "cy", "cv", *["most"] * adaptive]
    lists = centres.groupBy("slice_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cs"))
    dv = lambda c: (F.col("v") - c["cv"]) * (F.col("v") - c["cv"])
    d2 = lambda c: (F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"])
    within = lambda a, c: (F.col(a) >= F.floor(F.greatest(F.lit(0.0), c - step))) & (F.col(a) < F.floor(c + step))
    near = F.filter("cs", lambda c: within("x", c["cx"]) & within("y", c["cy"]))
    d = (lambda c: dv(c) / c["most"] + d2(c) / float(step * step)) if adaptive else (lambda c: dv(c) + d2(c) * (compactness / step) ** 2)
    ranked = F.transform(near, lambda c: F.struct(d(c).alias("d"), c["label"].alias("label"), dv(c).alias("dv")))
    return rows.join(lists, "slice_id").select(*rows.columns, F.array_min(ranked).alias("b")).select(*rows.columns, "b.label", "b.d", "b.dv")


def updated(labelled: DataFrame) -> DataFrame:
    """Centres as means of their pixels."""
    d = lambda c: F.col(c).cast("double")
    return labelled.filter("label IS NOT NULL").groupBy("slice_id", "label").agg(F.avg(d("x")).alias("cx"), F.avg(d("y")).alias("cy"), F.avg(d("v")).alias("cv"))


def slic(rows: DataFrame, nx: int, ny: int, count: int, compactness: float, rounds: int, scratch: Scratch, adaptive: bool = False) -> DataFrame:
    """rows with label after a number of rounds; centres are written after each, so the plan stays as long as one round."""
    step = step_of(nx, ny, count)
    centres = seeded(rows, seeds(nx, ny, count))
    if adaptive:
        centres = centres.withColumn("most", F.lit(100.0))
    for k in range(rounds):
        labelled = assigned(rows, centres, step, compactness, adaptive)
        if k + 1 < rounds:
            new = updated(labelled)
            if adaptive:
                top = labelled.filter("label IS NOT NULL").groupBy("slice_id", "label").agg(F.max("dv").alias("top"))
                new = new.join(top, ["slice_id", "label"]).join(centres.select("slice_id", "label", "most"), ["slice_id", "label"]).withColumn("most", F.greatest("most", "top")).drop("top")
            centres = scratch.put(new, f"centres{k}")
    return labelled


def connected(labels: np.ndarray, least: int) -> np.ndarray:
    """Labels renewed in scanning order: a part is what hangs together by edges; one of at most `least` places takes the label of the last part seen beside its first place."""
    ny, nx = labels.shape
    out = np.full(labels.shape, -1)
    new = 0
    for y in range(ny):
        for x in range(nx):
            if out[y, x] >= 0:
                continue
            beside = 0
            for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1)):
                u, v = x + dx, y + dy
                if 0 <= u < nx and 0 <= v < ny and out[v, u] >= 0:
                    beside = out[v, u]
            out[y, x] = new
            part = [(x, y)]
            for u, v in part:
                for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1)):
                    a, b = u + dx, v + dy
                    if 0 <= a < nx and 0 <= b < ny and out[b, a] < 0 and labels[b, a] == labels[y, x]:
                        out[b, a] = new
                        part.append((a, b))
            if len(part) <= least:
                for u, v in part:
                    out[v, u] = beside
            else:
                new += 1
    return out


def boxes(labelled: DataFrame, least: int) -> DataFrame:
    """Box and size of each label of a slice; labels narrower than least on an axis go."""
    b = labelled.groupBy("slice_id", "label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    return b.filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def schedule(size: int, stride: int, iterations: int, superpixels: bool = False) -> list[tuple[int, int, int]]:
    """iteration, size and stride: patches shrink by 4 and strides by 2 a level, not below 4 and 2."""
    return [(k, max(4, size - 4 * k), stride if superpixels else max(2, stride - 2 * k)) for k in range(iterations)]


def evaluated(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", c1: float = 6.5025, c2: float = 58.5225) -> DataFrame:
    """psnr, global ssim and dssim, means, variances, covariance, correlation and mean squared error of two values in each group."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.groupBy(*by).agg(F.max(x).alias("m"), F.avg((x - y) * (x - y)).alias("mse"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_pop(x).alias("va"), F.var_pop(y).alias("vb"), F.covar_pop(x, y).alias("cov"), F.count("*").alias("n"))
    ma, mb, va, vb, cov = (F.col(c) for c in ("ma", "mb", "va", "vb", "cov"))
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    psnr = F.when(F.col("mse") > 0, 20 * F.log10("m") - 10 * F.log10("mse"))
    return s.select(*by, "n", psnr.alias("psnr"), ssim.alias("ssim"), ((1 - ssim) / 2).alias("dssim"), ma.alias("mean_a"), mb.alias("mean_b"), va.alias("variance_a"), vb.alias("variance_b"), cov.alias("covariance"), "mse")


def contours(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Pixels whose label differs from that of a later neighbour on either axis."""
    from pyspark.sql import Window as W

    right = F.lead(label).over(W.partitionBy("slice_id", "y").orderBy("x"))
    below = F.lead(label).over(W.partitionBy("slice_id", "x").orderBy("y"))
    return labelled.withColumn("contour", (F.coalesce(right != F.col(label), F.lit(False)) | F.coalesce(below != F.col(label), F.lit(False))).cast("int"))

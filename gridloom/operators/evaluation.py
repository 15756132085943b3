"""Evaluation of volumes against volumes: global and local measures, by tiles.

Both volumes are cut into tiles with a halo as wide as the window, so all that a
window needs lies in one row; windowed sums come from running sums along the
axes, and a tile gives a few partial sums. Windows hold the voxels that both
volumes have, so they shrink at edges and holes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.operators import tiles as tl

#: Fixed values of structural similarity for values up to 255.
C1, C2 = 6.5025, 58.5225
SUMS = ("n", "a", "b", "aa", "bb", "ab", "ssim")


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over windows of 2 r + 1 along each axis; what is outside counts as 0."""
    for axis in range(x.ndim):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        at = np.arange(n)
        x = total.take(np.minimum(at + r + 1, n), axis) - total.take(np.maximum(at - r, 0), axis)
    return x


def local_ssim(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Structural similarity of the windows around each place; not a number where a place isn't known to both."""
    known = ~(np.isnan(a) | np.isnan(b))
    # About the tile's means, so that squares of large values don't cancel.
    ma, mb = (float(v[known].mean()) if known.any() else 0.0 for v in (a, b))
    x, y = np.where(known, a - ma, 0.0), np.where(known, b - mb, 0.0)
    n = np.maximum(box(known.astype(float), r), 1)
    sx, sy, xx, yy, xy = (box(v, r) / n for v in (x, y, x * x, y * y, x * y))
    va, vb, cov = xx - sx * sx, yy - sy * sy, xy - sx * sy
    sx, sy = sx + ma, sy + mb
    s = (2 * sx * sy + C1) * (2 * cov + C2) / ((sx * sx + sy * sy + C1) * (va + vb + C2))
    return np.where(known, s, np.nan)


def compared(a: DataFrame, b: DataFrame, key: str, at: Sequence[str], r: int = 2, size: int = 16, value: str = "vol") -> DataFrame:
    """key, n, mse, psnr, cc, mean and variance of both, and the mean local similarity (ssim, dssim) over the voxels that both volumes have."""
    left = tl.cut(a, [key], at, value, size, r)
    right = tl.cut(b, [key], at, value, size, r).withColumnsRenamed({"at": "at_b", "cell": "cell_b"})
    edge = size + 2 * r
    inner = (slice(r, r + size),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for one, two, three, four in zip(*[tl.lists(batch.column(c)) for c in ("at", "cell", "at_b", "cell_b")]):
                u, v = tl.cube(one, two, edge), tl.cube(three, four, edge)
                s = local_ssim(u, v, r)[inner]
                known = ~np.isnan(s)
                u, v, s = u[inner][known], v[inner][known], s[known]
                rows.append((len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v, s.sum(), u.max(initial=-np.inf)))
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.float64()) for c in zip(*rows)]], [key, *SUMS, "top"])

    kind = a.schema[key].dataType.simpleString()
    met = left.join(right, [key, *tl.TILE])
    part = met.select(key, "at", "cell", "at_b", "cell_b").mapInArrow(run, f"{key} {kind}, {', '.join(f'{s} double' for s in SUMS)}, top double")
    s = part.groupBy(key).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("top").alias("top")).filter("n > 0")
    n, ma, mb = F.col("n"), F.col("a") / F.col("n"), F.col("b") / F.col("n")
    va, vb, cov = F.col("aa") / n - ma * ma, F.col("bb") / n - mb * mb, F.col("ab") / n - ma * mb
    mse = (F.col("aa") - 2 * F.col("ab") + F.col("bb")) / n
    psnr = F.when(mse > 0, 20 * F.log10("top") - 10 * F.log10(mse))
    return s.select(
        key, n.cast("long").alias("n"), mse.alias("mse"), psnr.alias("psnr"), F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("cc"),
        ma.alias("mean_a"), mb.alias("mean_b"), va.alias("variance_a"), vb.alias("variance_b"), (F.col("ssim") / n).alias("ssim"), ((1 - F.col("ssim") / n) / 2).alias("dssim"),
    )

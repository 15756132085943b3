"""Neighbourhood operators: values are scattered to the places that read them and aggregated there.

A scatter sends each value to its neighbours and sums before the shuffle, so a
stencil of any size needs one shuffle by place; a separable kernel needs one
small scatter an axis. A self-join of an image with itself would shuffle twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gridloom.operators import tiles as tl

#: Neighbours of a voxel by connectivity, the voxel itself left out.
CONNECTIVITY = {
    n: [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (x, y, z) != (0, 0, 0) and ok(abs(x) + abs(y) + abs(z), z)]
    for n, ok in ((4, lambda s, z: s == 1 and z == 0), (6, lambda s, z: s == 1), (18, lambda s, z: s <= 2), (26, lambda s, z: True))
}


def scatter(rows: DataFrame, by: Sequence[str], offsets: Sequence[tuple], sizes: dict[str, int], value: str = "v") -> DataFrame:
    """by, axes, value and w: each value at the places that hold it at an offset. Offsets end with a weight."""
    axes = list(sizes)
    at = F.explode(F.array(*[F.struct(*[(F.col(a) - o[k]).alias(a) for k, a in enumerate(axes)], F.lit(float(o[-1])).alias("w")) for o in offsets])).alias("e")
    spread = rows.select(*by, F.col(value).alias("_v"), at).select(*by, *[F.col(f"e.{a}").alias(a) for a in axes], F.col("_v").alias(value), F.col("e.w").alias("w"))
    for a, n in sizes.items():
        spread = spread.filter((F.col(a) >= 0) & (F.col(a) < n))
    return spread


def convolved(rows: DataFrame, by: Sequence[str], offsets: Sequence[tuple], sizes: dict[str, int], value: str = "v", normalise: bool = True, padding: float | None = None) -> DataFrame:
    """Weighted sum of neighbours, by their weights where normalised; padding neither counts nor changes."""
    v = F.col(value).cast("double")
    kept = rows if padding is None else rows.filter(v > padding)
    sums = scatter(kept, by, offsets, sizes, value).groupBy(*by, *sizes).agg(F.sum(v * F.col("w")).alias("_s"), F.sum("w").alias("_w"))
    out = F.col("_s") / F.nullif(F.col("_w"), F.lit(0.0)) if normalise else F.col("_s")
    if padding is None:
        return sums.select(*by, *sizes, F.coalesce(out, F.lit(0.0)).alias(value))
    return kept.select(*by, *sizes).join(sums, [*by, *sizes]).select(*by, *sizes, F.coalesce(out, F.lit(0.0)).alias(value)).unionByName(rows.filter(v <= padding).select(*by, *sizes, v.alias(value)))


def separable(rows: DataFrame, by: Sequence[str], kernel: Sequence[tuple[int, float]], sizes: dict[str, int], value: str = "v", padding: float | None = None, over: Sequence[str] | None = None) -> DataFrame:
    """A one-dimensional kernel along each axis in turn, renormalised at edges."""
    for a in over or sizes:
        k = list(sizes).index(a)
        rows = convolved(rows, by, [(*[o if i == k else 0 for i in range(len(sizes))], w) for o, w in kernel], sizes, value, True, padding)
    return rows


def _edges(rows: DataFrame, sizes: dict[str, int]) -> Column:
    out = F.lit(False)
    for a, n in sizes.items():
        if n > 1:
            out = out | (F.col(a) == 0) | (F.col(a) == n - 1)
    return out


def morphology(rows: DataFrame, by: Sequence[str], sizes: dict[str, int], connectivity: int = 4, dilate: bool = True, value: str = "v") -> DataFrame:
    """Highest or lowest value of a voxel and its neighbours; edge voxels keep their value."""
    axes = list(sizes)
    offsets = [(0,) * len(axes) + (1,)] + [(*o[: len(axes)], 1) for o in CONNECTIVITY[connectivity] if not any(o[len(axes) :])]
    # The voxel's own value is the one that comes with offset 0.
    best = (F.max if dilate else F.min)(value)
    tagged = rows.withColumn(value, F.struct(F.col(value).alias("v"), *[F.col(a).alias(a) for a in axes]))
    spread = scatter(tagged, by, offsets, sizes, value)
    own = F.max(F.when(sum((F.abs(F.col(f"{value}.{a}") - F.col(a)) for a in axes[1:]), F.abs(F.col(f"{value}.{axes[0]}") - F.col(axes[0]))) == 0, F.col(f"{value}.v")))
    del best
    found = spread.groupBy(*by, *axes).agg((F.max if dilate else F.min)(f"{value}.v").alias("_m"), own.alias("_o"))
    return found.select(*by, *axes, F.when(_edges(found, sizes), F.col("_o")).otherwise(F.col("_m")).alias(value))


def rank_filter(rows: DataFrame, by: Sequence[str], sizes: dict[str, int], reach: int = 1, value: str = "v", mode: bool = False) -> DataFrame:
    """Upper median (or the most frequent value, the smallest on ties) of the cube within reach; edge voxels keep their value."""
    axes = list(sizes)
    places: list[tuple] = [()]
    for _ in axes:
        places = [(*p, k) for p in places for k in range(-reach, reach + 1)]
    spread = scatter(rows, by, [(*p, 1) for p in places], sizes, value)
    if mode:
        counts = spread.groupBy(*by, *axes, value).agg(F.count("*").alias("n"))
        out = counts.groupBy(*by, *axes).agg(F.max_by(value, F.struct("n", (-F.col(value)).alias("m"))).alias("_m"))
    else:
        got = spread.groupBy(*by, *axes).agg(F.array_sort(F.collect_list(value)).alias("_l"))
        out = got.select(*by, *axes, F.get("_l", F.floor(F.size("_l") / 2).cast("int")).alias("_m"))
    edge = sum(((F.col(a) < reach) | (F.col(a) >= n - reach)).cast("int") for a, n in sizes.items()) > 0
    return rows.join(out, [*by, *axes]).withColumn(value, F.when(edge, F.col(value)).otherwise(F.col("_m"))).drop("_m")


def gradients(rows: DataFrame, by: Sequence[str], axes: Sequence[str] = ("x", "y"), value: str = "v", one_sided: bool = False, spacing: float = 1.0) -> DataFrame:
    """g<axis> and magnitude: central differences; at edges 0, or one-sided and by spacing."""
    out = rows
    v = F.col(value).cast("double")
    for a in axes:
        w = W.partitionBy(*by, *[o for o in axes if o != a]).orderBy(a)
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        if one_sided:
            n = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
            g = F.coalesce((F.coalesce(after, v) - F.coalesce(before, v)) / (n * spacing), F.lit(0.0))
        else:
            g = F.coalesce(after - before, F.lit(0.0))
        out = out.withColumn(f"g{a}", g)
    total = sum((F.col(f"g{a}") * F.col(f"g{a}") for a in axes[1:]), F.col(f"g{axes[0]}") * F.col(f"g{axes[0]}"))
    return out.withColumn("magnitude", F.sqrt(total))


def local_ssim(pairs: DataFrame, by: Sequence[str], sizes: dict[str, int], x: str = "a", y: str = "b", c1: float = 6.5025, c2: float = 58.5225) -> DataFrame:
    """ssim and dssim of two values at each place, over the window from -2 to +3 on both axes."""
    axes = list(sizes)
    offsets = [(dx, dy, 1) for dx in range(-2, 4) for dy in range(-2, 4)]
    both = pairs.withColumn("_p", F.struct(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")))
    spread = scatter(both, by, offsets, sizes, "_p").groupBy(*by, *axes)
    a, b = F.col("_p.a"), F.col("_p.b")
    s = spread.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"), F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab"))
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = F.col("aa") - ma * ma, F.col("bb") - mb * mb, F.col("ab") - ma * mb
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return s.select(*by, *axes, ssim.alias("ssim"), ((1 - ssim) / 2).alias("dssim"))


#: Voxels along a tile of the regulariser.
TILE = 32
#: The 13 directions of half of a cube's neighbours.
DIRECTIONS = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]


def regularised(volume: DataFrame, by: Sequence[str], delta: float, alpha: float, lam: float, value: str = "v", confidence: str = "c", weights: str | None = None) -> DataFrame:
    """One edge-preserving step over 13 directions and their opposites; volume: by, x, y, z, value, confidence.

    A direction counts between voxels of positive confidence, less the further
    they differ (in the column weights, where it is named). A voxel without
    confidence and neighbours becomes 0. Voxels go as tiles with a halo, not to
    each neighbour.
    """
    kind = lambda c: volume.schema[c].dataType.simpleString()
    names = [*by, "x", "y", "z", value]
    base = volume.select(*by, "x", "y", "z", F.col(value).cast("double").alias("_a"), F.col(confidence).cast("double").alias("_c"), F.col(weights or value).cast("double").alias("_o"))
    edge, k = TILE + 2, alpha * lam / (delta * delta)

    def stepped(v: np.ndarray, c: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The step for the inner voxels of a box; c is 0 where there is no voxel."""
        inner = lambda a, d=(0, 0, 0): a[tuple(slice(1 + t, n - 1 + t) for t, n in zip(d, a.shape))]
        s, w, total = (np.zeros(inner(c).shape) for _ in range(3))
        own = inner(c) > 0
        for x, y, z in DIRECTIONS:
            f = 1.0 / (abs(x) + abs(y) + abs(z))
            for d in ((z, y, x), (-z, -y, -x)):
                there = inner(c, d)
                diff = (inner(o, d) - inner(o)) * np.sqrt(f) / delta
                b = np.where(own & (there > 0), f / np.sqrt(1 + diff * diff), 0.0)
                s += b * inner(v, d) * there
                w += b * there
                total += b
        below = inner(c) + k * (w - total * inner(c))
        return np.where(below > 0, (inner(v) * inner(c) + k * (s - total * inner(v) * inner(c))) / np.where(below > 0, below, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, *values = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("at", "cell", "_c", "_o"))
                place = np.stack([at // edge**2, at // edge % edge, at % edge], 1).astype(np.int64)
                low = place.min(0) - 1
                shape = tuple(place.max(0) - low + 2)
                boxes = [np.zeros(shape) for _ in values]
                for box, x in zip(boxes, values):
                    box[tuple((place - low).T)] = x
                made = np.zeros(shape)
                made[1:-1, 1:-1, 1:-1] = stepped(*boxes)
                own = ((place >= 1) & (place <= TILE)).all(1)
                if own.any():
                    tile = [batch.column(c)[i].as_py() for c in tl.TILE]
                    x, y, z = (pa.array((place[own, 2 - a] - 1 + tile[a] * TILE).astype(np.int32)) for a in range(3))
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[i], int(own.sum())) for c in by], x, y, z, pa.array(made[tuple((place - low)[own].T)])], names)

    tiles = tl.cut(base, by, ["x", "y", "z"], "_a", TILE, 1, ["_c", "_o"])
    return tiles.mapInArrow(run, ", ".join([*[f"`{c}` {kind(c)}" for c in by], "x int, y int, z int", f"`{value}` double"]))


def across(rows: DataFrame, by: Sequence[str], axis: str, kernel: Sequence[tuple[int, float]], value: str = "v") -> DataFrame:
    """A one-dimensional kernel along an axis of unknown length, by the weights of the places that exist; one shuffle."""
    at = F.explode(F.array(*[F.struct((F.col(axis) - k).alias("a"), F.lit(float(w)).alias("w"), F.lit(k == 0).alias("own")) for k, w in kernel])).alias("e")
    sent = rows.select(*by, F.col(value).alias("_v"), at).select(*by, F.col("e.a").alias(axis), "_v", "e.w", "e.own")
    sums = sent.groupBy(*by, axis).agg((F.sum(F.col("_v") * F.col("w")) / F.sum("w")).alias(value), F.bool_or("own").alias("_own"))
    return sums.filter("_own").drop("_own")


# Images in block form: neighbours are read from the array of the own row, so nothing is shuffled.


def bound(value: str | Column, f) -> Column:
    """f of a value that is worked out once: a column's expression would else be put into lambdas and worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def near(values: Column, i: Column, offset: tuple[int, int], nx: int, ny: int) -> Column:
    """The value at an offset from place i of an image's array; null outside."""
    dx, dy = offset
    ok = F.lit(True)
    if dx:
        ok = ok & (i % nx + dx >= 0) & (i % nx + dx < nx)
    if dy:
        ok = ok & (F.floor(i / nx) + dy >= 0) & (F.floor(i / nx) + dy < ny)
    return F.when(ok, F.get(values, (i + dy * nx + dx).cast("int")))


def added(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0])


def block_convolved(values: str, offsets: Sequence[tuple[int, int, float]], nx: int, ny: int, normalise: bool = True, padding: float | None = None) -> Column:
    """Weighted sum of neighbours, by their weights where normalised; with padding, padding neither counts nor changes."""

    def at(own: Column, v: Column, i: Column) -> Column:
        found = [(near(own, i, (dx, dy), nx, ny), w) for dx, dy, w in offsets]
        if padding is not None:
            found = [(F.when(n > padding, n), w) for n, w in found]
        total = added([F.coalesce(n.cast("double") * w, F.lit(0.0)) for n, w in found])
        if normalise:
            weight = added([F.when(n.isNotNull(), F.lit(float(w))).otherwise(0.0) for n, w in found])
            total = F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
        return total if padding is None else F.when(v > padding, total).otherwise(v.cast("double"))

    return bound(values, lambda own: F.transform(own, lambda v, i: at(own, v, i)))


def batched(images: DataFrame, values: str, fn: Callable[[pa.Array, int], np.ndarray]) -> DataFrame:
    """images with values (arrays) replaced by fn(their elements, number of images), an array of numbers an image, for a batch of images at once."""
    keep = [c for c in images.columns if c != values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = np.ascontiguousarray(fn(batch.column(values).flatten(), batch.num_rows), float).reshape(batch.num_rows, -1)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], [*keep, values])

    return images.select(*keep, values).mapInArrow(run, T.StructType([*[images.schema[c] for c in keep], T.StructField(values, T.ArrayType(T.DoubleType()))]))


def shifted(x: np.ndarray, k: int, fill: float) -> np.ndarray:
    """The values k further along the last axis; fill where there are none."""
    out = np.full(x.shape, fill)
    n = x.shape[-1]
    if abs(k) < n:
        out[..., max(0, -k) : n - max(0, k)] = x[..., max(0, k) : n - max(0, -k)]
    return out


def block_separable(images: DataFrame, kernel: Sequence[tuple[int, float]], nx: int, ny: int, values: str = "pixels", normalise: bool = True, padding: float | None = None) -> DataFrame:
    """A one-dimensional kernel along x, then along y, for a batch of images at once; with padding, padding neither counts nor changes."""

    def along(x: np.ndarray) -> np.ndarray:
        counts = np.ones(x.shape) if padding is None else (x > padding).astype(float)
        held = x * counts
        total = sum(w * shifted(held, k, 0.0) for k, w in kernel)
        if normalise:
            weight = sum(w * shifted(counts, k, 0.0) for k, w in kernel)
            total = np.where(weight != 0, total / np.where(weight != 0, weight, 1), 0.0)
        return total if padding is None else np.where(x > padding, total, x)

    def fn(flat: pa.Array, n: int) -> np.ndarray:
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, ny, nx)
        return along(along(x).swapaxes(1, 2)).swapaxes(1, 2)

    return batched(images, values, fn)


def block_neighbours(values: Column, i: Column, offsets: Sequence[tuple[int, int]], nx: int, ny: int) -> Column:
    """The values at the offsets that lie inside, as an array."""
    return F.filter(F.array(*[near(values, i, o, nx, ny) for o in offsets]), lambda v: v.isNotNull())


def inner(i: Column, nx: int, ny: int, reach: int = 1) -> Column:
    x, y = i % nx, F.floor(i / nx)
    return (x >= reach) & (x < nx - reach) & (y >= reach) & (y < ny - reach)


def square(low: int, high: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(low, high + 1) for dx in range(low, high + 1)]


def block_morphology(values: str, nx: int, ny: int, connectivity: int = 4, dilate: bool = True) -> Column:
    """Highest or lowest value of a pixel and its neighbours; edge pixels keep their value."""
    offsets = [(0, 0)] + [o[:2] for o in CONNECTIVITY[connectivity] if o[2] == 0]
    best = F.array_max if dilate else F.array_min
    return bound(values, lambda own: F.transform(own, lambda v, i: F.when(inner(i, nx, ny), best(block_neighbours(own, i, offsets, nx, ny))).otherwise(v)))


def block_rank(values: str, nx: int, ny: int, mode: bool = False) -> Column:
    """Upper median (or the most frequent value, the smallest on ties) of 3 x 3; edge pixels keep their value."""

    def pick(found: Column) -> Column:
        if not mode:
            return F.get(F.array_sort(found), F.floor(F.size(found) / 2).cast("int"))
        many = F.transform(found, lambda v: F.struct((-F.size(F.filter(found, lambda o: o == v))).alias("n"), v.alias("v")))
        return F.array_min(many)["v"]

    picked = lambda own, i: bound(block_neighbours(own, i, square(-1, 1), nx, ny), pick)
    return bound(values, lambda own: F.transform(own, lambda v, i: F.when(inner(i, nx, ny), picked(own, i)).otherwise(v)))


def block_gradients(values: str, nx: int, ny: int, one_sided: bool = False, spacing: tuple[float, float] = (1.0, 1.0)) -> Column:
    """An array of structs gx, gy and magnitude: central differences; at edges 0, or one-sided and by spacing."""

    def along(own: Column, v: Column, i: Column, d: tuple[int, int], size: float) -> Column:
        before, after = (near(own, i, (s * d[0], s * d[1]), nx, ny).cast("double") for s in (-1, 1))
        if not one_sided:
            return F.coalesce(after - before, F.lit(0.0))
        n = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, v.cast("double")) - F.coalesce(before, v.cast("double"))) / (n * size)

    def at(own: Column, v: Column, i: Column) -> Column:
        gx, gy = along(own, v, i, (1, 0), spacing[0]), along(own, v, i, (0, 1), spacing[1])
        return F.struct(gx.alias("gx"), gy.alias("gy"), F.sqrt(gx * gx + gy * gy).alias("magnitude"))

    return bound(values, lambda own: F.transform(own, lambda v, i: at(own, v, i)))


def windowed(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sums of the places from low to high around each place on the last two axes; places outside count as 0."""
    for axis in (-1, -2):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        at = np.arange(n)
        x = total.take(np.minimum(at + high + 1, n), axis) - total.take(np.maximum(at + low, 0), axis)
    return x


def block_ssim(images: DataFrame, values: str, nx: int, ny: int, c1: float = 6.5025, c2: float = 58.5225) -> DataFrame:
    """ssim at each place of arrays of structs (a, b), over the window from -2 to +3 on both axes, for a batch of images at once."""

    def fn(flat: pa.Array, n: int) -> np.ndarray:
        a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(float).reshape(n, ny, nx) for k in ("a", "b"))
        count = windowed(np.ones((1, ny, nx)), -2, 3)
        ma, mb, aa, bb, ab = (windowed(v, -2, 3) / count for v in (a, b, a * a, b * b, a * b))
        va, vb, cov = aa - ma * ma, bb - mb * mb, ab - ma * mb
        return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))

    return batched(images, values, fn)

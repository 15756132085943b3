"""Interpolation, resampling and the sparse pixel-voxel relation.

A sample is spread to the lattice places around it with weights; equal targets
are summed before any other join. The coefficient relation (slice, pixel,
voxel, c) is far larger than images and volume and follows from the images, so
what sums over it works it out anew, image by image: images meet tiles of the
volume by an equi-join, and sums by voxel or pixel are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import coords
from gridloom.operators import tiles as tl
from gridloom.operators.stencils import bound


def corners(x: Column, y: Column, z: Column | None = None) -> Column:
    """An array of the lattice places around a point with their linear weights (4 or, with z, 8)."""
    out = []
    for k in range(4 if z is None else 8):
        weight, place = F.lit(1.0), {}
        for bit, (name, c) in enumerate(zip("xyz", (x, y) if z is None else (x, y, z))):
            at = F.floor(c) + (k >> bit & 1)
            place[name] = at.cast("int").alias(name)
            weight = weight * (1 - F.abs(c - at))
        out.append(F.struct(*place.values(), weight.alias("w")))
    return F.array(*out)


def sampled(points: DataFrame, image: DataFrame, keys: Sequence[str], on: Sequence[str], x: str, y: str, method: str = "linear", value: str = "v") -> DataFrame:
    """Values of an image (on, x, y, value) at points (keys, x, y): nearest or linear; what is outside counts as 0."""
    if method == "nearest":
        spread = points.select(*keys, *[c for c in on if c not in keys], coords.nearest(F.col(x)).alias("x"), coords.nearest(F.col(y)).alias("y"), F.lit(1.0).alias("w"))
    else:
        e = points.select(*keys, *[c for c in on if c not in keys], F.explode(corners(F.col(x), F.col(y))).alias("e"))
        spread = e.select(*[c for c in e.columns if c != "e"], "e.x", "e.y", "e.w").filter("w > 0")
    met = spread.join(image.select(*on, "x", "y", F.col(value).cast("double").alias("_v")), [*on, "x", "y"], "left")
    return met.groupBy(*keys).agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(0.0))).alias(value))


def lattice(images: DataFrame, nx: Column, ny: Column) -> DataFrame:
    """A row for each place (ox, oy) of each image's output lattice."""
    n = nx * ny
    return images.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_k")).select(*images.columns, (F.col("_k") % nx).cast("int").alias("ox"), F.floor(F.col("_k") / nx).cast("int").alias("oy"))


def resample(images: DataFrame, pixels: DataFrame, n: int, old: float, new: float, method: str = "linear") -> DataFrame:
    """Square images of n places and spacing old at spacing new, both lattices with one centre."""
    m = max(1, int(n * old / new))
    place = lambda o: (F.col(o) - (m - 1) / 2) * (new / old) + (n - 1) / 2
    points = lattice(images, F.lit(m), F.lit(m)).withColumn("sx", place("ox")).withColumn("sy", place("oy"))
    return sampled(points, pixels, ["slice_id", "ox", "oy"], ["slice_id"], "sx", "sy", method)


def resample_padded(images: DataFrame, pixels: DataFrame, n: int, old: float, new: float, padding: float = -1) -> DataFrame:
    """As linear resampling, over corners that aren't padding, renormalised; padding where four or more of the eight corners are.

    In one plane each corner counts twice.
    """
    m = max(1, int(n * old / new))
    place = lambda o: (F.col(o) - (m - 1) / 2) * (new / old) + (n - 1) / 2
    points = lattice(images, F.lit(m), F.lit(m)).select("slice_id", "ox", "oy", F.explode(corners(place("ox"), place("oy"))).alias("e")).select("slice_id", "ox", "oy", "e.x", "e.y", "e.w")
    met = points.join(pixels.select("slice_id", "x", "y", F.col("v").cast("double").alias("_v")), ["slice_id", "x", "y"], "left")
    good = F.coalesce(F.col("_v") > padding, F.lit(False))
    got = met.groupBy("slice_id", "ox", "oy").agg(F.sum(F.when(good, F.col("w") * F.col("_v"))).alias("s"), F.sum(F.when(good, F.col("w"))).alias("w"), F.count_if(~good).alias("bad"))
    return got.select("slice_id", "ox", "oy", F.when((2 * F.col("bad") < 4) & (F.col("w") > 0), F.col("s") / F.col("w")).otherwise(F.lit(float(padding))).alias("v"))


#: Samples split over voxels at once, times eight corners.
SAMPLES = 100_000


def split_slices(psf: Sequence[tuple], centre: Sequence[float], size: tuple[int, int]) -> Callable:
    """A function of batches (z, nz, m) that gives image, pixel, voxel (n, 3) and c, the pixel's samples under the point spread, moved by the slice's matrix about centre, split over eight voxels and summed by voxel; in parts, images ascending.

    Voxels outside the volume (size by nz) are left out.
    """
    nx, ny = size
    spread = np.array(psf, float)
    y, x = (a.ravel() for a in np.mgrid[:ny, :nx])
    places = np.stack([x, y], 1)[:, None, :] + spread[None, :, :2]  # pixel, sample

    def split(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        step = max(1, SAMPLES // (len(x) * len(spread)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            m = np.stack(tl.lists(part.column("m"))).reshape(-1, 3, 4)
            z, nz = (part.column(c).to_numpy() for c in ("z", "nz"))
            n = len(z)
            point = [np.broadcast_to(places[..., 0] - centre[0], (n, *places.shape[:2])), np.broadcast_to(places[..., 1] - centre[1], (n, *places.shape[:2])), z[:, None, None] + spread[None, None, :, 2] - centre[2]]
            ends = (nx, ny, nz[:, None, None])
            low, share = [], []
            for r in range(3):
                w = sum(m[:, r, k, None, None] * point[k] for k in range(3)) + m[:, r, 3, None, None] + centre[r]
                low.append(np.floor(w))
                f = w - low[r]
                # Places outside have no share.
                share.append([np.where((low[r] + e >= 0) & (low[r] + e < ends[r]), t, 0.0) for e, t in ((0, 1 - f), (1, f))])
            # A pixel's voxels lie in a small box around its samples; places are numbered in it.
            base = [a.min(2, keepdims=True) for a in low]
            edge = max(int((a - b).max(initial=0)) for a, b in zip(low, base)) + 2
            x0, y0, z0 = ((a - b).astype(np.int64) for a, b in zip(low, base))
            here = ((np.arange(n * len(x)).reshape(n, len(x), 1) * edge + z0) * edge + y0) * edge + x0
            share[0] = [t * spread[None, None, :, 3] for t in share[0]]
            c = np.zeros(n * len(x) * edge**3)
            for i in (0, 1):
                for j in (0, 1):
                    xy = share[0][i] * share[1][j]
                    for k in (0, 1):
                        c += np.bincount((here + ((k * edge + j) * edge + i)).ravel(), (xy * share[2][k]).ravel(), len(c))
            base = np.concatenate(base, 2)
            key = np.flatnonzero(c > 0)
            if len(key):
                own, voxel = np.divmod(key, edge**3)
                image, place = np.divmod(own, len(x))
                first = base.reshape(-1, 3)[own].astype(np.int64)
                yield at + image, place, first + np.stack([voxel // edge**a % edge for a in range(3)], 1), c[key]

    return split


def coefficients(images: DataFrame, matrix: Sequence[Column], psf: Sequence[tuple], centre: Sequence[float], size: tuple[int, int]) -> DataFrame:
    """stack_id, slice_id, x, y, v, vx, vy, vz, c of all slices as a table; what only sums over it takes seen_slices.

    images: stack_id, slice_id, z, nz (depth of the volume), pixels, and the
    matrix's columns; the matrix turns about centre.
    """
    names = ["stack_id", "slice_id", "x", "y", "v", "vx", "vy", "vz", "c"]
    split = split_slices(psf, centre, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("pixels").flatten().to_numpy(zero_copy_only=False) if batch.num_rows else None
            for image, place, voxel, c in split(batch):
                own, i32 = pa.array(image), lambda a: pa.array(a.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("stack_id").take(own), batch.column("slice_id").take(own), i32(place % size[0]), i32(place // size[0]), pa.array(flat[image * size[0] * size[1] + place].astype(np.float64)),
                     *[i32(voxel[:, a]) for a in range(3)], pa.array(c)], names
                )

    kind = lambda c: images.schema[c].dataType.simpleString()
    # An image gives thousands of rows: a small table is still work for all tasks.
    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = images.select("stack_id", "slice_id", "z", "nz", "pixels", F.array(*matrix).alias("m")).repartition(tasks, "slice_id")
    return rows.mapInArrow(run, f"stack_id {kind('stack_id')}, slice_id {kind('slice_id')}, x int, y int, v double, vx int, vy int, vz int, c double")


VOXEL = ["stack_id", "vx", "vy", "vz"]
PIXEL = ["slice_id", "x", "y"]
#: Planes of images that are dealt to a task together, voxels along a tile, and sums by voxel that are held before they are handed on.
SLAB, EDGE, SUMS = 32, 32, 1 << 16


def of_known(split: Callable, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """As split, without pixels whose value isn't known; with each row's place in the flat values."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    n = batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    start = np.cumsum(n) - n
    none = np.isnan(flat.astype(float))
    for image, pixel, voxel, c in split(batch):
        place = start[image] + pixel
        if none.any():
            keep = ~none[place]
            image, pixel, voxel, c, place = image[keep], pixel[keep], voxel[keep], c[keep], place[keep]
        if len(c):
            yield image, pixel, voxel, c, place


class Relation:
    """Which voxels see the pixels of images, and how much: worked out of each image where it is summed, so that no table of coefficients is written or shuffled.

    images: stack_id, slice_id, the plane, by which neighbours are dealt together,
    nz (the volume's depth), width (pixels along x), v (an array, null where a
    pixel isn't known and takes no part) and what the functions ask for.
    split gives image, pixel, voxel and c of a batch in parts; reach the lowest
    and highest voxel that each image may see. Voxels summed to meet a pixel go
    as tiles of the volume to the images that reach them; what pixels give to
    voxels is summed over neighbouring images before it is shuffled.
    """

    def __init__(self, images: DataFrame, size: tuple[int, int], split: Callable, reach: Callable, plane: str = "z"):
        self.images, self.size, self.split, self.reach, self.plane = images, size, split, reach, plane
        self.tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kind(self, c: str) -> str:
        return self.images.schema[c].dataType.simpleString()

    def valued(self, v: Column) -> Relation:
        """The same relation for other values of the pixels."""
        return Relation(self.images.withColumn("v", v), self.size, self.split, self.reach, self.plane)

    def spread(self, names: Sequence[str] = ("v",), values: DataFrame | None = None) -> DataFrame:
        """VOXEL, for each name the sum of c times the array of that name by pixel (null counts as 0), and the sum of c; values: slice_id and arrays, for images that have them."""
        rows = self.images if values is None else self.images.join(values, "slice_id")
        rows = rows.withColumn("_slab", F.floor(F.col(self.plane) / SLAB)).repartition(self.tasks, "stack_id", "_slab").sortWithinPartitions("stack_id", "_slab", self.plane)
        columns = [*VOXEL, *[f"s{i}" for i in range(len(names))], "c"]
        split = self.split

        def reduced(parts: list[tuple]) -> tuple:
            stack, voxel, sums = (np.concatenate(a, -1) for a in zip(*parts))
            low = voxel.min(1, keepdims=True)
            wide = voxel.max(1) - low[:, 0] + 1
            own, stack = np.unique(stack, return_inverse=True)
            x, y, z = voxel - low
            code = ((stack * wide[2] + z) * wide[1] + y) * wide[0] + x
            many = len(own) * int(wide.prod())
            if many > 4 * len(code) + 1024:
                place, code = np.unique(code, return_inverse=True)
                many = len(place)
            else:
                place = np.arange(many)
            sums = np.stack([np.bincount(code, s, many) for s in sums])
            met = np.flatnonzero(np.bincount(code, minlength=many))
            at, place = place[met], place[met]
            voxel = np.stack([at % wide[0], at // wide[0] % wide[1], at // (wide[0] * wide[1]) % wide[2]]) + low
            return own[place // wide.prod()], voxel, sums[:, met]

        def handed(stacks: pa.Array, parts: list[tuple]) -> pa.RecordBatch:
            stack, voxel, sums = reduced(parts)
            return pa.RecordBatch.from_arrays([stacks.take(pa.array(stack)), *[pa.array(a.astype(np.int32)) for a in voxel], *[pa.array(a) for a in sums]], columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                stacks = batch.column("stack_id").dictionary_encode()
                code = stacks.indices.to_numpy()
                flat = [np.nan_to_num(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float)) for c in names]
                parts, held = [], 0
                for image, _, voxel, c, place in of_known(split, batch):
                    parts.append(reduced([(code[image], voxel.T, np.stack([*[c * a[place] for a in flat], c]))]))
                    held += parts[-1][2].shape[1]
                    if held >= SUMS:
                        yield handed(stacks.dictionary, parts)
                        parts, held = [], 0
                if parts:
                    yield handed(stacks.dictionary, parts)

        part = rows.mapInArrow(run, f"stack_id {self.kind('stack_id')}, vx int, vy int, vz int, {', '.join(f'{c} double' for c in columns[4:])}")
        return part.groupBy(*VOXEL).agg(*[F.sum(f"s{i}").alias(name) for i, name in enumerate(names)], F.sum("c").alias("c"))

    def gathered(self, volume: DataFrame, value: str = "vol") -> DataFrame:
        """stack_id, slice_id, x, y, v, s and c: of each pixel that meets the volume, the sums of c times its value and of c over the voxels that it has."""
        size, split, reach = self.size, self.split, self.reach
        kinds = ", ".join(f"{'key' if f.name == 'stack_id' else f.name} {f.dataType.simpleString()}" for f in self.images.schema)
        names = [*["key" if c == "stack_id" else c for c in self.images.columns], *tl.TILE]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high = reach(batch)
                top = np.stack([np.full(batch.num_rows, size[0]), np.full(batch.num_rows, size[1]), batch.column("nz").to_numpy()], 1) - 1
                take, tile = tl.boxes(np.maximum(low, 0) // EDGE, np.minimum(high, top) // EDGE)
                for at in range(0, len(take), tl.ROWS):
                    rows = batch.take(pa.array(take[at : at + tl.ROWS]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(tile[at : at + tl.ROWS, a].astype(np.int32)) for a in range(3)]], names)

        def work(batch: pa.RecordBatch, tile: np.ndarray, at: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
            whole = tl.cube(at, cell, EDGE).ravel()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            width = batch.column("width").to_numpy()
            for image, pixel, voxel, c, place in of_known(split, batch):
                local = voxel - tile * EDGE
                own = ((local >= 0) & (local < EDGE)).all(1)
                value = np.where(own, whole[np.where(own, (local[:, 2] * EDGE + local[:, 1]) * EDGE + local[:, 0], 0)], np.nan)
                good = ~np.isnan(value)
                if not good.any():
                    continue
                # Rows of a pixel needn't stand together.
                place, first, back = np.unique(place[good], return_index=True, return_inverse=True)
                s, w = np.bincount(back, c[good] * value[good]), np.bincount(back, c[good])
                image, pixel = image[good][first], pixel[good][first]
                take = pa.array(image)
                x, y = (pa.array(a.astype(np.int32)) for a in (pixel % width[image], pixel // width[image]))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("slice_id").take(take), x, y, pa.array(flat[place].astype(float)), pa.array(s), pa.array(w)], ["stack_id", "slice_id", "x", "y", "v", "s", "c"])

        images = self.images.mapInArrow(near, kinds + ", tx int, ty int, tz int")
        tiles = tl.cut(volume.select(F.col("stack_id").alias("key"), *VOXEL[1:], value), ["key"], VOXEL[1:], value, EDGE, 0)
        part = tl.met(images, tiles, work, f"stack_id {self.kind('stack_id')}, slice_id {self.kind('slice_id')}, x int, y int, v double, s double, c double")
        return part.groupBy("stack_id", *PIXEL, "v").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def seen_slices(images: DataFrame, matrix: Sequence[Column], psf: Sequence[tuple], centre: Sequence[float], size: tuple[int, int]) -> Relation:
    """The relation of slices and their stacks' volumes; images as for coefficients, pixels null where they aren't known."""
    nx, ny = size
    spread = np.array(psf, float)
    low, high = spread[:, :3].min(0) - np.array(centre), spread[:, :3].max(0) + [nx - 1, ny - 1, 0] - np.array(centre)
    box = np.array([[(low, high)[k >> a & 1][a] for a in range(3)] for k in range(8)])

    def reach(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack(tl.lists(batch.column("m"))).reshape(-1, 3, 4)
        corner = np.repeat(box[None], batch.num_rows, 0)
        corner[..., 2] += batch.column("z").to_numpy()[:, None]
        w = np.einsum("nrc,nkc->nkr", m[..., :3], corner) + m[:, None, :, 3] + np.array(centre)
        return np.floor(w.min(1) - 1e-6).astype(np.int64), np.floor(w.max(1) + 1e-6).astype(np.int64) + 1

    rows = images.select("stack_id", "slice_id", "z", "nz", F.lit(nx).alias("width"), F.col("pixels").cast("array<double>").alias("v"), F.array(*matrix).alias("m"))
    return Relation(rows, size, split_slices(psf, centre, size), reach)


def back_projected(seen: Relation) -> DataFrame:
    """The weighted mean of values at each voxel, with the weight."""
    return seen.spread().select(*VOXEL, (F.col("v") / F.col("c")).alias("vol"), F.col("c").alias("volw"))


def forward_projected(seen: Relation, volume: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each pixel's mean of the volume under its coefficients (sim), and their sum (simweight)."""
    return seen.gathered(volume).select("stack_id", *PIXEL, *keep, (F.col("s") / F.col("c")).alias("sim"), F.col("c").alias("simweight"))


#: Interpolation by name: weights by distance, as numpy. Linear and nearest run as joins or on blocks above.
KERNELS = {
    "linear": lambda t: np.maximum(0.0, 1 - t),
    "cubic": lambda t: np.where(t < 1, t**3 - 2 * t**2 + 1, np.where(t < 2, -(t**3) + 5 * t**2 - 8 * t + 4, 0.0)),
    "bspline": lambda t: np.where(t < 1, (4 - 6 * t**2 + 3 * t**3) / 6, np.where(t < 2, (2 - t) ** 3 / 6, 0.0)),
    "sinc": lambda t: np.where(t < 6, np.sinc(t) * 0.5 * (1 + np.cos(np.pi * t / 6)), 0.0),
    "gaussian": lambda t: np.exp(-0.5 * t * t),
}


def interpolated(images: DataFrame, nx: int, ny: int, places: Sequence[tuple[float, float]], kernel, reach: int, normalise: bool = False, width: int = 1) -> DataFrame:
    """slice_id, ox, oy, v: each image's value at fixed places, by a kernel over 2 * reach pixels an axis, edge pixels repeated.

    Weights are the same for all images, so a batch of images is one product of matrices.
    """
    weight = np.zeros((len(places), ny * nx))
    for k, (x, y) in enumerate(places):
        at = [np.floor(c) + np.arange(1 - reach, reach + 1) for c in (x, y)]
        w = np.outer(kernel(np.abs(y - at[1])), kernel(np.abs(x - at[0])))
        rows, cols = (np.clip(a, 0, n - 1).astype(int) for a, n in ((at[1], ny), (at[0], nx)))
        np.add.at(weight[k].reshape(ny, nx), (rows[:, None], cols[None]), w / w.sum() if normalise else w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pixels = batch.column("pixels").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, ny * nx)
                n = len(places)
                k = np.tile(np.arange(n), len(pixels))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("slice_id").take(pa.array(np.repeat(np.arange(len(pixels)), n))), pa.array((k % width).astype(np.int32)), pa.array((k // width).astype(np.int32)), pa.array((pixels @ weight.T).ravel())],
                    ["slice_id", "ox", "oy", "v"],
                )

    return images.select("slice_id", "pixels").mapInArrow(run, "slice_id long, ox int, oy int, v double")


def transformed(images: DataFrame, nx: int, ny: int, scale: float = 1.0, offset: float = 0.0, padding: float = 0.0) -> DataFrame:
    """slice_id and pixels: images (with t: four entries of the inverse in-plane map and the shift) resampled on their own lattice about its centre.

    An output place goes back through shift and inverse; its linear value is
    scaled and shifted, and padding where it falls out of the field of view.
    """
    cx, cy = (nx - 1) / 2, (ny - 1) / 2

    def value(s, own, i):
        x, y = i % nx - cx - s["t"][4], F.floor(i / nx) - cy - s["t"][5]
        return F.struct((s["t"][0] * x + s["t"][1] * y + cx).alias("x"), (s["t"][2] * x + s["t"][3] * y + cy).alias("y"))

    def read(p, own):
        x0, y0 = F.floor(p["x"]), F.floor(p["y"])
        total = F.lit(0.0)
        for a in (0, 1):
            for b in (0, 1):
                x, y = x0 + a, y0 + b
                ok = (x >= 0) & (x < nx) & (y >= 0) & (y < ny)
                total = total + F.when(ok, F.coalesce(F.get(own, (y * nx + x).cast("int")).cast("double"), F.lit(0.0)) * (1 - F.abs(p["x"] - x)) * (1 - F.abs(p["y"] - y))).otherwise(0.0)
        return F.when(coords.inside(p["x"], nx) & coords.inside(p["y"], ny), total * scale + offset).otherwise(F.lit(float(padding)))

    both = F.struct("pixels", "t")
    made = bound(both, lambda s: F.transform(s["pixels"], lambda _, i: bound(value(s, None, i), lambda p: read(p, s["pixels"]))))
    return images.select("slice_id", made.alias("pixels"))


def halved(images: DataFrame, nx: int, ny: int) -> DataFrame:
    """Images at twice the spacing: a place is the mean of the four around it (sizes are even)."""
    w = nx // 2

    def at(own, i):
        first = (F.floor(i / w) * 2 * nx + i % w * 2).cast("int")
        return (F.get(own, first).cast("double") + F.get(own, first + 1) + F.get(own, first + nx) + F.get(own, first + nx + 1)) / 4

    made = bound("pixels", lambda own: F.transform(F.sequence(F.lit(0), F.lit(w * (ny // 2) - 1)), lambda i: at(own, i)))
    return images.withColumn("pixels", made)


def with_noise(pixels: str, key: str, seed: int, low: float, high: float, padding: float | None = None) -> Column:
    """pixels with uniform noise from seed, key and place, so a task that runs again draws the same."""
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), i), F.lit(1 << 30)) / float(1 << 30)
    noisy = lambda v, i: v + low + (high - low) * unit(i)
    return bound(pixels, lambda own: F.transform(own, lambda v, i: noisy(v, i) if padding is None else F.when(v > padding, noisy(v, i)).otherwise(v.cast("double"))))


def template(n: Sequence[Column], spacing: Sequence[float], d: float = 0.0) -> dict[str, Column]:
    """Spacing and sizes of the volume to build over a stack: two slices more, spacing d or the least of the stack's."""
    d = d or min(spacing)
    more = [n[0], n[1], n[2] + 2]
    return {"d": F.lit(float(d)), **{f"n{a}": F.floor(k * s / d).cast("int") for a, k, s in zip("xyz", more, spacing)}}

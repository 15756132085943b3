"""Patches and the volume: which voxels see a patch's pixel, and how much.

Each pixel of a patch looks at a cube of voxels around the one that it is
nearest to. A voxel goes back through the patch's own transformation, and the
point spread at its distance from the pixel is its share; shares under LEAST
don't count, the others are made to sum to 1 over the voxels that exist. So
overlapping patches, which share pixels but not transformations, weigh alike
before they are spread. The relation is that of slices (slice_id is the patch),
so back and forward projection, robust statistics and super-resolution run on
patches as they do on slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.functions.scalars import FWHM
from gridloom.operators import projection as pj, tiles as tl

#: Voxels along an edge of the cube, and the least share against the peak.
SUPPORT, LEAST = 12, 1e-4
#: Voxels of pixels' cubes that are worked on at once.
HELD = 1 << 17


def gaussian(d: np.ndarray, spacing: tuple[float, float, float], in_plane: float = 1.2) -> np.ndarray:
    """A slice's point spread, 1 at its centre, by distances (..., 3)."""
    s = np.array([in_plane * spacing[0], in_plane * spacing[1], spacing[2]]) / FWHM
    return np.exp(-(d * d) @ (1 / (2 * s * s)))


def bartlett(d: np.ndarray, spacing: tuple[float, float, float]) -> np.ndarray:
    """Squared sinc in plane times a Gaussian across."""
    return (np.sinc(d[..., 0] / spacing[0]) * np.sinc(d[..., 1] / spacing[1])) ** 2 * np.exp(-d[..., 2] ** 2 / (2 * spacing[2] ** 2))


def initial(patches: DataFrame, mask: DataFrame) -> DataFrame:
    """patches with v null where a pixel's voxel isn't in the mask (key, vx, vy, vz); patches hold p and centre."""
    kinds = {c: patches.schema[c].dataType.simpleString() for c in ("unit", "key")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [tl.lists(batch.column(c)) for c in ("x", "y", "z", "p", "centre")] if batch.num_rows else []
            take, at, places = [], [], []
            for i, (x, y, z, p, centre) in enumerate(zip(*cols)):
                w = np.floor(tl.placed(np.stack([x, y, z], 1), p.reshape(-1, 6), centre)[0]).astype(np.int32)
                take.append(np.full(len(w), i))
                at.append(np.arange(len(w), dtype=np.int32))
                places.append(w)
            if take:
                w, rows = np.concatenate(places), pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays([batch.column("unit").take(rows), batch.column("key").take(rows), pa.array(np.concatenate(at)), *[pa.array(w[:, a]) for a in range(3)]], ["unit", "key", "at", "vx", "vy", "vz"])

    near = patches.select("unit", "key", "x", "y", "z", "p", "centre").mapInArrow(run, f"unit {kinds['unit']}, key {kinds['key']}, at int, vx int, vy int, vz int")
    known = near.join(mask.select("key", "vx", "vy", "vz"), ["key", "vx", "vy", "vz"], "left_semi").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("at", F.lit(True)))).alias("m"))
    values = F.transform("v", lambda v, i: F.when(F.coalesce(F.try_element_at("m", i), F.lit(False)), v))
    return patches.join(known, "unit", "left").withColumn("v", values).drop("m")


def extents(spread: Callable, spacing: tuple[float, float, float], in_plane: float = 1.2) -> np.ndarray | None:
    """Half axes of the ellipsoid beyond which a point spread's shares are under LEAST; none where it isn't known."""
    if spread is not gaussian:
        return None
    return np.array([in_plane * spacing[0], in_plane * spacing[1], spacing[2]]) / FWHM * np.sqrt(-2 * np.log(LEAST))


def split_patches(size: tuple[int, int], spread: Callable, support: int = SUPPORT, most: np.ndarray | None = None) -> Callable:
    """A function of batches (nz, x, y, z, v, p, centre) that gives image, pixel, voxel (n, 3) and c of known pixels in parts, images ascending.

    most: half axes (see extents) that bound the cube by a patch's turn; all of it without them.
    """
    reach = np.arange(support) - (support - 1) // 2

    def split(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        x, y, z, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z", "v"))
        n = batch.column("x").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        m = tl.matrices(np.stack([p[:6] for p in tl.lists(batch.column("p"))]))
        centre = np.stack(tl.lists(batch.column("centre")))
        known = np.flatnonzero(~np.isnan(v))
        image = np.repeat(np.arange(len(n)), n)[known]
        pixel = known - (np.cumsum(n) - n)[image]
        low, high = (np.broadcast_to(reach[k], (len(n), 3)) for k in (0, -1))
        if most is not None:
            wide = np.floor(np.sqrt(((m[:, :, :3] * most) ** 2).sum(2)) + 0.5 + 1e-6).astype(int)
            low, high = np.maximum(low, -wide), np.minimum(high, wide)
        volume = np.stack([np.full(len(n), size[0]), np.full(len(n), size[1]), batch.column("nz").to_numpy()], 1)
        # Pixels of patches go in parts, as each has a whole cube.
        at = 0
        while at < len(known):
            end = min(len(known), at + max(1, HELD // support**3))
            if most is not None:
                cells = (high - low + 1).prod(1)
                end = min(len(known), at + max(1, HELD // int(cells[image[at : at + HELD]].max())))
            i, own = image[at:end], known[at:end]
            grid = [np.arange(low[i, a].min(), high[i, a].max() + 1) for a in range(3)]
            cube = np.stack(np.meshgrid(*grid, indexing="ij"), -1).reshape(-1, 3)
            points, turn, moved = np.stack([x[own], y[own], z[own]], 1), m[i, :, :3], centre[i] + m[i, :, 3]
            near = np.floor(np.einsum("nrc,nc->nr", turn, points) + moved + 0.5).astype(int)
            first = ((near - moved)[:, None] @ turn)[:, 0] - points
            c = spread((cube.astype(float) @ turn) + first[:, None])
            there = [(near[:, a, None] + g >= 0) & (near[:, a, None] + g < volume[i, a, None]) for a, g in enumerate(grid)]
            c *= (c >= LEAST) & (there[0][:, :, None, None] & there[1][:, None, :, None] & there[2][:, None, None, :]).reshape(c.shape)
            total = c.sum(1)
            of, k = np.nonzero(c)
            if len(of):
                yield i[of], pixel[at:end][of], near[of] + cube[k], c[of, k] / total[of]
            at = end

    return split


def seen_patches(patches: DataFrame, size: tuple[int, int], spread: Callable, support: int = SUPPORT, most: np.ndarray | None = None) -> pj.Relation:
    """The relation of patches and their volumes; patches as for coefficients."""
    low, high = -((support - 1) // 2), support - 1 - (support - 1) // 2

    def reach(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cols = [tl.lists(batch.column(c)) for c in ("x", "y", "z", "p", "centre")]
        box = np.array([[(a.min(), a.max()) if len(a) else (0.0, 0.0) for a in row] for row in zip(*cols[:3])])
        corner = np.stack([np.stack([box[:, a, k >> a & 1] for a in range(3)], 1) for k in range(8)], 1)
        p = np.stack([p[:6] for p in cols[3]])
        w = np.floor(tl.placed_all(corner, p, np.stack(cols[4]))[:, 0] + 0.5).astype(np.int64)
        return w.min(1) - 1 + low, w.max(1) + 1 + high

    rows = patches.select(F.col("key").alias("stack_id"), F.col("unit").alias("slice_id"), F.get("centre", F.lit(2)).alias("z_of"), F.col("depth").alias("nz"), "width", "v", "x", "y", "z", "p", "centre")
    return pj.Relation(rows, size, split_patches(size, spread, support, most), reach, plane="z_of")


def coefficients(patches: DataFrame, size: tuple[int, int], spread: Callable, support: int = SUPPORT) -> DataFrame:
    """stack_id, slice_id, x, y, v, vx, vy, vz, c of every known pixel of every patch as a table; what only sums over it takes seen_patches.

    patches: unit, key, width, depth (of the volume), x, y, z, v, p and centre;
    pixels of a patch run along x first. size: the volume's other two sizes.
    """
    kinds = {c: patches.schema[c].dataType.simpleString() for c in ("unit", "key")}
    names = ["stack_id", "slice_id", "x", "y", "v", "vx", "vy", "vz", "c"]
    split = split_patches(size, spread, support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            n = batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            start, width = np.cumsum(n) - n, batch.column("width").to_numpy()
            i32 = lambda a: pa.array(a.astype(np.int32))
            for image, pixel, voxel, c in split(batch.rename_columns(["nz" if k == "depth" else k for k in batch.schema.names])):
                own = pa.array(image)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(own), batch.column("unit").take(own), i32(pixel % width[image]), i32(pixel // width[image]), pa.array(flat[start[image] + pixel].astype(float)), *[i32(voxel[:, a]) for a in range(3)], pa.array(c)], names)

    rows = patches.select("unit", "key", "width", "depth", "x", "y", "z", "v", "p", "centre")
    return rows.mapInArrow(run, f"stack_id {kinds['key']}, slice_id {kinds['unit']}, x int, y int, v double, vx int, vy int, vz int, c double")


def in_mask(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows of voxels in the mask, of coefficients or of sums over them; sums to a pixel over these tell how much of it the mask keeps."""
    return rows.join(mask.select(F.col("key").alias("stack_id"), "vx", "vy", "vz"), ["stack_id", "vx", "vy", "vz"], "left_semi").select(*rows.columns)

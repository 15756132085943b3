"""Kernels on whole images in numpy, for what Columns can't express.

Images come in block form, so mapInPandas needs no shuffle; groups of images
(a stack) come by applyInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], nx: int, out: str = "pixels", kind: str = "array<double>") -> DataFrame:
    """images with the kernel's array in place of (or beside) pixels."""
    keep = [c for c in images.columns if c != out]
    fields = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [kernel(np.asarray(p, float).reshape(-1, nx)).ravel() for p in f["pixels"]]
            yield f[keep].assign(**{out: made})

    return images.mapInPandas(run, f"{fields}, {out} {kind}")


def per_volume(volumes: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], nx: int, ny: int) -> DataFrame:
    """stack_id and pixels: the kernel's array for volumes in block form (z, y, x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"stack_id": f["stack_id"], "pixels": [np.asarray(kernel(np.asarray(p, float).reshape(-1, ny, nx)), float).ravel() for p in f["pixels"]]})

    return volumes.select("stack_id", "pixels").mapInPandas(run, "stack_id int, pixels array<double>")


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of connected parts (edges or faces shared), each the smallest index of its part; -1 outside."""
    flat = mask.ravel()
    label = np.where(flat, np.arange(flat.size), -1)
    while True:
        new = label.reshape(mask.shape).copy()
        for axis in range(mask.ndim):
            a, b = (np.take(new, range(*r), axis) for r in ((mask.shape[axis] - 1,), (1, mask.shape[axis])))
            low = np.where((a >= 0) & (b >= 0), np.minimum(a, b), flat.size)
            for k in (0, 1):
                part = np.moveaxis(new, axis, 0)[k : mask.shape[axis] - 1 + k]
                part[...] = np.where(part >= 0, np.minimum(part, np.moveaxis(low, axis, 0)), part)
        new = new.ravel()
        new[new >= 0] = new[new[new >= 0]]
        if (new == label).all():
            return label.reshape(mask.shape)
        label = new


def largest_component(mask: np.ndarray) -> np.ndarray:
    """1 in the largest part, that of the smallest index on ties."""
    label = components(mask)
    if (label < 0).all():
        return np.zeros(mask.shape)
    ids, n = np.unique(label[label >= 0], return_counts=True)
    return (label == ids[np.argmax(n)]).astype(float)


def distances(mask: np.ndarray, spacing: tuple[float, ...] | None = None, city: bool = False) -> np.ndarray:
    """Distance of each place to the nearest place of the mask; infinite where the mask is empty.

    One axis at a time. City-block distances run forth and back along it; the
    squares of others take, for growing steps, the least of what lies a step
    away, until no step can gain.
    """
    spacing = spacing or (1.0,) * mask.ndim
    d = np.where(mask, 0.0, np.inf)
    for axis in range(mask.ndim):
        d = np.moveaxis(d, axis, 0)
        n, h = len(d), spacing[axis]
        if city:
            for order in (range(1, n), range(n - 2, -1, -1)):
                for i in order:
                    d[i] = np.minimum(d[i], d[i - 1 if order.step > 0 else i + 1] + h)
        else:
            was = d.copy()
            for k in range(1, n):
                gain = (k * h) ** 2
                if not (d[np.isfinite(d)] > gain).any() and np.isfinite(d).all():
                    break
                d[k:] = np.minimum(d[k:], was[:-k] + gain)
                d[:-k] = np.minimum(d[:-k], was[k:] + gain)
        d = np.moveaxis(d, 0, axis)
    return d if city else np.sqrt(d)


def fourier_blur(sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """Gaussian blur by the Fourier transform, periodic at the ends."""

    def run(image: np.ndarray) -> np.ndarray:
        ky, kx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None]
        return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2 * (np.pi * sigma) ** 2 * (kx * kx + ky * ky))).real

    return run


def diffusion(steps: int, k: float, tau: float = 0.2) -> Callable[[np.ndarray], np.ndarray]:
    """Explicit edge-preserving diffusion; differences beyond k hardly pass."""

    def run(image: np.ndarray) -> np.ndarray:
        u = image.copy()
        for _ in range(steps):
            flow = np.zeros_like(u)
            for axis in (0, 1):
                d = np.diff(u, axis=axis)
                f = d / (1 + (d / k) ** 2)
                pad = [(0, 0), (0, 0)]
                pad[axis] = (0, 1)
                flow += np.pad(f, pad)
                pad[axis] = (1, 0)
                flow -= np.pad(f, pad)
            u += tau * flow
        return u

    return run


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The first value at which the cumulated weight reaches half."""
    order = np.argsort(values, kind="stable")
    up = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(up, up[-1] / 2)])


def nonlocal_median(reach: int, sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """Weighted median of a window, nearer in value weighs more; mirrored at edges."""

    def run(image: np.ndarray) -> np.ndarray:
        padded = np.pad(image, reach, "reflect")
        out = np.empty_like(image)
        for y in range(image.shape[0]):
            for x in range(image.shape[1]):
                window = padded[y : y + 2 * reach + 1, x : x + 2 * reach + 1].ravel()
                out[y, x] = weighted_median(window, np.exp(-(((window - image[y, x]) / sigma) ** 2)))
        return out

    return run


def spline_coefficients(image: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through an image, mirrored at edges: the samples' equations, solved by axis."""
    out = image
    for axis in (0, 1):
        n = out.shape[axis]
        m = np.zeros((n, n))
        for i in range(n):
            for k, w in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
                j = abs(i + k)
                m[i, min(j, 2 * (n - 1) - j)] += w
        out = np.moveaxis(np.linalg.solve(m, np.moveaxis(out, axis, 0).reshape(n, -1)).reshape(np.moveaxis(out, axis, 0).shape), 0, axis)
    return out


def motion_scores(images: DataFrame, energy: float = 0.99) -> DataFrame:
    """stack_id, rank, error and score: how few singular vectors hold the energy of a stack's first third."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("slice_id")
        m = np.stack([np.asarray(p, float) for p in f["pixels"][: max(1, len(f) // 3)]], 1)
        s = np.linalg.svd(m, compute_uv=False)
        share = np.sqrt(np.cumsum(s**2) / max((s**2).sum(), 1e-300))
        r = int((share < energy).sum()) + 1
        error = float(np.sqrt((s[r:] ** 2).sum() / max((s**2).sum(), 1e-300)))
        return pd.DataFrame({"stack_id": [key[0]], "rank": [r], "error": [error], "score": [error * r]})

    return images.select("stack_id", "slice_id", "pixels").groupBy("stack_id").applyInPandas(run, "stack_id int, rank int, error double, score double")


def rigid_points(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None, cov: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that lay points p on q with least squares; weights act on the covariance alone, which may be given."""
    a, b = p - p.mean(0), q - q.mean(0)
    u, _, vt = np.linalg.svd((a * (1 if w is None else w[:, None])).T @ b if cov is None else cov)
    turn = np.diag([1.0] * (p.shape[1] - 1) + [np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ turn @ u.T
    return r, q.mean(0) - r @ p.mean(0)


def embedding(affinity: np.ndarray, k: int) -> np.ndarray:
    """The smallest non-trivial eigenvectors of the normalised Laplacian."""
    d = affinity.sum(1)
    half = 1 / np.sqrt(np.where(d > 0, d, 1))
    lap = np.eye(len(d)) - half[:, None] * affinity * half[None]
    _, v = np.linalg.eigh(lap)
    v = v[:, 1 : k + 1]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear values at points; not a number outside."""
    ny, nx = image.shape
    x0, y0 = np.clip(np.floor(x), 0, nx - 2).astype(int), np.clip(np.floor(y), 0, ny - 2).astype(int)
    fx, fy = x - x0, y - y0
    v = (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy
    return np.where((x >= 0) & (x <= nx - 1) & (y >= 0) & (y <= ny - 1), v, np.nan)


def moved(image: np.ndarray, tx: float, ty: float, rz: float) -> np.ndarray:
    """The image under a turn about its centre (degrees) and a shift."""
    ny, nx = image.shape
    y, x = np.mgrid[:ny, :nx] - np.array([(ny - 1) / 2, (nx - 1) / 2])[:, None, None]
    c, s = np.cos(np.radians(rz)), np.sin(np.radians(rz))
    return sample(image, c * x - s * y + tx + (nx - 1) / 2, s * x + c * y + ty + (ny - 1) / 2)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    ok = ~np.isnan(b)
    if ok.sum() < 4:
        return -1.0
    x, y = a[ok] - a[ok].mean(), b[ok] - b[ok].mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n > 0 else 0.0


def registered(target: np.ndarray, source: np.ndarray, steps: tuple[float, ...] = (1.0, 0.5, 0.25, 0.125), rounds: int = 20) -> tuple[np.ndarray, float]:
    """Shift and turn of source that correlate best with target: at each step length the best single change, until none gains."""
    p = np.zeros(3)
    best = correlation(target, moved(source, *p))
    for step in steps:
        for _ in range(rounds):
            tries = [p + sign * step * np.array(u) for u in ((1, 0, 0), (0, 1, 0), (0, 0, 4)) for sign in (1, -1)]
            scores = [correlation(target, moved(source, *t)) for t in tries]
            k = int(np.argmax(scores))
            if scores[k] <= best + 1e-9:
                break
            p, best = tries[k], scores[k]
    return p, best


def registration(images: DataFrame, nx: int) -> DataFrame:
    """slice_id, tx, ty, rz, before and after: every slice laid on its stack's mean image.

    The mean is an aggregate of arrays by place, so a stack is never gathered.
    """
    at = images.select("stack_id", F.posexplode("pixels").alias("at", "v")).groupBy("stack_id", "at").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = at.groupBy("stack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, p, m in zip(f["slice_id"], f["pixels"], f["mean"]):
                source, target = np.asarray(p, float).reshape(-1, nx), np.asarray(m, float).reshape(-1, nx)
                t, after = registered(target, source)
                rows.append((s, *t, correlation(target, source), after))
            yield pd.DataFrame(rows, columns=["slice_id", "tx", "ty", "rz", "before", "after"])

    return images.join(mean, "stack_id").select("slice_id", "pixels", "mean").mapInPandas(run, "slice_id long, tx double, ty double, rz double, before double, after double")


def eigenvalues(rows: DataFrame) -> DataFrame:
    """slice_id and values: the eigenvalues, the largest first, of symmetric 2 x 2 matrices (m: xx, xy, yy)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = np.stack(f["m"].to_list())[:, [0, 1, 1, 2]].reshape(-1, 2, 2)
                yield pd.DataFrame({"slice_id": f["slice_id"], "values": list(np.linalg.eigvalsh(m)[:, ::-1])})

    return rows.mapInPandas(run, "slice_id long, values array<double>")


def candidate_shifts(images: DataFrame, nx: int) -> DataFrame:
    """slice_id, gx, gy, best: correlations of an image (pixels), shifted by one either way on both axes, with mean; their differences as a unit vector, and the highest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            source, target = (np.stack([np.asarray(v, float) for v in f[c]]).reshape(len(f), -1, nx) for c in ("pixels", "mean"))

            def score(dx: int, dy: int) -> np.ndarray:
                ny = source.shape[1]
                a = target[:, max(0, -dy) : ny - max(0, dy), max(0, -dx) : nx - max(0, dx)].reshape(len(f), -1)
                b = source[:, max(0, dy) : ny + min(0, dy), max(0, dx) : nx + min(0, dx)].reshape(len(f), -1)
                a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
                return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))

            found = {k: score(*k) for k in ((1, 0), (-1, 0), (0, 1), (0, -1))}
            gx, gy = found[(1, 0)] - found[(-1, 0)], found[(0, 1)] - found[(0, -1)]
            n = np.hypot(gx, gy)
            yield pd.DataFrame({"slice_id": f["slice_id"], "gx": gx / n, "gy": gy / n, "best": np.max(list(found.values()), 0)})

    return images.select("slice_id", "pixels", "mean").mapInPandas(run, "slice_id long, gx double, gy double, best double")

"""Scalar functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

STEP = 0.0001
FWHM = 2.3548


def gaussian_density(x: Column, variance: Column, step: float = STEP) -> Column:
    return step * F.exp(-x * x / (2 * variance)) / F.sqrt(6.28 * variance)


def uniform_density(m: Column, step: float = STEP) -> Column:
    return m * step


def smoothing_parameters(delta: float, lam: float) -> tuple[float, float]:
    """Lambda scaled by delta squared, and alpha, at most 1, from the lambda given."""
    return lam * delta * delta, min(1.0, 0.05 / lam)


def cutoff(x: float) -> float:
    return min(1.0, max(0.0, x))


def psf_gaussian(x: Column, y: Column, z: Column, dx: float, dy: float, dz: float, in_plane: float = 1.2) -> Column:
    """Unnormalised Gaussian point spread of a slice's pixel size and thickness."""
    sx, sy, sz = in_plane * dx / FWHM, in_plane * dy / FWHM, dz / FWHM
    return F.exp(-x * x / (2 * sx * sx) - y * y / (2 * sy * sy) - z * z / (2 * sz * sz))


def psf_sinc(r: Column, z: Column, dz: float) -> Column:
    """Sinc in plane times a Gaussian across; 1 at the centre."""
    sz = dz / FWHM
    return F.when(r == 0, 1.0).otherwise(F.sin(r) / r) * F.exp(-z * z / (2 * sz * sz))


def psf_bartlett(x: Column, y: Column, z: Column, dx: float, dy: float, dz: float) -> Column:
    """Squared sinc in plane times a Gaussian across."""
    sinc = lambda a: F.when(F.abs(a) < 1e-8, 1.0).otherwise(F.sin(math.pi * a) / (math.pi * a))
    return F.pow(sinc(x / dx) * sinc(y / dy), 2) * F.exp(-z * z / (2 * dz * dz))


def bspline(i: int, t: Column) -> Column:
    """The i-th of the four cubic B-spline basis functions at t in [0, 1)."""
    return ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)[i]


def cubic(x: Column) -> Column:
    """Interpolating cubic kernel with a = -1."""
    a = F.abs(x)
    return F.when(a < 1, a**3 - 2 * a**2 + 1).when(a < 2, -(a**3) + 5 * a**2 - 8 * a + 4).otherwise(0.0)


def hann_sinc(x: Column, width: int = 6) -> Column:
    a = math.pi * x
    return F.when(x == 0, 1.0).when(F.abs(x) < width, F.sin(a) / a * 0.5 * (1 + F.cos(a / width))).otherwise(0.0)


def gaussian_kernel(sigma: float, spacing: float = 1.0) -> list[tuple[int, float]]:
    """Offsets and weights of a blur; half-width of four deviations."""
    half = int(math.floor(4 * sigma / spacing + 0.5))
    return [(k, math.exp(-((k * spacing) ** 2) / (2 * sigma * sigma))) for k in range(-half, half + 1)]


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of sRGB values from 0 to 255."""
    lin = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, 2.4)) for c in (r, g, b)]
    # sRGB to XYZ by rows, and the white point.
    rows = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    white = (0.950456, 1.0, 1.088754)
    f = []
    for row, w in zip(rows, white):
        t = sum((k * c for k, c in zip(row[1:], lin[1:])), row[0] * lin[0]) / w
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise((903.3 * t + 16.0) / 116.0))
    return 116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def parameter_line(line: Column) -> tuple[Column, Column]:
    """Key and value of `key = value`; what follows # is a comment."""
    bare = F.regexp_replace(line, "#.*$", "")
    return F.trim(F.regexp_extract(bare, "^([^=]*)=", 1)), F.trim(F.regexp_extract(bare, "=(.*)$", 1))


#: Names of voxel and transformation types by number.
VOXEL_TYPES = ("unknown", "char", "unsigned char", "short", "unsigned short", "int", "unsigned int", "float", "double")
TRANSFORMATIONS = {1: "homogeneous", 2: "rigid", 3: "affine"}


def voxel_type_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, VOXEL_TYPES)), code), F.lit("unknown"))


def transformation_name(code: Column) -> Column:
    name = F.lit("unknown")
    for k, v in TRANSFORMATIONS.items():
        name = F.when(code == k, v).otherwise(name)
    return name


def tokens(text: Column) -> Column:
    """The words of a text without its comments, which run from # to the line's end."""
    return F.filter(F.split(F.regexp_replace(text, r"#[^\n]*", ""), r"\s+"), lambda t: t != "")


def gaussian_derivative(x: Column, order: int, sigma: float = 1.0) -> Column:
    """The normal density, or its first or second derivative."""
    t = x / sigma
    g = F.exp(-0.5 * t * t) / (sigma * math.sqrt(2 * math.pi))
    return (g, -t / sigma * g, (t * t - 1) / (sigma * sigma) * g)[order]

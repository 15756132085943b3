"""Affine and rigid coordinate maps as Columns; matrices are lists of 12 Columns, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Matrix = list[Column]


def number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def apply(m: Sequence[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The three coordinates of m times (x, y, z, 1)."""
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))


def compose(a: Sequence[Column], b: Sequence[Column]) -> Matrix:
    """a after b."""
    out = []
    for r in range(3):
        for c in range(4):
            term = sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 3)), a[4 * r] * b[c])
            out.append(term + a[4 * r + 3] if c == 3 else term)
    return out


def rigid(tx, ty, tz, rx, ry, rz) -> Matrix:
    """The matrix of six parameters: millimetres, and Euler angles in degrees."""
    tx, ty, tz = map(number, (tx, ty, tz))
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(F.radians(number(a))), F.sin(F.radians(number(a)))) for a in (rx, ry, rz))
    return [
        cy * cz, cy * sz, -sy, tx,
        sx * sy * cz - cx * sz, sx * sy * sz + cx * cz, sx * cy, ty,
        cx * sy * cz + sx * sz, cx * sy * sz - sx * cz, cx * cy, tz,
    ]


def rigid_inverse(m: Sequence[Column]) -> Matrix:
    """The inverse of a rigid matrix: transposed rotation, and its product with minus the translation."""
    out = []
    for r in range(3):
        rot = [m[4 * k + r] for k in range(3)]
        out += [*rot, -(rot[0] * m[3] + rot[1] * m[7] + rot[2] * m[11])]
    return out


def parameters(m: Sequence[Column]) -> dict[str, Column]:
    """Six rigid parameters of a matrix; where cos(ry) vanishes rx is 0 and rz takes the turn."""
    ry = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2])))
    level = F.abs(F.cos(ry)) > 1e-6
    turn = F.when(m[2] < 0, 1.0).otherwise(-1.0)
    rx = F.when(level, F.atan2(m[6], m[10])).otherwise(F.atan2(turn * m[4], turn * m[8]))
    rz = F.when(level, F.atan2(m[1], m[0])).otherwise(F.lit(0.0))
    return {"tx": m[3], "ty": m[7], "tz": m[11], "rx": F.degrees(rx), "ry": F.degrees(ry), "rz": F.degrees(rz)}


def affine(tx, ty, tz, rx, ry, rz, sx=100.0, sy=100.0, sz=100.0, sxy=0.0, sxz=0.0, syz=0.0) -> Matrix:
    """Rigid times shear times scale; scales in percent, shears in degrees."""
    scale = [number(s) / 100 for s in (sx, sy, sz)]
    txy, txz, tyz = (F.tan(F.radians(number(a))) for a in (sxy, sxz, syz))
    one, zero = F.lit(1.0), F.lit(0.0)
    shear = [one, txy, txz, zero, zero, one, tyz, zero, zero, zero, one, zero]
    stretch = [scale[0], zero, zero, zero, zero, scale[1], zero, zero, zero, zero, scale[2], zero]
    return compose(compose(rigid(tx, ty, tz, rx, ry, rz), shear), stretch)


def image_to_world(n: Sequence, d: Sequence, origin: Sequence = (0.0, 0.0, 0.0), axes: Sequence = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)) -> Matrix:
    """Lattice to millimetres; the origin is the image's centre, axes are its x, y and z directions in turn."""
    n, d, origin, axes = ([number(v) for v in s] for s in (n, d, origin, axes))
    out = []
    for r in range(3):
        step = [axes[3 * c + r] * d[c] for c in range(3)]
        centre = sum((step[c] * (n[c] - 1) / 2 for c in range(1, 3)), step[0] * (n[0] - 1) / 2)
        out += [*step, origin[r] - centre]
    return out


def world_to_image(n: Sequence, d: Sequence, origin: Sequence = (0.0, 0.0, 0.0), axes: Sequence = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)) -> Matrix:
    """Millimetres to lattice, for orthonormal axes."""
    n, d, origin, axes = ([number(v) for v in s] for s in (n, d, origin, axes))
    out = []
    for r in range(3):
        row = [axes[3 * r + c] / d[r] for c in range(3)]
        shift = sum((row[c] * origin[c] for c in range(1, 3)), row[0] * origin[0])
        out += [*row, (n[r] - 1) / 2 - shift]
    return out


def lattice_index(x, y, z=0, t=0, nx=1, ny=1, nz=1) -> Column:
    return ((number_int(t) * nz + number_int(z)) * ny + number_int(y)) * nx + number_int(x)


def number_int(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def nearest(x: Column) -> Column:
    """Half away from zero, as an integer."""
    return F.round(x).cast("int")


def inside(x: Column, n: int | Column) -> Column:
    """Whether a lattice coordinate lies in the field of view."""
    return (x >= -0.5) & (x < number_int(n) - 0.5)


def to_time(frame: Column, origin: float, step: float) -> Column:
    return origin + frame * step


def to_frame(time: Column, origin: float, step: float) -> Column:
    return (time - origin) / step


def origin_reset(m: Sequence[Column], origin: Sequence[Column]) -> Matrix:
    """m for an image whose origin is taken to zero: the origin goes into the translation, so that rotation is about the centre."""
    out = list(m)
    for r in range(3):
        out[4 * r + 3] = m[4 * r] * origin[0] + m[4 * r + 1] * origin[1] + m[4 * r + 2] * origin[2] + m[4 * r + 3]
    return out


def origin_restored(m: Sequence[Column], origin: Sequence[Column]) -> Matrix:
    """The matrix before origin_reset."""
    return origin_reset(m, [-o for o in origin])


def box_origin(origin: float, n: int, spacing: float, low: int, high: int) -> float:
    """The centre, on one axis, of the places from low to before high of an image of n places about origin."""
    return origin + ((low + high - 1) / 2 - (n - 1) / 2) * spacing

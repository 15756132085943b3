"""Vectors, 3 x 3 matrices and rotations as Columns; matrices are lists of nine Columns, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vector) -> list[Column]:
    """a over its length; a zero vector stays."""
    n = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return [F.coalesce(x / n, F.lit(0.0)) for x in a]


def orthonormal(rows: DataFrame, names: Sequence[Sequence[str]]) -> DataFrame:
    """rows with three vectors (names of their columns) made orthonormal by Gram-Schmidt, one after the other.

    Each vector is a column before the next reads it: written as one expression the work doubles with every use.
    """
    done: list[list[str]] = []
    for own in names:
        v = [F.col(n) for n in own]
        rest = [x - sum((dot([F.col(n) for n in u], v) * F.col(u[k]) for u in done), F.lit(0.0)) for k, x in enumerate(v)]
        rows = rows.withColumns({f"_{n}": r for n, r in zip(own, rest)})
        rows = rows.withColumns({n: u for n, u in zip(own, unit([F.col(f"_{n}") for n in own]))}).drop(*[f"_{n}" for n in own])
        done.append(list(own))
    return rows


def product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)]


def transposed(m: Sequence[Column]) -> list[Column]:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def adjugate(m: Sequence[Column]) -> list[Column]:
    rows = [m[0:3], m[3:6], m[6:9]]
    columns = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    return [columns[c][r] for r in range(3) for c in range(3)]


def determinant(m: Sequence[Column]) -> Column:
    return dot(m[0:3], cross(m[3:6], m[6:9]))


def inverse(m: Sequence[Column]) -> list[Column]:
    """Null where the determinant vanishes."""
    d = F.nullif(determinant(m), F.lit(0.0))
    return [a / d for a in adjugate(m)]


def quaternion(axis: Vector, degrees: Column) -> list[Column]:
    half = F.radians(degrees) / 2
    return [F.cos(half), *[F.sin(half) * x for x in unit(axis)]]


def quaternion_product(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    w = p[0] * q[0] - dot(p[1:], q[1:])
    return [w, *[p[0] * y + q[0] * x + z for x, y, z in zip(p[1:], q[1:], cross(p[1:], q[1:]))]]


def quaternion_matrix(q: Sequence[Column]) -> list[Column]:
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def axis_angle(m: Sequence[Column]) -> tuple[list[Column], Column]:
    """Axis and angle (radians) of a rotation of less than half a turn; the axis of no rotation is zero."""
    turn = [(m[7] - m[5]) / 2, (m[2] - m[6]) / 2, (m[3] - m[1]) / 2]
    cos = (m[0] + m[4] + m[8] - 1) / 2
    return unit(turn), F.atan2(F.sqrt(dot(turn, turn)), cos)


def rotated(axis: Vector, radians: Column, p: Vector) -> list[Column]:
    """p turned about a unit axis through the origin."""
    c, s = F.cos(radians), F.sin(radians)
    along = dot(axis, p)
    return [x * c + y * s + k * along * (1 - c) for x, y, k in zip(p, cross(axis, p), axis)]

"""Queries of coordinates, points, matrices, lattices and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from gridloom.functions import coords, linear, scalars
from gridloom.operators import histograms as hist, images as im, points as pt
from gridloom.queries import JOINT, PAIRS, POSE, matrix, pair_histogram, pair_pixels
from gridloom.registry import PX, PX3, R, query, rounded
from gridloom.sources import surrogate as sg

D = "::DOUBLE"


def _double(c):
    return F.col(c).cast("double")


# Coordinates


@query(f"WITH {PX3} SELECT slice_id, x, y, {R('2.5 + z * 0.75', 'time')}, {R('(2.5 + z * 0.75 - 2.5) / 0.75', 'frame')} FROM px3")
def image_time(spark, sf_dir):
    """The time of a frame on an axis with origin and step, and back."""
    rows = sg.px3(spark, sf_dir).withColumn("time", coords.to_time(F.col("z"), 2.5, 0.75))
    return rounded(rows.select("slice_id", "x", "y", "time", coords.to_frame(F.col("time"), 2.5, 0.75).alias("frame")))


AFFINE = f"""{POSE}, af AS (SELECT mat.*, 1 + (slice_id % 5) * 0.02{D} AS sx, 1 - (slice_id % 3) * 0.03{D} AS sy, 1 + (slice_id % 2) * 0.05{D} AS sz,
 tan(radians((slice_id % 4) * 1.5{D})) AS hxy, tan(radians((slice_id % 3) * 2.0{D})) AS hxz, tan(radians((slice_id % 5) * 0.5{D})) AS hyz FROM mat)"""


def affine():
    i, d = F.col("slice_id"), lambda c: c.cast("double")
    return coords.affine(
        **sg.pose(i), sx=100 + d(i % 5) * 2, sy=100 - d(i % 3) * 3, sz=100 + d(i % 2) * 5, sxy=d(i % 4) * 1.5, sxz=d(i % 3) * 2, syz=d(i % 5) * 0.5
    )


@query(f"""WITH {PX3}, {AFFINE}, s AS (SELECT px3.slice_id, px3.x, px3.y, sx * (px3.x - 3.5) + hxy * sy * (px3.y - 3.5) + hxz * sz * z AS a, sy * (px3.y - 3.5) + hyz * sz * z AS b, sz * z AS c FROM px3 JOIN af USING (slice_id))
SELECT slice_id, x, y, {R('m0 * a + m1 * b + m2 * c + m3', 'wx')}, {R('m4 * a + m5 * b + m6 * c + m7', 'wy')}, {R('m8 * a + m9 * b + m10 * c + m11', 'wz')} FROM s JOIN af USING (slice_id)""")
def affine_transform_points(spark, sf_dir):
    w = coords.apply(affine(), F.col("x") - 3.5, F.col("y") - 3.5, F.col("z"))
    return rounded(sg.px3(spark, sf_dir).select("slice_id", "x", "y", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))]))


@query(f"""WITH {PX3}, {AFFINE}, s AS (SELECT px3.*, sx * (px3.x - 3.5) + hxy * sy * (px3.y - 3.5) + hxz * sz * z AS a, sy * (px3.y - 3.5) + hyz * sz * z AS b, sz * z AS c, sx * sy * sz AS det FROM px3 JOIN af USING (slice_id))
SELECT s.slice_id, s.x, s.y, {R('m0 * a + m1 * b + m2 * c + m3 - (s.x - 3.5)', 'ux')}, {R('m4 * a + m5 * b + m6 * c + m7 - (s.y - 3.5)', 'uy')}, {R('m8 * a + m9 * b + m10 * c + m11 - z', 'uz')}, {R('det', 'jacobian')},
 {R('s.x - 3.5', 'bx')}, {R('s.y - 3.5', 'by')}, {R('z::DOUBLE', 'bz')} FROM s JOIN af USING (slice_id)""")
def displacement_jacobian(spark, sf_dir):
    """Displacement of each pixel under its affine map, the determinant of the Jacobian, and the way back through the inverse."""
    m = affine()
    p = (F.col("x") - 3.5, F.col("y") - 3.5, _double("z"))
    part = [m[4 * r + c] for r in range(3) for c in range(3)]
    rows = sg.px3(spark, sf_dir).select("slice_id", "x", "y", "z", *[c.alias(n) for c, n in zip(coords.apply(m, *p), "abc")], linear.determinant(part).alias("jacobian"))
    inv = linear.inverse(part)
    back = [linear.dot(inv[3 * r : 3 * r + 3], [F.col(n) - m[4 * k + 3] for k, n in enumerate("abc")]) for r in range(3)]
    return rounded(rows.select("slice_id", "x", "y", *[(F.col(n) - q).alias(u) for n, q, u in zip("abc", p, ("ux", "uy", "uz"))], "jacobian", *[b.alias(n) for b, n in zip(back, ("bx", "by", "bz"))]))


@query(f"""WITH {POSE}, g AS (SELECT *, 10.0 + slice_id % 7 AS gx, -5.0 AS gy, (slice_id % 4) * 3.0 AS gz FROM mat)
SELECT slice_id, {R('m0 * gx + m1 * gy + m2 * gz + m3', 'tx')}, {R('m4 * gx + m5 * gy + m6 * gz + m7', 'ty')}, {R('m8 * gx + m9 * gy + m10 * gz + m11', 'tz')}, {R('m3', 'tx0')}, {R('m7', 'ty0')}, {R('m11', 'tz0')} FROM g""")
def origin_reset(spark, sf_dir):
    """The origin moved into the translation, so that rotation is about the image's centre, and restored."""
    g = (10.0 + F.col("slice_id") % 7, F.lit(-5.0), F.col("slice_id") % 4 * 3.0)
    moved = coords.origin_reset(matrix(), g)
    back = coords.origin_restored(moved, g)
    at = lambda m, s: [m[4 * r + 3].alias(f"t{a}{s}") for r, a in enumerate("xyz")]
    return rounded(sg.blocks(spark, sf_dir).select("slice_id", *at(moved, ""), *at(back, "0")))


@query(f"""WITH {PX3}, {POSE} SELECT slice_id, x, y, m0 * (x - 3.5) + m1 * (y - 3.5) + m2 * z + m3 + 3.5 >= -0.5 AND m0 * (x - 3.5) + m1 * (y - 3.5) + m2 * z + m3 + 3.5 < 7.5
 AND m4 * (x - 3.5) + m5 * (y - 3.5) + m6 * z + m7 + 3.5 >= -0.5 AND m4 * (x - 3.5) + m5 * (y - 3.5) + m6 * z + m7 + 3.5 < 7.5 AS inside FROM px3 JOIN mat USING (slice_id)""")
def field_of_view(spark, sf_dir):
    wx, wy, _ = coords.apply(matrix(), F.col("x") - 3.5, F.col("y") - 3.5, F.col("z"))
    return sg.px3(spark, sf_dir).select("slice_id", "x", "y", (coords.inside(wx + 3.5, 8) & coords.inside(wy + 3.5, 8)).alias("inside"))


# Matrices, vectors, rotations


VEC = "v AS (SELECT vec_id AS slice_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE + {1.0 if i in (0, 4, 8) else 0.0}::DOUBLE AS e{i}" for i in range(9)) + " FROM embeddings)"


def entries(spark, sf_dir):
    return sg.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slice_id"), *[(F.get("embedding", F.lit(i)).cast("double") + (1.0 if i in (0, 4, 8) else 0.0)).alias(f"e{i}") for i in range(9)])


@query(f"""WITH {VEC}, d AS (SELECT *, e0 * (e4 * e8 - e5 * e7) - e1 * (e3 * e8 - e5 * e6) + e2 * (e3 * e7 - e4 * e6) AS det FROM v)
SELECT slice_id, {R('det', 'det')}, {R('e0 + e4 + e8', 'trace')}, {R('(e4 * e8 - e5 * e7) / det', 'i0')}, {R('(e2 * e7 - e1 * e8) / det', 'i1')}, {R('(e1 * e5 - e2 * e4) / det', 'i2')}, {R('(e5 * e6 - e3 * e8) / det', 'i3')}, {R('(e0 * e8 - e2 * e6) / det', 'i4')},
 {R('(e2 * e3 - e0 * e5) / det', 'i5')}, {R('(e3 * e7 - e4 * e6) / det', 'i6')}, {R('(e1 * e6 - e0 * e7) / det', 'i7')}, {R('(e0 * e4 - e1 * e3) / det', 'i8')}, 1.0{D} AS p0, 0.0{D} AS p1 FROM d""")
def matrix_algebra(spark, sf_dir):
    """Determinant, trace, inverse, and the first entries of matrix times inverse."""
    m = [F.col(f"e{i}") for i in range(9)]
    inv = linear.inverse(m)
    p = linear.product(m, inv)
    return rounded(entries(spark, sf_dir).select("slice_id", linear.determinant(m).alias("det"), (m[0] + m[4] + m[8]).alias("trace"), *[c.alias(f"i{k}") for k, c in enumerate(inv)], p[0].alias("p0"), p[1].alias("p1")))


@query(f"""WITH {VEC}, n AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS la, e0 * e3 + e1 * e4 + e2 * e5 AS ab FROM v), o AS (SELECT *, ab / (la * la) AS k FROM n), q AS (SELECT *, e3 - k * e0 AS f0, e4 - k * e1 AS f1, e5 - k * e2 AS f2 FROM o)
SELECT slice_id, {R('ab', 'dot')}, {R('e1 * e5 - e2 * e4', 'cx')}, {R('e2 * e3 - e0 * e5', 'cy')}, {R('e0 * e4 - e1 * e3', 'cz')}, {R('e0 / la', 'ux')}, {R('f0 / sqrt(f0 * f0 + f1 * f1 + f2 * f2)', 'vx')},
 1.0{D} AS volume FROM q""")
def vector_suite(spark, sf_dir):
    """Dot and cross product, a unit vector, and an orthonormal frame whose volume is one."""
    e = [F.col(f"e{i}") for i in range(9)]
    a, b = e[0:3], e[3:6]
    names = [[f"e{3 * r + c}" for c in range(3)] for r in range(3)]
    rows = entries(spark, sf_dir).select("*", linear.dot(a, b).alias("dot"), *[k.alias(n) for k, n in zip(linear.cross(a, b), ("cx", "cy", "cz"))])
    frame = linear.orthonormal(rows, names)
    return rounded(frame.select("slice_id", "dot", "cx", "cy", "cz", F.col("e0").alias("ux"), F.col("e3").alias("vx"), F.abs(linear.determinant(e)).alias("volume")))


@query(f"""WITH {PX3}, a AS (SELECT *, radians((slice_id % 9) * 10.0{D}) AS t, 2.0{D} / 3 AS kx, 1.0{D} / 3 AS ky, 2.0{D} / 3 AS kz, x - 3.5 AS px, y - 3.5 AS py, z::DOUBLE AS pz FROM px3), b AS (SELECT *, kx * px + ky * py + kz * pz AS along FROM a)
SELECT slice_id, x, y, {R('px * cos(t) + (ky * pz - kz * py) * sin(t) + kx * along * (1 - cos(t))', 'wx')}, {R('py * cos(t) + (kz * px - kx * pz) * sin(t) + ky * along * (1 - cos(t))', 'wy')}, {R('pz * cos(t) + (kx * py - ky * px) * sin(t) + kz * along * (1 - cos(t))', 'wz')},
 {R('degrees(t)', 'angle')} FROM b""")
def quaternion_transform(spark, sf_dir):
    """Points turned by a quaternion's matrix, and the angle that the matrix gives back; half the turn twice is the turn."""
    axis = [F.lit(2.0), F.lit(1.0), F.lit(2.0)]
    half = linear.quaternion(axis, (F.col("slice_id") % 9) * 5.0)
    m = linear.quaternion_matrix(linear.quaternion_product(half, half))
    p = [F.col("x") - 3.5, F.col("y") - 3.5, _double("z")]
    w = [linear.dot(m[3 * r : 3 * r + 3], p) for r in range(3)]
    return rounded(sg.px3(spark, sf_dir).select("slice_id", "x", "y", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))], F.degrees(linear.axis_angle(m)[1]).alias("angle")))


@query(f"""WITH {PX3}, k AS (SELECT DISTINCT slice_id, stack_id, z, radians((slice_id % 7) * 3{D}) AS az FROM px3), n AS (SELECT *, coalesce(lead(az) OVER (PARTITION BY stack_id ORDER BY z), az) AS nxt FROM k)
SELECT slice_id, {R('degrees(az + 0.35 * (nxt - az))', 'angle')}, {R('cos(az + 0.35 * (nxt - az)) * 2 - sin(az + 0.35 * (nxt - az))', 'wx')} FROM n""")
def temporal_rotation(spark, sf_dir):
    """A rotation between two neighbours in time: the earlier one, then a share of the turn from it to the later one."""
    images = sg.ranked(sg.blocks(spark, sf_dir)).select("slice_id", "stack_id", "z", ((F.col("slice_id") % 7) * 3.0).alias("rz"))
    later = F.coalesce(F.lead("rz").over(W.partitionBy("stack_id").orderBy("z")), F.col("rz"))
    rows = images.select("slice_id", "rz", later.alias("next"))
    axis = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    part = lambda name: [F.col(f"{name}{i}") for i in range(9)]
    named = lambda m, name: [c.alias(f"{name}{i}") for i, c in enumerate(m)]
    # Matrices are columns before they are read on; as one expression the work multiplies.
    rows = rows.select("slice_id", *[c.alias(n) for n, c in (("p", F.col("rz")), ("q", F.col("next")))])
    rows = rows.select("*", *[c.alias(f"{n}q{i}") for n in "pq" for i, c in enumerate(linear.quaternion(axis, F.col(n)))])
    rows = rows.select("slice_id", *named(linear.quaternion_matrix([F.col(f"pq{i}") for i in range(4)]), "a"), *named(linear.quaternion_matrix([F.col(f"qq{i}") for i in range(4)]), "b"))
    rows = rows.select("slice_id", *part("a"), *named(linear.product(linear.transposed(part("a")), part("b")), "r"))
    around, angle = linear.axis_angle(part("r"))
    rows = rows.select("slice_id", *part("a"), angle.alias("angle"), *[c.alias(n) for c, n in zip(around, ("kx", "ky", "kz"))])
    moved = linear.rotated([F.col(n) for n in ("kx", "ky", "kz")], 0.35 * F.col("angle"), [F.lit(2.0), F.lit(1.0), F.lit(0.0)])
    rows = rows.select("slice_id", *part("a"), *[c.alias(n) for c, n in zip(moved, ("x", "y", "z"))])
    wx, wy = (linear.dot(part("a")[3 * r : 3 * r + 3], [F.col(n) for n in "xyz"]) for r in (0, 1))
    return rounded(rows.select("slice_id", F.degrees(F.atan2(wy, wx) - F.atan2(F.lit(1.0), F.lit(2.0))).alias("angle"), wx.alias("wx")))


@query(f"""WITH {PX}, c AS (SELECT slice_id, sum(v * x) / sum(v) AS mx, sum(v * y) / sum(v) AS my, sum(v * x * x) / sum(v) AS xx, sum(v * y * y) / sum(v) AS yy, sum(v * x * y) / sum(v) AS xy FROM (SELECT slice_id, x, y, v::DOUBLE AS v FROM px) GROUP BY 1),
 d AS (SELECT slice_id, xx - mx * mx AS a, yy - my * my AS b, xy - mx * my AS c FROM c)
SELECT slice_id, {R('(a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c)', 'large')}, {R('(a + b) / 2 - sqrt((a - b) ** 2 / 4 + c * c)', 'small')} FROM d""")
def principal_axes(spark, sf_dir):
    """Eigenvalues, the largest first, of each slice's second moments."""
    v, x, y = _double("v"), F.col("x"), F.col("y")
    m = lambda e: F.sum(v * e) / F.sum(v)
    s = sg.px(spark, sf_dir).groupBy("slice_id").agg(m(x).alias("mx"), m(y).alias("my"), m(x * x).alias("xx"), m(y * y).alias("yy"), m(x * y).alias("xy"))
    cov = F.array(F.col("xx") - F.col("mx") ** 2, F.col("xy") - F.col("mx") * F.col("my"), F.col("yy") - F.col("my") ** 2)
    from gridloom.operators.kernels import eigenvalues

    found = eigenvalues(s.select("slice_id", cov.alias("m")))
    return rounded(found.select("slice_id", F.get("values", F.lit(0)).alias("large"), F.get("values", F.lit(1)).alias("small")))


@query(f"WITH s AS (SELECT p_partkey, (p_size / 10.0{D}) AS c FROM part), d AS (SELECT *, sqrt(c * c / 0.04{D} + 1000.0 / 27 * 10 / 10) AS q FROM s), e AS (SELECT p_partkey, c, sqrt((c / 0.2{D}) ** 2 + (10.0{D} / 3) ** 3) AS q FROM s) SELECT p_partkey, {R('cbrt(c / 0.2 + q) + cbrt(c / 0.2 - q)', 'root')} FROM e")
def newton_root(spark, sf_dir):
    """The root of x + x**3 / 10 = c, by Newton steps; the SQL has the closed form."""
    c = F.col("p_size") / F.lit(10.0)
    step = lambda x, _: x - (x + x * x * x / 10 - c) / (1 + 0.3 * x * x)
    return rounded(sg.table(spark, sf_dir, "part").select("p_partkey", F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(1.0), step).alias("root")))


# Points


POINTS = "pts AS (SELECT vec_id AS id, label AS stack_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"


def points(spark, sf_dir):
    at = lambda i, n: (F.get("embedding", F.lit(i)).cast("double") * 10).alias(n)
    return sg.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("stack_id"), at(0, "x"), at(1, "y"), at(2, "z"))


_stats = ", ".join(R(f"{f}({a})", n + a) for a in "xyz" for n, f in (("mean_", "avg"), ("low_", "min"), ("high_", "max"), ("sd_", "stddev_samp")))


@query(f"WITH {POINTS} SELECT stack_id, count(*) AS n, {_stats} FROM pts GROUP BY 1")
def point_set_summary(spark, sf_dir):
    return rounded(pt.summary(points(spark, sf_dir), ["stack_id"]))


@query(f"WITH {POINTS} SELECT stack_id, CAST(round(x / 2.0) AS INT) AS vx, CAST(round(y / 2.0) AS INT) AS vy, CAST(round(z / 2.0) AS INT) AS vz, count(*) AS n FROM pts GROUP BY ALL")
def point_set_image(spark, sf_dir):
    return pt.rasterised(points(spark, sf_dir), ["stack_id"], 2.0)


@query(f"WITH {POINTS}, r AS (SELECT id, round(x, 0) + 0.0 AS x, round(y, 0) + 0.0 AS y FROM pts), a AS (SELECT x, y FROM r WHERE id % 2 = 0), b AS (SELECT x, y FROM r WHERE id % 2 = 1) SELECT 'difference' AS op, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'union', * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def point_set_operations(spark, sf_dir):
    r = rounded(points(spark, sf_dir).select("id", "x", "y"), 0)
    a, b = (r.filter(F.col("id") % 2 == k).select("x", "y") for k in (0, 1))
    return a.exceptAll(b).select(F.lit("difference").alias("op"), "x", "y").unionByName(a.unionByName(b).select(F.lit("union").alias("op"), "x", "y"))


@query(f"WITH {POINTS}, d AS (SELECT p.stack_id, p.id AS qid, q.id, sqrt((p.x + 0.5 - q.x) ** 2 + (p.y - 0.25 - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM pts p JOIN pts q USING (stack_id)) SELECT stack_id, qid, {R('d', 'distance')}, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS k FROM d) WHERE k = 1")
def closest_point(spark, sf_dir):
    p = points(spark, sf_dir)
    asked = p.select("stack_id", F.col("id").alias("qid"), (F.col("x") + 0.5).alias("x"), (F.col("y") - 0.25).alias("y"), "z")
    return rounded(pt.closest(asked, p, ["stack_id"], 1.0))


POLYGON = [(-3.0, -3.0), (4.0, -2.0), (2.0, 0.5), (3.5, 3.0), (-1.0, 2.0), (-2.5, 4.0)]
_edges = "(VALUES " + ", ".join(f"({x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)" for (x0, y0), (x1, y1) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])) + ") e(x0, y0, x1, y1)"


@query(f"WITH {POINTS} SELECT id, count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 = 1 AS inside FROM pts, {_edges} GROUP BY 1")
def point_in_polygon(spark, sf_dir):
    return pt.inside(points(spark, sf_dir), POLYGON).select("id", "inside")


@query(f"WITH {POINTS} SELECT stack_id, {R('stack_id * 4.0', 'rz')}, {R('1.5::DOUBLE', 'tx')}, {R('-0.75::DOUBLE', 'ty')} FROM pts GROUP BY 1")
def point_alignment(spark, sf_dir):
    """The turn and shift that were put on each set are found again, here with weights."""
    t = F.radians(F.col("stack_id") * 4.0)
    x, y = F.col("x"), F.col("y")
    pairs = points(spark, sf_dir).select("stack_id", x.alias("px"), y.alias("py"), (F.cos(t) * x - F.sin(t) * y + 1.5).alias("qx"), (F.sin(t) * x + F.cos(t) * y - 0.75).alias("qy"), (1.0 + F.col("id") % 3).alias("w"))
    return rounded(pt.aligned(pairs, ["stack_id"], "w"))


@query(f"WITH {POINTS} SELECT stack_id, {R('cos(radians(stack_id * 4.0)) * 1.0', 'r0')}, {R('-sin(radians(stack_id * 4.0)) * 1.0', 'r1')}, 1.0::DOUBLE AS r8, 2.0::DOUBLE AS tz FROM pts GROUP BY 1")
def point_alignment_3d(spark, sf_dir):
    t = F.radians(F.col("stack_id") * 4.0)
    x, y = F.col("x"), F.col("y")
    pairs = points(spark, sf_dir).select("stack_id", x.alias("px"), y.alias("py"), F.col("z").alias("pz"), (F.cos(t) * x - F.sin(t) * y).alias("qx"), (F.sin(t) * x + F.cos(t) * y).alias("qy"), (F.col("z") + 2.0).alias("qz"))
    found = pt.aligned_3d(pairs, "stack_id")
    return rounded(found.select("stack_id", *[F.get("rotation", F.lit(i)).alias(f"r{i}") for i in (0, 1, 8)], F.get("shift", F.lit(2)).alias("tz")))


# Lattices, splits, masks


@query(f"""WITH {PX3} SELECT slice_id, stack_id, x - 2 AS x, y - 1 AS y, z - 1 AS z, v, {R('(x - 2 - 1.5) * 1.5 + (2 + 1.5 - 3.5) * 1.5 + 10', 'wx')}, {R('(y - 1 - 2.0) * 1.5 + (1 + 2.0 - 3.5) * 1.5 - 5', 'wy')} FROM px3 WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5 AND z BETWEEN 1 AND 3""")
def region_crop(spark, sf_dir):
    """A box of three axes; its origin is moved so that pixels keep their place in the world."""
    box = im.region(sg.px3(spark, sf_dir), x=(2, 6), y=(1, 6), z=(1, 4))
    ox, oy = coords.box_origin(10.0, 8, 1.5, 2, 6), coords.box_origin(-5.0, 8, 1.5, 1, 6)
    at = lambda a, o, n: ((F.col(a) - (n - 1) / 2) * 1.5 + o)
    return rounded(box.select("slice_id", "stack_id", "x", "y", "z", "v", at("x", ox, 4).alias("wx"), at("y", oy, 5).alias("wy")))


@query(f"WITH {PX3} SELECT slice_id, 'xy' AS axes, y AS x, x AS y, z, v FROM px3 UNION ALL SELECT slice_id, 'xz', z, y, x, v FROM px3 UNION ALL SELECT slice_id, 'yz', x, z, y, v FROM px3")
def flip_axes(spark, sf_dir):
    rows = sg.px3(spark, sf_dir)
    made = [im.flip(rows, a, b).select("slice_id", F.lit(a + b).alias("axes"), "x", "y", "z", "v") for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(f"WITH {PX} SELECT slice_id, x, y, v + 3 AS v_add, v - 3 AS v_sub, v * 3 AS v_mul, {R('v / 4.0', 'v_div')}, {R('v::DOUBLE', 'v_div0')} FROM px")
def scalar_arithmetic(spark, sf_dir):
    """Image and number; a division by 0 leaves the image."""
    v = F.col("v")
    a, b, c = im.with_number(v, 3), im.with_number(v, 4), im.with_number(v, 0)
    return rounded(sg.px(spark, sf_dir).select("slice_id", "x", "y", *[a[k].alias(k) for k in ("v_add", "v_sub", "v_mul")], b["v_div"].alias("v_div"), c["v_div"].alias("v_div0")))


@query(f"SELECT CAST(i % 16 AS INT) AS x, CAST(i // 16 % 16 AS INT) AS y, CAST(i // 256 AS INT) AS z, {R('sin((i % 16 - 7.5) * 0.5) * (i // 16 % 16 - 7.5) + (i // 256 - 3.5) ** 2', 'v')} FROM range(2048) t(i)")
def rasterised_function(spark, sf_dir):
    """A function of the world's coordinates on a lattice."""
    return rounded(im.rasterised(spark, (16, 16, 8), lambda x, y, z: F.sin(x * 0.5) * y + z * z))


@query(f"""WITH {PX}, p AS (SELECT *, y * 8 + x AS k, CASE WHEN v < 480 THEN -1 ELSE v END AS u FROM px), g AS (SELECT *, k - row_number() OVER (PARTITION BY slice_id, u < 0 ORDER BY k) AS run FROM p)
SELECT slice_id, x, y, CASE WHEN u < 0 THEN -count(*) OVER (PARTITION BY slice_id, u < 0, run ORDER BY k DESC) ELSE u END AS v FROM g""")
def padding_runs(spark, sf_dir):
    """Padding as minus the number of padding pixels up to the run's end."""
    images = sg.blocks(spark, sf_dir).select("slice_id", F.transform("pixels", lambda p: F.when(p < 480, -1).otherwise(p)).alias("pixels"))
    return sg.explode_pixels(images.select("slice_id", im.padding_runs("pixels").alias("pixels"))).select("slice_id", "x", "y", F.col("v").cast("long").alias("v"))


@query(f"WITH {PX3}, q AS (SELECT stack_id, x, y, z, v // 50 AS v, max(z) OVER (PARTITION BY stack_id) AS top FROM px3) SELECT stack_id, CASE WHEN min(v) = max(v) THEN min(v) END AS padding, count(*) AS corners FROM q WHERE x IN (0, 7) AND y IN (0, 7) AND z IN (0, top) GROUP BY 1")
def padding_guess_volume(spark, sf_dir):
    """The value of all eight corners, where they agree."""
    images = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir))).filter((F.col("z") == 0) | (F.col("z") == F.col("nz") - 1))
    rows = sg.explode_pixels(images).withColumn("v", F.floor(F.col("v") / 50).cast("int")).filter(F.col("x").isin(0, 7) & F.col("y").isin(0, 7))
    return rows.groupBy("stack_id").agg(F.when(F.min("v") == F.max("v"), F.min("v")).alias("padding"), F.count("*").alias("corners"))


@query(f"WITH {PX3}, o AS (SELECT stack_id, max(z) + 1 AS n FROM px3 GROUP BY 1) SELECT DISTINCT slice_id, stack_id, z, 5.0{D} AS dz, {R('(z - (n - 1) / 2.0) * 2.5', 'tz')}, row_number() OVER (ORDER BY stack_id, z) - 1 AS slice FROM (SELECT DISTINCT slice_id, stack_id, z FROM px3) JOIN o USING (stack_id)")
def slice_extraction(spark, sf_dir):
    """A row for each plane of all stacks: thickness in place of the spacing, its place, and a number over all stacks."""
    images = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))
    # Numbers come from the stacks' depths, a row a stack, so planes need no order over all.
    depths = images.select("stack_id", "nz").distinct()
    before = depths.alias("a").join(depths.alias("b"), F.col("b.stack_id") < F.col("a.stack_id"), "left").groupBy("a.stack_id").agg(F.coalesce(F.sum("b.nz"), F.lit(0)).alias("first"))
    rows = images.join(F.broadcast(before), "stack_id")
    return rounded(rows.select("slice_id", "stack_id", "z", F.lit(5.0).alias("dz"), ((F.col("z") - (F.col("nz") - 1) / 2) * 2.5).alias("tz"), (F.col("first") + F.col("z")).alias("slice")))


@query(f"""WITH RECURSIVE {PX3}, n AS (SELECT stack_id, max(z) + 1 AS n FROM px3 GROUP BY 1), h AS (SELECT stack_id, 0 AS lo, n AS hi, '' AS part FROM n UNION ALL
 SELECT stack_id, CASE WHEN s = 'a' THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN s = 'a' THEN lo + (hi - lo) // 2 ELSE hi END, part || s FROM h, (VALUES ('a'), ('b')) t(s) WHERE hi - lo >= 4)
SELECT DISTINCT slice_id, z, part FROM px3 JOIN h USING (stack_id) WHERE z >= lo AND z < hi AND hi - lo < 4""")
def half_split(spark, sf_dir):
    """Stacks cut in halves while a part has four slices or more."""
    images = sg.with_depth(sg.ranked(sg.blocks(spark, sf_dir)))
    return images.select("slice_id", "z", im.half_path(F.col("z"), F.col("nz")).alias("part"))


@query(f"WITH {PX3} SELECT DISTINCT slice_id, z, CAST(z % 3 AS INT) AS package, CAST((z % 3) * 2.0 - 2 AS DOUBLE) AS tx, CAST((z % 3) * 3.0 AS DOUBLE) AS rz, 7.5{D} AS dz FROM px3")
def package_propagation(spark, sf_dir):
    """Every slice of a package inherits the package's transformation; spacing grows by the packages."""
    z = F.col("z")
    slices = sg.ranked(sg.blocks(spark, sf_dir)).select("slice_id", "z", im.package(z, 3)[0].cast("int").alias("package"))
    moves = spark.createDataFrame([(k, k * 2.0 - 2, k * 3.0) for k in range(3)], "package int, tx double, rz double")  # three rows
    return slices.join(F.broadcast(moves), "package").select("slice_id", "z", "package", "tx", "rz", F.lit(2.5 * 3).alias("dz"))


# Metrics


@query(f"WITH {JOINT} SELECT slice_id, 'x' AS of, i AS bin, {R('sum(n * (j * 50 + 25.0)) / sum(n)', 'mean')} FROM jh GROUP BY slice_id, i UNION ALL SELECT slice_id, 'y', j, {R('sum(n * (i * 50 + 25.0)) / sum(n)', 'mean')} FROM jh GROUP BY slice_id, j")
def conditional_means_both(spark, sf_dir):
    h = pair_histogram(spark, sf_dir)
    mean = lambda of, by, other: h.groupBy("slice_id", F.col(by).alias("bin")).agg((F.sum(F.col("n") * hist.centre(F.col(other), 0.0, 1000.0, 20)) / F.sum("n")).alias("mean")).select("slice_id", F.lit(of).alias("of"), "bin", "mean")
    return rounded(mean("x", "i", "j").unionByName(mean("y", "j", "i")))


@query(f"WITH {PAIRS}, k AS (SELECT * FROM pairs WHERE NOT (x = 0 AND y < 4)) SELECT slice_id, greatest(0, least(19, CAST(round(20 * (a - 25.0) / 1000.0) AS INT))) AS i, greatest(0, least(19, CAST(round(20 * (b - 25.0) / 1000.0) AS INT))) AS j, count(*) AS n FROM k WHERE a BETWEEN 0 AND 1000 AND b BETWEEN 0 AND 1000 GROUP BY ALL")
def histogram_without_samples(spark, sf_dir):
    """Samples taken back from a joint histogram."""
    pairs = pair_pixels(spark, sf_dir)
    whole = hist.joint(pairs, ["slice_id"], "a", "b", 0.0, 1000.0, 20)
    out = hist.joint(pairs.filter("x = 0 AND y < 4"), ["slice_id"], "a", "b", 0.0, 1000.0, 20)
    return hist.without(whole, out, ["slice_id"])


@query(f"""WITH {PAIRS}, m AS (SELECT stack_id, a // 250 AS class, avg(b) AS mean, greatest(var_pop(b), 1.0) AS var FROM pairs GROUP BY 1, 2) SELECT slice_id, {R('-avg(0.5 * ln(2 * pi() * var) + (b - mean) ** 2 / (2 * var))', 'likelihood')} FROM pairs JOIN m ON m.stack_id = pairs.stack_id AND class = a // 250 GROUP BY 1""")
def maximum_likelihood(spark, sf_dir):
    """Mean log likelihood of values under the Gaussian of their target's class."""
    pairs = pair_pixels(spark, sf_dir).withColumn("class", F.floor(F.col("a") / 250))
    return rounded(hist.likelihood(pairs, "stack_id", "class", "b", ["slice_id"]))


@query(f"""WITH {PAIRS}, g AS (SELECT slice_id, coalesce(lead(a) OVER h - lag(a) OVER h, 0)::DOUBLE AS ax, coalesce(lead(a) OVER u - lag(a) OVER u, 0)::DOUBLE AS ay, coalesce(lead(b) OVER h - lag(b) OVER h, 0)::DOUBLE AS bx, coalesce(lead(b) OVER u - lag(b) OVER u, 0)::DOUBLE AS b_y FROM pairs
 WINDOW h AS (PARTITION BY slice_id, y ORDER BY x), u AS (PARTITION BY slice_id, x ORDER BY y)), n AS (SELECT slice_id, sqrt(ax * ax + ay * ay) AS la, sqrt(bx * bx + b_y * b_y) AS lb, ax * bx + ay * b_y AS d FROM g)
SELECT slice_id, {R('sum(CASE WHEN la > 0 AND lb > 0 THEN d / (la * lb) * la ELSE 0 END) / sum(la)', 'gradient_correlation')} FROM n GROUP BY 1""")
def gradient_correlation(spark, sf_dir):
    """Mean scalar product of unit gradients, by the target's gradient length."""
    from gridloom.operators import stencils

    pairs = pair_pixels(spark, sf_dir)
    a = stencils.gradients(pairs, ["slice_id"], value="a").select("slice_id", "x", "y", "b", F.col("gx").alias("ax"), F.col("gy").alias("ay"))
    return rounded(hist.gradient_correlation(stencils.gradients(a, ["slice_id"], value="b"), ["slice_id"], ("ax", "ay"), ("gx", "gy")))


@query(f"""WITH {PX}, r AS (SELECT slice_id, stack_id, x, y, v, CAST((x // 4) * 2 + y // 4 AS INT) AS region FROM px) SELECT p.stack_id, p.slice_id AS a, q.slice_id AS b, p.region, {R('corr(p.v, q.v)', 'ncc')} FROM r p JOIN r q ON p.stack_id = q.stack_id AND p.slice_id < q.slice_id AND p.x = q.x AND p.y = q.y WHERE p.slice_id % 10 = 0 AND q.slice_id % 10 <> 0 GROUP BY ALL""")
def similarity_by_region(spark, sf_dir):
    """Correlation of two sets of slices of a stack in each quarter of the plane."""
    images = sg.blocks(spark, sf_dir)
    quarter = [[y * 8 + x for y in range(8) for x in range(8) if x // 4 * 2 + y // 4 == k] for k in range(4)]
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), F.array(*[F.get("pixels", F.lit(i)) for i in at]).alias("pixels")) for k, at in enumerate(quarter)])).alias("p")
    cut = images.select("slice_id", "stack_id", parts).select("slice_id", "stack_id", "p.region", "p.pixels")
    return rounded(hist.pairs_of_blocks(cut.filter("slice_id % 10 = 0"), cut.filter("slice_id % 10 <> 0"), ["stack_id", "region"], lambda a, b: a < b).select("stack_id", "a", "b", "region", "ncc"))


# Scalars


@query(f"""SELECT p_partkey, {R('exp(-(s * s) / (2 * (1.2 * 1.25 / 2.3548) ** 2) - (s * s) / (2 * (1.2 * 1.25 / 2.3548) ** 2) - (s * s) / (2 * (2.5 / 2.3548) ** 2))', 'gaussian')} FROM (SELECT p_partkey, p_size / 50.0{D} AS s FROM part)""")
def psf_values(spark, sf_dir):
    s = F.col("p_size") / 50.0
    return rounded(sg.table(spark, sf_dir, "part").select("p_partkey", scalars.psf_gaussian(s, s, s, 1.25, 1.25, 2.5).alias("gaussian")))


@query("SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'unknown' WHEN 1 THEN 'char' WHEN 2 THEN 'unsigned char' WHEN 3 THEN 'short' WHEN 4 THEN 'unsigned short' WHEN 5 THEN 'int' WHEN 6 THEN 'unsigned int' WHEN 7 THEN 'float' ELSE 'double' END AS voxel, 'rigid' AS kind FROM part")
def type_names(spark, sf_dir):
    code = F.col("p_size") % 9
    return sg.table(spark, sf_dir, "part").select("p_partkey", scalars.voxel_type_name(code).alias("voxel"), scalars.transformation_name(F.lit(2)).alias("kind"))


@query(r"""SELECT p_partkey, p_size AS whole, round(p_retailprice, 2) + 0.0 AS number, regexp_extract(p_name, '\S+') AS word FROM part""")
def token_readers(spark, sf_dir):
    """The first tokens of a line with a comment: a whole number, a number and a word."""
    line = F.concat(F.lit("# sizes\n"), F.col("p_size"), F.lit("  "), F.format_string("%.2f", "p_retailprice"), F.lit(" "), F.col("p_name"), F.lit(" # end"))
    t = scalars.tokens(line)
    return sg.table(spark, sf_dir, "part").select("p_partkey", F.get(t, F.lit(0)).cast("int").alias("whole"), F.get(t, F.lit(1)).cast("double").alias("number"), F.get(t, F.lit(2)).alias("word"))

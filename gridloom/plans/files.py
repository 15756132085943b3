"""Queries of file formats: what is written comes back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import coords
from gridloom.operators import histograms as hist, robust
from gridloom.queries import POSE, SCALES, WEIGHTS, Chain, histogram1d, matrix
from gridloom.registry import PX, R, query, rounded
from gridloom.scratch import new_path
from gridloom.sources import codecs, image_folder, surrogate as sg

D = "::DOUBLE"


def images(spark, sf_dir, ending: str, kind: str = "i2"):
    """Slices as image rows under a file name."""
    axes = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    return sg.blocks(spark, sf_dir).select(
        F.concat(F.lit("s"), F.col("slice_id"), F.lit(ending)).alias("path"), *[F.lit(n).alias(c) for c, n in (("nx", 8), ("ny", 8), ("nz", 1), ("nt", 1))],
        *[F.lit(d).alias(c) for c, d in (("dx", 1.5), ("dy", 2.0), ("dz", 3.0), ("dt", 1.0))], F.array(F.lit(10.0), F.lit(-5.0), F.lit(2.0)).alias("origin"), axes.alias("axes"),
        F.lit(kind).alias("voxel_type"), F.col("pixels").cast("array<double>").alias("pixels"),
    )


def _back(spark, sf_dir, ending: str, kind: str = "i2"):
    made = codecs.decoded(codecs.dispatched(images(spark, sf_dir, ending, kind)))
    long = sg.explode_pixels(made.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("slice_id"), "dx", F.get("origin", F.lit(0)).alias("ox"), "pixels"))
    return rounded(long.select("slice_id", "x", "y", "v", "dx", "ox"))


def _as_pixels(dx: float = 1.5, ox: float = 10.0) -> str:
    return f"WITH {PX} SELECT slice_id, x, y, v::DOUBLE AS v, {dx}::DOUBLE AS dx, {ox}::DOUBLE AS ox FROM px"


@query(_as_pixels())
def nifti_files(spark, sf_dir):
    return _back(spark, sf_dir, ".nii.gz", "f4")


@query(_as_pixels())
def gipl_files(spark, sf_dir):
    return _back(spark, sf_dir, ".gipl")


@query(_as_pixels())
def vtk_files(spark, sf_dir):
    return _back(spark, sf_dir, ".vtk", "f8")


@query(_as_pixels(ox=0.0))
def analyze_files(spark, sf_dir):
    return _back(spark, sf_dir, ".hdr")


GREY = f"WITH {PX}, m AS (SELECT slice_id, min(v) AS a, max(v) AS b FROM px GROUP BY 1) SELECT slice_id, x, y, {R('round((v - a) * (255.0::DOUBLE / (b - a)))', 'v')}, 1.0::DOUBLE AS dx, 0.0::DOUBLE AS ox FROM px JOIN m USING (slice_id)"


@query(GREY)
def pgm_files(spark, sf_dir):
    return _back(spark, sf_dir, ".pgm")


@query(GREY)
def png_files(spark, sf_dir):
    return _back(spark, sf_dir, ".png")


@query(f"WITH {PX} SELECT slice_id, x, y, least(255, greatest(0, v - 300))::DOUBLE AS byte, v - 300.0::DOUBLE AS short FROM px")
def typed_pixels(spark, sf_dir):
    """Values as a type of one byte and one of two hold them."""
    rows = images(spark, sf_dir, "").withColumn("pixels", F.transform("pixels", lambda p: p - 300))
    both = codecs.typed(rows, "u1").select("path", F.col("pixels").alias("a")).join(codecs.typed(rows, "i2").select("path", F.col("pixels").alias("b")), "path")
    long = sg.explode_pixels(both.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("slice_id"), F.arrays_zip("a", "b").alias("pixels")))
    return long.select("slice_id", "x", "y", F.col("v.a").alias("byte"), F.col("v.b").alias("short"))


@query(f"WITH {PX} SELECT CAST(slice_id // 4 AS BIGINT) AS file, CAST(slice_id % 4 AS INT) AS t, x, y, v::DOUBLE AS v, 4.0::DOUBLE AS thickness FROM px WHERE slice_id // 4 < (SELECT count(*) // 4 FROM embeddings)")
def frames_of_files(spark, sf_dir):
    """Four slices a file as frames of time, split into stacks; a file's thickness holds for each."""
    rows = images(spark, sf_dir, "").withColumn("id", F.regexp_extract("path", r"\d+", 0).cast("long")).withColumn("file", F.floor(F.col("id") / 4))
    parts = F.array_sort(F.collect_list(F.struct("id", "pixels")))
    four = rows.groupBy("file").agg(parts.alias("p")).filter("size(p) = 4").select("file", F.flatten(F.transform("p", lambda s: s["pixels"])).alias("pixels"), *[F.lit(n).alias(c) for c, n in (("nx", 8), ("ny", 8), ("nz", 1), ("nt", 4))], F.lit(4.0).alias("thickness"))
    return sg.explode_pixels(codecs.frames_of(four).select("file", "t", "thickness", "pixels")).select("file", "t", "x", "y", "v", "thickness")


@query(f"WITH {POSE} SELECT slice_id, {R('m3', 'tx')}, {R('degrees(az)', 'rz')}, 98.0::DOUBLE AS sx, {R('degrees(ax)', 'rx_ascii')} FROM mat")
def transformation_files(spark, sf_dir):
    """Rigid, affine and ASCII files of each slice's parameters."""
    names = ("tx", "ty", "tz", "rx", "ry", "rz")
    p = sg.pose(F.col("slice_id"))
    rows = sg.blocks(spark, sf_dir).select("slice_id", *[p[n].alias(n) for n in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                rigid = codecs.read_dof(codecs.write_dof(r))
                affine = codecs.read_dof(codecs.write_affine_dof(r | {"sx": 98.0, "sy": 101.0, "sz": 100.0, "sxy": 1.0, "syz": 0.0, "sxz": 0.5}))
                text = codecs.read_ascii_dof("DOF: 6\n" + "\n".join(f"0.0 0.0 {r[n]!r}" for n in names))
                out.append((r["slice_id"], rigid["tx"], affine["rz"], affine["sx"], text["rx"]))
            yield pd.DataFrame(out, columns=["slice_id", "tx", "rz", "sx", "rx_ascii"])

    return rounded(rows.mapInPandas(run, "slice_id long, tx double, rz double, sx double, rx_ascii double"))


@query(f"WITH {PX}, h AS (SELECT stack_id, greatest(0, least(19, CAST(round(20 * (v - 25.0) / 1000.0) AS INT))) AS bin, count(*) AS n FROM px WHERE v BETWEEN 0 AND 1000 GROUP BY ALL) SELECT stack_id, bin, n::DOUBLE AS n FROM h")
def histogram_files(spark, sf_dir):
    h = histogram1d(spark, sf_dir).groupBy("stack_id").agg(F.collect_list(F.struct("bin", "n")).alias("h"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for stack, bins in zip(f["stack_id"], f["h"]):
                counts = np.zeros(20)
                for b in bins:
                    counts[b["bin"]] = b["n"]
                _, _, _, back = codecs.read_histogram(codecs.write_histogram(20, 0.0, 1000.0, counts))
                rows += [(stack, k, c) for k, c in enumerate(back) if c]
            yield pd.DataFrame(rows, columns=["stack_id", "bin", "n"])

    return h.mapInPandas(run, "stack_id int, bin int, n double")


@query(f"WITH {POSE} SELECT slice_id, {R('m1', 'm1')}, {R('m6', 'm6')}, {R('m3', 'px')} FROM mat")
def matrix_and_point_files(spark, sf_dir):
    rows = sg.blocks(spark, sf_dir).select("slice_id", F.array(*matrix()).alias("m"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, m in zip(f["slice_id"], f["m"]):
                m = np.asarray(m).reshape(3, 4)
                back = codecs.read_matrix(codecs.write_matrix(m)).ravel()
                out.append((i, back[1], back[6], codecs.read_points(codecs.write_points(m[:, [3, 3, 3]]))[0, 0]))
            yield pd.DataFrame(out, columns=["slice_id", "m1", "m6", "px"])

    return rounded(rows.mapInPandas(run, "slice_id long, m1 double, m6 double, px double"))


@query(f"WITH {POSE} SELECT slice_id, {R('m0 * 10 + m1 * -5 + m2 * 2 + m3 - 10 + 3.5', 'cx')}, {R('m3', 'tx')} FROM mat")
def transformation_folder(spark, sf_dir):
    """Files named by slice, written and scanned again; and the map from a slice's lattice to the volume's."""
    names = ("tx", "ty", "tz", "rx", "ry", "rz")
    p = sg.pose(F.col("slice_id"))
    rows = sg.blocks(spark, sf_dir).select("slice_id", *[p[n].alias(n) for n in names])
    path = new_path(spark, "dofs")
    codecs.write_transformations(rows, path)
    back = codecs.read_transformations(spark, path)
    lay = dict(n=(8, 8, 1), d=(1.0, 1.0, 1.0), origin=(10.0, -5.0, 2.0))
    whole = coords.compose(coords.world_to_image(**lay), coords.compose(coords.rigid(*[F.col(n) for n in names]), coords.image_to_world(**lay)))
    centre = coords.apply(whole, F.lit(3.5), F.lit(3.5), F.lit(0.0))
    return rounded(back.select("slice_id", centre[0].alias("cx"), "tx"))


REPORT = f"""WITH {SCALES}, rep AS (SELECT sw.stack_id, sw.slice_id, w_slice, scale, (SELECT max(simweight) FROM pix WHERE pix.slice_id = sw.slice_id) > 0.99::DOUBLE AS inside FROM sw JOIN sc USING (slice_id))
SELECT rep.stack_id, slice_id, CAST(inside AND w_slice >= 0.5 AS INT) AS included, CAST(inside AND w_slice < 0.5 AS INT) AS excluded, CAST(NOT inside AS INT) AS outside, round(w_slice, 4) + 0.0 AS weight, round(scale, 4) + 0.0 AS scale,
 round(m3, 4) + 0.0 AS tx, round(m7, 4) + 0.0 AS ty, round(m11, 4) + 0.0 AS tz, round(degrees(ax), 4) + 0.0 AS rx, round(degrees(ay), 4) + 0.0 AS ry, round(degrees(az), 4) + 0.0 AS rz FROM rep JOIN mat USING (slice_id)"""


@query(REPORT)
def slice_table(spark, sf_dir):
    """The report of slices as tab-separated lines, read again."""
    pixels = Chain(spark, sf_dir).weighted()
    inside = pixels.groupBy("slice_id").agg((F.max("simweight") > robust.SURE).alias("inside"))
    slices = robust.slice_weights(robust.potentials(pixels))[0].join(robust.slice_scales(pixels).drop("stack_id"), "slice_id").join(inside, "slice_id")
    p = sg.pose(F.col("slice_id"))
    kind = F.when(~F.col("inside"), "outside").when(F.col("w_slice") >= 0.5, "included").otherwise("excluded")
    rows = slices.select("stack_id", "slice_id", *[(kind == k).cast("int").alias(k) for k in ("included", "excluded", "outside")], F.col("w_slice").alias("weight"), "scale", *[p[n].alias(n) for n in ("tx", "ty", "tz", "rx", "ry", "rz")])
    path = new_path(spark, "report")
    rounded(rows, 4).write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.option("sep", "\t").option("header", True).schema(rows.schema).csv(path)


#: Ids that are broadcast, eight bytes each.
SENT = 4_000_000


@query(f"WITH {PX} SELECT p.stack_id, p.slice_id AS a, q.slice_id AS b, {R('corr(p.v, q.v)', 'ncc')} FROM px p JOIN px q ON p.stack_id = q.stack_id AND p.x = q.x AND p.y = q.y GROUP BY 1, 2, 3")
def similarity_matrix_file(spark, sf_dir):
    """The square matrix of every stack's correlations as comma-separated lines: a slice's values to a block of columns a line, and a line of each block's columns."""
    ids, lines = hist.matrix_lines(sg.blocks(spark, sf_dir), "stack_id")
    paths = [new_path(spark, n) for n in ("similarities", "similarity-columns")]
    # A flat slice's correlations are no numbers, and empty in the file.
    values = F.transform("ncc", lambda v: F.when(F.isnan(v), "").otherwise((F.round(v, 6) + 0.0).cast("string")))
    lines.select(F.concat_ws(",", "stack_id", "a", "block", F.array_join(values, ",")).alias("value")).write.option("compression", "gzip").text(paths[0])
    ids.select(F.concat_ws(",", "stack_id", "block", F.array_join("ids", ",")).alias("value")).write.text(paths[1])
    cells = F.split("value", ",")
    whole = lambda c, i: F.get(c, F.lit(i)).cast("long")
    rest = lambda c, n: F.slice(c, n + 1, F.size(c) - n)
    columns, rows = (spark.read.text(p).select(cells.alias("c")) for p in reversed(paths))
    columns = columns.select(whole("c", 0).cast("int").alias("stack_id"), whole("c", 1).alias("block"), rest("c", 2).cast("array<long>").alias("ids"))
    rows = rows.select(whole("c", 0).cast("int").alias("stack_id"), whole("c", 1).alias("a"), whole("c", 2).alias("block"), rest("c", 3).alias("ncc"))
    # The columns are a number a slice: a shuffle of the lines, which grow with its square, only where they are too many.
    few = (columns.agg(F.sum(F.size("ids"))).first()[0] or 0) <= SENT
    met = rows.join(F.broadcast(columns) if few else columns, ["stack_id", "block"]).select("stack_id", "a", F.explode(F.arrays_zip("ids", "ncc")).alias("e"))
    return met.select("stack_id", "a", F.col("e.ids").alias("b"), F.expr("try_cast(e.ncc AS double)").alias("ncc"))


@query(f"WITH {PX} SELECT slice_id AS file, CAST(floor(count(*) FILTER (v > 500 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) * 1.5::DOUBLE * 2.0 * 30.0 / 1000) AS BIGINT) AS ml FROM px GROUP BY 1")
def volume_of_files(spark, sf_dir):
    """Whole millilitres of set voxels without the border."""
    rows = images(spark, sf_dir, ".nii").withColumn("pixels", F.transform("pixels", lambda p: F.when(p > 500, 1.0).otherwise(0.0))).withColumn("dz", F.lit(30.0)).withColumn("voxel_type", F.lit("u1"))
    back = codecs.decoded(codecs.dispatched(rows))
    return codecs.millilitres(back, border=1).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("file"), "ml")


@query("SELECT p_partkey, 'No. of bins' AS key, CAST(p_size AS VARCHAR) AS value FROM part")
def parameter_files(spark, sf_dir):
    from gridloom.functions.scalars import parameter_line

    line = F.concat(F.lit("No. of bins    = "), F.col("p_size"), F.lit("  # of the joint histogram"))
    key, value = parameter_line(line)
    return sg.table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), value.alias("value"))


# Folders of slices


def _folder(spark, rows, name: str):
    """rows (slice_id, pixels) as files of a folder, and the folder read again: slice_id, x, y, v."""
    image_folder.register(spark)
    axes = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    path = new_path(spark, name)
    files = rows.select(
        F.concat(F.lit(name), F.col("slice_id"), F.lit(".nii.gz")).alias("path"), *[F.lit(n).alias(c) for c, n in (("nx", 8), ("ny", 8), ("nz", 1), ("nt", 1))],
        *[F.lit(d).alias(c) for c, d in (("dx", 1.0), ("dy", 1.0), ("dz", 4.0), ("dt", 1.0))], F.array(*[F.lit(0.0)] * 3).alias("origin"), axes.alias("axes"), F.lit("f8").alias("voxel_type"), F.col("pixels").cast("array<double>").alias("pixels"),
    )
    files.write.format("image_folder").mode("append").save(path)
    back = spark.read.format("image_folder").load(path)
    return back.select(F.regexp_extract("path", r"(\d+)\.nii", 1).cast("long").alias("slice_id"), "dz", "pixels")


@query(f"WITH {PX} SELECT slice_id, x, y, v{D} AS v, 0 AS stack_id, 4.0{D} AS thickness, 0.0{D} AS tx, 0.0{D} AS rz FROM px")
def replace_slices(spark, sf_dir):
    """Slices saved to a folder, and a folder's files taken as slices: stack 0, thickness as written, no transformation yet."""
    back = _folder(spark, sg.blocks(spark, sf_dir), "slice").withColumnsRenamed({"dz": "thickness"})
    rows = sg.explode_pixels(back.withColumn("stack_id", F.lit(0)).withColumn("tx", F.lit(0.0)).withColumn("rz", F.lit(0.0)))
    return rows.select("slice_id", "x", "y", "v", "stack_id", "thickness", "tx", "rz")


@query(f"WITH {WEIGHTS} SELECT slice_id, x, y, {R('w', 'w')} FROM ws")
def saved_weights(spark, sf_dir):
    """Pixels' posterior weights, a file a slice, read again; a place without a pixel is -1 in its file."""
    w = Chain(spark, sf_dir).weighted()
    at = (F.col("y") * sg.SIDE + F.col("x")).alias("at")
    maps = w.groupBy("slice_id").agg(F.map_from_entries(F.collect_list(F.struct(at, "w"))).alias("m"))
    rows = maps.select("slice_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1.0))).alias("pixels"))
    return rounded(sg.explode_pixels(_folder(spark, rows, "weights"), value="w").filter("w <> -1").select("slice_id", "x", "y", "w"))

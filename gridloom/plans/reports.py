"""Logs of evaluations by iteration, and files of histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import patches
from gridloom.plans.registration import C1, C2, D, PAIRS, pair_pixels
from gridloom.queries import BINS, HIGH, HIST1, JOINT, LOW, histogram1d, pair_histogram
from gridloom.registry import R, query, rounded
from gridloom.scratch import new_path
from gridloom.sources import reports, surrogate as sg

#: Iterations, patch sizes and strides that are evaluated.
RUNS = patches.schedule(6, 2, 2)
METRICS = ("psnr", "ssim", "dssim", "mean_a", "mean_b", "variance_a", "variance_b", "covariance", "mse")


def _run(k: int, size: int, stride: int) -> str:
    n = -(-(8 - size) // stride)
    return f"SELECT {k} AS iteration, {size} AS size, {stride} AS stride, slice_id, stack_id, a, b, i * {stride} AS px0, j * {stride} AS py0 FROM pairs, range({n}) t(i), range({n}) u(j) WHERE x BETWEEN i * {stride} AND i * {stride} + {size - 1} AND y BETWEEN j * {stride} AND j * {stride} + {size - 1}"


@query(f"""WITH {PAIRS}, q AS ({' UNION ALL '.join(_run(*r) for r in RUNS)}), s AS (SELECT iteration, size, stride, slice_id, px0, py0, count(*) AS n, max(a) AS m, avg((a - b) ** 2) AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov FROM q GROUP BY ALL),
t AS (SELECT *, (2 * ma * mb + {C1}{D}) * (2 * cov + {C2}{D}) / ((ma * ma + mb * mb + {C1}{D}) * (va + vb + {C2}{D})) AS ssim FROM s)
SELECT iteration, size, stride, slice_id, px0::INT AS px0, py0::INT AS py0, n, {R('CASE WHEN mse > 0 THEN 20 * log10(m) - 10 * log10(mse) END', 'psnr')}, {R('ssim', 'ssim')}, {R('(1 - ssim) / 2', 'dssim')}, {R('ma', 'mean_a')}, {R('mb', 'mean_b')}, {R('va', 'variance_a')}, {R('vb', 'variance_b')}, {R('cov', 'covariance')}, {R('mse', 'mse')} FROM t""")
def evaluation_log(spark, sf_dir):
    """Patches of each slice against those of the stack's first, logged an iteration at a time with patches that shrink; the last iteration is logged twice, as by a run that was begun again."""
    path = new_path(spark, "evaluations")
    for k, size, stride in [*RUNS, RUNS[-1]]:
        rows = patches.evaluated(patches.extracted(pair_pixels(spark, sf_dir), 8, 8, size, stride), ["slice_id", "px0", "py0"])
        reports.logged(rows.select("slice_id", "px0", "py0", "n", *METRICS), path, iteration=k, size=size, stride=stride)
    back = reports.read_log(spark, path, f"slice_id long, px0 int, py0 int, n long, {', '.join(f'{m} double' for m in METRICS)}, iteration int, size int, stride int")
    return rounded(back.select("iteration", "size", "stride", "slice_id", "px0", "py0", "n", *METRICS))


@query(f"WITH {JOINT} SELECT label AS stack_id, i, j, sum(n)::DOUBLE AS n, i * 50 + 25.0{D} AS x, j * 50 + 25.0{D} AS y FROM jh JOIN (SELECT vec_id AS slice_id, label FROM embeddings) USING (slice_id) GROUP BY 1, 2, 3")
def joint_histogram_files(spark, sf_dir):
    """The joint histogram of each stack as a file with header and rows of bins, read again with the centres of its bins."""
    of = sg.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slice_id"), F.col("label").alias("stack_id"))
    axes = [(c, BINS, float(LOW), float(HIGH)) for c in ("i", "j")]
    path = new_path(spark, "joint")
    reports.save_texts(reports.histogram_text(pair_histogram(spark, sf_dir).join(of, "slice_id"), "stack_id", axes, "histogram_2d"), path, "stack_id")
    return reports.histogram_cells(reports.read_texts(spark, path), 2, "histogram_2d").withColumn("stack_id", F.col("stack_id").cast("int"))


@query(f"WITH {HIST1} SELECT stack_id, bin AS i, {R('n / sum(n) OVER (PARTITION BY stack_id)', 'n')}, bin * 50 + 25.0{D} AS x FROM h")
def density_files(spark, sf_dir):
    """Shares of bins in each stack as a file, a line a bin, read again."""
    h = histogram1d(spark, sf_dir)
    share = h.join(h.groupBy("stack_id").agg(F.sum("n").alias("whole")), "stack_id").select("stack_id", F.col("bin").alias("i"), (F.col("n") / F.col("whole")).alias("w"))
    path = new_path(spark, "density")
    reports.save_texts(reports.histogram_text(share, "stack_id", [("i", BINS, float(LOW), float(HIGH))], "density", "w"), path, "stack_id")
    return rounded(reports.histogram_cells(reports.read_texts(spark, path), 1, "density").withColumn("stack_id", F.col("stack_id").cast("int")))

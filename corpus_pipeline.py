"""A corpus pipeline: toxic documents go, repeated line runs go, one of each near-duplicate class stays, benchmark leaks go, the rest is encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, of the columns of documents for all but the last stage.
run() writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import bpe, decontam, jaccard, line_dedup, toxicity
from gridloom.llm.common import Scratch

TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under TOXIC."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(docs, labels).filter(F.col("score") < TOXIC).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that lost its last word goes."""
    left = line_dedup.deduplicated(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_filled")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies."""
    return jaccard.representatives(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the digest of the decoded text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep_text=False, decoded=True)
    return coded.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express the trained stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs

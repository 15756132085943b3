"""Two-pass external shuffle into shards, in DataFrame operations alone.

Pass one scatters records uniformly into buckets of a shard by a seeded hash;
the number of buckets follows from the bytes and rows, so a bucket fits in
memory at any size of the corpus. Pass two lays each bucket's records in order
of doc_id and text, shuffles them by Fisher-Yates, whose draws are hashes of
seed, shard, bucket and step, and writes them. So the order hangs on seed and
records alone, not on partitions or on tasks that run again. A record's slot is
its place in its shard: the buckets before it, then its place in its bucket.

Shards follow the law `key`: of the shards, that whose hash with the doc_id is
highest takes the record (rendezvous hashing), so one more shard takes records
only into itself. Null doc_ids hash as a value of their own. Repeated doc_ids
meet in one shard, and in different buckets where their texts differ; where a
doc_id stands oftener than half a bucket's rows, its equal rows are numbered
and those beyond a bucket's rows dealt over further buckets, which moves no other row. Null texts weigh 1 byte and have the checksum
of an empty text. An empty table gives an empty result. Further columns, of
types that can be ordered, are written along; the names shard, slot, size,
text_crc32, grown_shard and law are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Bytes of text and rows in a bucket, about, and bytes to a task.
BUCKET_BYTES, BUCKET_ROWS, TASK_BYTES = 4 << 20, 512, 64 << 20
OWN = ("shard", "slot", "size", "text_crc32", "grown_shard", "law")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Of shards 0 to shards - 1, that with the highest hash."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def fisher_yates(n: Column, seed: int, *of: str) -> Column:
    """0 to n - 1 in shuffled order: each number enters at a drawn place among those before it, whose holder moves to the end."""

    def enter(a: Column, i: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), *of, i), i + 1).cast("int")
        swapped = lambda j: F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.get(a, j)))
        return F.get(F.transform(F.array(at), lambda j: F.when(j == i, F.concat(a, F.array(i))).otherwise(swapped(j))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), enter)


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 17, text: str = "text", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """shard, place (bucket and place in it), size, text_crc32, grown_shard and record, a struct of the columns of docs, in shuffled order."""
    keep = [c for c in docs.columns if c.lower() not in OWN]
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    sizes = docs.groupBy("doc_id").agg(F.sum(size).alias("b"), F.count("*").alias("n")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    total, n, most = sizes["b"] or 0, sizes["n"] or 0, sizes["most"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)), -(-n // (shards * bucket_rows)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    copy = F.lit(0).cast("long")
    if 2 * most > bucket_rows:
        copy = F.floor((F.row_number().over(W.partitionBy("doc_id", F.xxhash64(body)).orderBy("doc_id")) - 1) / bucket_rows).cast("long")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.struct(*[F.col(c) for c in keep]).alias("record"),
        size.alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(key, shards, seed).alias("shard"),
        shard_of(key, shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), key, body, copy), F.lit(buckets)).cast("int").alias("bucket"),
    )
    # Tasks follow the bytes; each holds many buckets, so tasks are even.
    dealt = rows.repartition(max(1, -(-total // TASK_BYTES)), "shard", "bucket")
    ordered = F.array_sort(F.collect_list(F.struct("id", "text_crc32", "size", "grown_shard", "record"))).alias("rows")
    packed = dealt.groupBy("shard", "bucket").agg(ordered)
    order = fisher_yates(F.size("rows"), seed, "shard", "bucket")
    mixed = packed.select("shard", "bucket", F.posexplode(F.transform(order, lambda k: F.get("rows", k))).alias("at", "r"))
    return mixed.select("shard", F.struct("bucket", "at").alias("place"), "r.size", "r.text_crc32", "r.grown_shard", "r.record")


def write(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, text: str = "text", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write the shuffled records by shard below path/records, and their schema below path/schema; a file holds whole buckets."""
    made = shuffled(docs, shards, seed, text, bucket_bytes, bucket_rows)
    docs.sparkSession.createDataFrame([], made.schema).write.parquet(f"{path}/schema")
    made.write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written records: the columns of docs, size, text_crc32, shard, slot and grown_shard."""
    records = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/records")
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = records.groupBy("shard", F.col("place.bucket").alias("bucket")).agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).alias("o")
    met = records.alias("r").join(offsets, (F.col("r.shard") == F.col("o.shard")) & (F.col("r.place.bucket") == F.col("o.bucket")))
    slot = (F.col("o.before") + F.col("r.place.at")).cast("long").alias("slot")
    return met.select("r.record.*", "r.size", "r.text_crc32", "r.shard", slot, "r.grown_shard")

"""The queries of the text operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontam, fim, jaccard, langid, line_dedup, pii, quality, resample, shards, token_files, toxicity, warc
from .common import new_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False, decoded=True))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    uri = new_path(spark, "tokens")
    files = token_files.write(docs, uri, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.digests(token_files.read(spark, uri, files))


def op8_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    shards.write(documents(spark, sf_dir).select("doc_id", "text"), path, shards=8)
    return shards.read(spark, path).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.digests(warc.read(spark, path))


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.found(documents(spark, sf_dir).select("doc_id", "text")))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text")).drop("n_filled")


def op6_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(documents(spark, sf_dir).select("doc_id", "text"), words=4, percent=85)


def op11_checkpoint_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transformed(documents(spark, sf_dir), keep=["doc_id"]))


def op12_ngram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judged(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resampled(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), of_long=True)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS p
           FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS t FROM documents)),
     i AS (SELECT item_id, len(t) AS n, unnest(t) AS tok, generate_subscripts(t, 1) AS p
           FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark)),
     s AS (SELECT *, least(16, n) AS w, least(16, n) - least(16, n) // 5 AS need FROM i),
     e AS (SELECT doc_id, item_id, w, need, d.p - s.p AS diag, s.p AS p FROM d JOIN s USING (tok)),
     f AS (SELECT doc_id, item_id, need, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p RANGE BETWEEN 15 PRECEDING AND CURRENT ROW) AS c15,
                  count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p) AS c_all, w FROM e),
     g AS (SELECT DISTINCT doc_id, item_id FROM f WHERE CASE WHEN w = 16 THEN c15 ELSE c_all END >= need)
SELECT documents.doc_id, count(item_id) > 0 AS contaminated, count(item_id)::BIGINT AS n_items,
       coalesce(list(item_id ORDER BY item_id) FILTER (WHERE item_id IS NOT NULL), []) AS item_ids
FROM documents LEFT JOIN g USING (doc_id) GROUP BY documents.doc_id
"""

OP5_SQL = r"""
WITH l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
     b AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS at,
                  length(t) - length(replace(t, ' ', '')) + 1 AS w
           FROM (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l) WHERE t <> ''),
     r AS (SELECT x.doc_id, x.at AS s, y.at AS e, list(z.line ORDER BY z.at) AS lines, sum(z.w) AS total, min(x.w) AS head, min(y.w) AS tail
           FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.at BETWEEN x.at AND x.at + 4 JOIN b z ON z.doc_id = x.doc_id AND z.at BETWEEN x.at AND y.at
           GROUP BY ALL),
     m AS (SELECT * FROM r WHERE total >= 5 AND (total - head < 5 OR total - tail < 5)),
     k AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY lines ORDER BY doc_id, s) AS copy FROM m),
     g AS (SELECT DISTINCT b.doc_id, b.pos FROM k JOIN b ON b.doc_id = k.doc_id AND b.at BETWEEN k.s AND k.e WHERE copy > 1),
     t AS (SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
                  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
           FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT doc_id, text, n_lines, n_removed FROM t
"""

OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
     k AS (SELECT page_id, url, html, encode(html) AS b, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS holder, row_number() OVER (PARTITION BY page_id, html ORDER BY url) AS copy FROM p),
     f AS (SELECT *, octet_length(b)::BIGINT AS payload_bytes, page_id <> holder AS revisit,
       translate(lpad(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || substr(h, 11, 10))::BIGINT, 32), 8, '0')
              || lpad(to_base(('0x' || substr(h, 21, 10))::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || substr(h, 31, 10))::BIGINT, 32), 8, '0'),
              '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || payload_bytes || chr(13) || chr(10) || chr(13) || chr(10) AS http FROM k),
     r AS (SELECT *, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || CASE WHEN revisit THEN 'revisit' ELSE 'response' END,
       'WARC-Record-ID: <urn:page:' || page_id || ':' || payload_digest || CASE WHEN copy > 1 THEN ':' || copy ELSE '' END || '>', 'WARC-Date: 1970-01-01T00:00:00Z',
       'WARC-Target-URI: ' || replace(url, ' ', '%20'), 'WARC-Payload-Digest: sha1:' || payload_digest,
       CASE WHEN revisit THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
       CASE WHEN revisit THEN 'WARC-Refers-To: <urn:page:' || holder || ':' || payload_digest || '>' END, 'Content-Type: application/http; msgtype=response',
       'Content-Length: ' || (length(http) + CASE WHEN revisit THEN 0 ELSE payload_bytes END)) || chr(13) || chr(10) || chr(13) || chr(10) || http
       || CASE WHEN revisit THEN '' ELSE html END || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN holder END AS refers_to,
       octet_length(encode(record))::BIGINT AS record_bytes, sha256(record) AS record_sha256
FROM r
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
     c AS (SELECT *, array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s FROM u)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

# The checksum of a word by its bytes: a table of 256 entries, each eight steps of the polynomial, then a step a byte.
OP13_SQL = r"""
WITH k AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
     w AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
           UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
     x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM w)),
     c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + len(h), 2), lambda j: ('0x' || substr(h, j, 2))::BIGINT)),
             lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket FROM x, k),
     n AS (SELECT side, id, bucket, count(*) AS n FROM w JOIN c USING (f) GROUP BY ALL),
     g AS (SELECT r.b AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM range(10000) r(b) LEFT JOIN n ON n.bucket = r.b GROUP BY 1),
     y AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM g),
     z AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN y USING (bucket) WHERE side = 'd' GROUP BY 1),
     v AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN z ON z.id = doc_id),
     o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS total FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * total // 100 THEN r END AS rank FROM o
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_string_kernel_toxicity": op1_string_kernel_toxicity,
        "op2_content_addressed_warc": op2_content_addressed_warc,
        "op3_bootstrapped_pii": op3_bootstrapped_pii,
        "op4_spaced_seeds": op4_spaced_seeds,
        "op5_line_suffix_array": op5_line_suffix_array,
        "op6_count_vector_join": op6_count_vector_join,
        "op7_quality_rules": op7_quality_rules,
        "op8_two_pass_shuffle": op8_two_pass_shuffle,
        "op9_token_files": op9_token_files,
        "op10_bpe_word_table": op10_bpe_word_table,
        "op11_checkpoint_fim": op11_checkpoint_fim,
        "op12_ngram_language": op12_ngram_language,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_content_addressed_warc": OP2_SQL, "op4_spaced_seeds": OP4_SQL, "op5_line_suffix_array": OP5_SQL, "op11_checkpoint_fim": OP11_SQL, "op13_importance_resampling": OP13_SQL}

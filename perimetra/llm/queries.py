"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.llm import ann, exact_dedup, hard_negatives, media, mixing, ngram_join, piece_codec, quality, secrets, sharding, token_counts, warc, whitening
from perimetra.llm.common import shared_dir, table


def op1_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the records that `pages` make against a replica with planted damage, which the hash of a url decides: some
    records are lost, some have another first character, some come twice. One row per record of either replica."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 2)
    lost, changed, doubled = fate == "00", fate == "01", fate == "02"
    damaged = pages.filter(~lost).withColumn("html", F.when(changed, F.concat(F.lit("#"), F.substring("html", 2, 2147483647))).otherwise(F.col("html")))
    replica = damaged.unionByName(pages.filter(doubled))
    files = max(1, -(-pages.count() // warc.FILE_RECORDS))
    found = warc.audit(warc.leaves(pages, files), warc.leaves(replica, files))
    return found.select(F.col("record_id").alias("page_id"), "file", "offset", "length", "digest", "status", "other_digest")


OP1_SQL = """
WITH files AS (SELECT greatest(1, CAST(ceil(count(*) / 256.0) AS BIGINT)) AS n FROM pages),
fates AS (SELECT page_id, url, html, substr(sha256(coalesce(url, '')), 1, 2) AS fate FROM pages),
damaged AS (
  SELECT page_id, url, CASE WHEN fate = '01' THEN '#' || substr(html, 2) ELSE html END AS html FROM fates WHERE fate <> '00'
  UNION ALL SELECT page_id, url, html FROM fates WHERE fate = '02'),
both_replicas AS (SELECT 'a' AS side, page_id, url, html FROM pages UNION ALL SELECT 'b', page_id, url, html FROM damaged),
raw AS (
  SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM both_replicas),
leaf AS (SELECT side, page_id, CAST(page_id % (SELECT n FROM files) AS INTEGER) AS file, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM raw),
placed AS (
  SELECT side, page_id, file, length, digest,
    CAST(coalesce(sum(length) OVER (PARTITION BY side, file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off,
    row_number() OVER (PARTITION BY side, file ORDER BY page_id, digest) AS place FROM leaf),
counted AS (SELECT *, row_number() OVER (PARTITION BY side, file, page_id ORDER BY place) AS copy FROM placed),
a AS (SELECT * FROM counted WHERE side = 'a'), b AS (SELECT * FROM counted WHERE side = 'b')
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, coalesce(a.off, b.off) AS "offset", coalesce(a.length, b.length) AS length, coalesce(a.digest, b.digest) AS digest,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'corrupt' WHEN a.off <> b.off OR a.place <> b.place THEN 'moved' ELSE 'same' END AS status,
  b.digest AS other_digest
FROM a FULL JOIN b ON a.file = b.file AND a.page_id = b.page_id AND a.copy = b.copy
"""


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.fit_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rates.select("doc_id", "n_tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)), "rate", "miss")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip_documents(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.sharded_with_next(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/perimetra/slot-maps-{uuid.uuid4().hex}", 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version", "next_shard")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH fine AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS y
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_sum(list_transform(list_zip(a.y, r.y), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM fine a JOIN fine r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by the checksum of doc_id, came first and make the history; the others are the new delivery."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


OP13_SQL = """
WITH rows_of AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best = 1 AS kept, text_sha256
FROM rows_of WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_warc_fixity_audit, op2_nearest_neighbours, op3_ngram_jaccard_join, op4_source_mixing, op5_quality_classifier, op6_sentencepiece_codec, op7_media_columns, op8_virtual_slot_shards, op9_token_counts, op10_secret_scan, op11_embedding_whitening, op12_hard_negatives, op13_exact_dedup, pipeline)
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity_audit": OP1_SQL, "op12_hard_negatives": OP12_SQL, "op13_exact_dedup": OP13_SQL}

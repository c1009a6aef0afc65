"""Queries of the vector search and near-duplicate family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import search
from perimetra.plans.bind import settled, table
from perimetra.plans.registry import query


def _keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty keyframes a clip, about."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("keyframe_id"), F.floor(F.col("vec_id") / 20).alias("clip_id"), "embedding", "label")


def _probe(keyframes: DataFrame, keyframe_id: int) -> F.Column:
    vector = keyframes.filter(F.col("keyframe_id") == keyframe_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in vector[0]])


_SCORES = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS keyframe_id, CAST(floor(vec_id / 20.0) AS BIGINT) AS clip_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q)"


@query(f"WITH {_SCORES}, best AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, keyframe_id) AS rn FROM s) SELECT clip_id, keyframe_id, round(score, 6) AS score FROM best WHERE rn = 1 ORDER BY score DESC, keyframe_id LIMIT 6")
def cosine_topk_per_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best clips for the vector of keyframe 0."""
    k = _keyframes(spark, sf_dir)
    return search.search(k, _probe(k, 0), 6).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 5), s AS (SELECT query_id, vec_id AS keyframe_id, CAST(floor(vec_id / 20.0) AS BIGINT) AS clip_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, clip_id ORDER BY score DESC, keyframe_id) AS rn FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyframe_id) AS rank FROM best WHERE rn = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, clip_id, keyframe_id, round(score, 6) AS score FROM r WHERE rank <= 6""")
def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for five stated queries at once."""
    k = _keyframes(spark, sf_dir)
    asked = k.filter("keyframe_id < 5").select(F.col("keyframe_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search.search_batch(k, asked, 6).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORES} SELECT keyframe_id, CAST(round_even(100.0 / (1.0 + exp(-(score * 10.0 - 2.0))), 0) AS INTEGER) AS percent FROM s")
def search_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyframes(spark, sf_dir)
    return k.select("keyframe_id", search.percent(search.dot(F.col("embedding"), _probe(k, 0)), 10.0, -2.0).alias("percent"))


@query("SELECT vec_id AS keyframe_id, round(sqrt(list_dot_product(list_transform(embedding::DOUBLE[], lambda x: x / 2.0), embedding::DOUBLE[]) * 2.0), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = search.checked(_keyframes(spark, sf_dir), 64)
    v, u = F.col("embedding"), search.normalised(F.col("embedding").cast("array<double>"))
    return k.select("keyframe_id", F.round(F.sqrt(search.dot(v, v)), 6).alias("norm"), F.round(search.dot(u, u), 6).alias("unit"))


@query("SELECT vec_id AS keyframe_id, CAST(floor(vec_id / 20.0) AS BIGINT) AS clip_id FROM embeddings")
def index_add_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding overlapping batches gives every keyframe once."""
    k = _keyframes(spark, sf_dir).select("keyframe_id", "clip_id")
    half = k.filter("keyframe_id % 2 = 0")
    return search.add_keyframes(search.add_keyframes(half, k), half)


@query("SELECT date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS days, CAST((date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1) // 7 AS VARCHAR) || ' weeks' AS label FROM events")
def search_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 3, F.lit("not a time")).otherwise(F.col("ts").cast("string")).alias("at"))
    return search.window_scanned(rows, "at").select(F.col("days").cast("long").alias("days"), "label")


@query("""WITH n AS (SELECT clip_id, count(*) AS frames FROM (SELECT CAST(floor(vec_id / 20.0) AS BIGINT) AS clip_id FROM embeddings) GROUP BY clip_id), i AS (SELECT clip_id, frames, least(5, frames) AS k, unnest(range(least(5, frames))) AS i FROM n)
SELECT clip_id, CAST(CASE WHEN k > 1 THEN floor(i * (frames - 1) / (k - 1)::DOUBLE) ELSE 0 END AS INTEGER) AS position FROM i""")
def even_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _keyframes(spark, sf_dir).groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))
    return n.select("clip_id", F.explode(search.even_positions(F.col("frames").cast("int"), 5)).alias("position"))


@query("""SELECT event_id, array_to_string(list_filter([event_type, CASE WHEN value > 100 THEN 'IR' END, CASE WHEN user_id % 2 = 0 THEN 'fence crossed' END, CASE WHEN user_id % 5 = 0 THEN 'BA' || CAST(user_id AS VARCHAR) END], lambda x: x IS NOT NULL), ' · ') AS chips FROM events""")
def keyframe_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rules = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("fence crossed")))
    plate = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("BA"), F.col("user_id").cast("string")))
    return e.select("event_id", F.array_join(search.chips(F.col("event_type"), F.col("value") > 100, rules, plate), " · ").alias("chips"))


def whole_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simhashes of whole texts, computed once a row."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("sequence"), F.col("lang").alias("modality"), "text")
    return rows.withColumn("hash", search.simhashes(F.col("text"))).drop("text")


#: A 64-bit simhash of a text's shingles of three words, each counted as often as it comes.
_WHOLE_SQL = """x AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN text ELSE array_to_string(list_slice(ws, i + 1, i + 3), ' ') END AS part FROM (SELECT *, unnest(range(greatest(1, len(ws) - 2))) AS i FROM x)),
hs AS (SELECT doc_id, ('0x' || substr(sha256(part), 1, 16))::UBIGINT AS v FROM sh), vs AS (SELECT doc_id, b, 2 * sum((v >> b::UBIGINT) & 1::UBIGINT) > count(*) AS one FROM hs, range(64) r(b) GROUP BY 1, 2),
whole AS (SELECT doc_id, sum(CASE WHEN one AND b < 63 THEN 1::BIGINT << b WHEN one THEN -9223372036854775808 ELSE 0 END)::BIGINT AS hash FROM vs GROUP BY 1),
h AS (SELECT doc_id AS seq, source AS sequence, lang AS modality, hash FROM documents JOIN whole USING (doc_id)), """

_PAIRED_SQL = "d AS (SELECT DISTINCT hash FROM h), near AS (SELECT a.hash AS ha, b.hash AS hb, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM d a JOIN d b ON a.hash <= b.hash AND bit_count(xor(a.hash, b.hash)) <= 4)"
_COPIES_SQL = """, both_ways AS (SELECT * FROM near UNION SELECT hb, ha, distance FROM near)
SELECT h.seq, h.sequence, EXISTS (SELECT 1 FROM both_ways n JOIN h o ON o.hash = n.hb WHERE n.ha = h.hash AND o.seq < h.seq AND o.sequence <> h.sequence) AS dropped,
  EXISTS (SELECT 1 FROM both_ways n JOIN h o ON o.hash = n.hb WHERE n.ha = h.hash AND n.distance <= 2 AND o.seq < h.seq AND o.sequence = h.sequence AND o.modality = h.modality) AS "within" FROM h"""


@query(f"WITH {_WHOLE_SQL}{_PAIRED_SQL} SELECT * FROM near")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_hashes(settled(whole_hashes(spark, sf_dir)))


@query(f"WITH {_WHOLE_SQL}{_PAIRED_SQL}{_COPIES_SQL}")
def simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later near-copies, by whole texts, from another sequence are dropped; those of the same sequence are reported."""
    return search.dedupe(settled(whole_hashes(spark, sf_dir))).select("seq", "sequence", "dropped", "within")


#: Leaders of each sequence, in order.
LEADERS_SQL = f"""WITH RECURSIVE {_WHOLE_SQL}r AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY seq) AS rn FROM h),
s AS (SELECT sequence, rn, seq, seq AS leader, [struct_pack(q := seq, h := hash)] AS leaders FROM r WHERE rn = 1
  UNION ALL SELECT sequence, rn, seq, coalesce(near[1].q, seq), CASE WHEN len(near) > 0 THEN leaders ELSE list_append(leaders, struct_pack(q := seq, h := hash)) END
  FROM (SELECT r.*, s.leaders, list_filter(s.leaders, lambda l: bit_count(xor(l.h, r.hash)) <= 4) AS near FROM s JOIN r ON r.sequence = s.sequence AND r.rn = s.rn + 1))
SELECT sequence, seq, leader FROM s"""


#: A 60-bit simhash of a text's distinct words: each bit is the majority of that bit in the words' hashes.
_HASH_SQL = """w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents), hw AS (SELECT doc_id, ('0x' || substr(sha256(word), 1, 15))::BIGINT AS v FROM w WHERE word <> ''),
votes AS (SELECT doc_id, b, 2 * sum((v >> b) & 1) > count(*) AS one FROM hw, range(60) r(b) GROUP BY 1, 2), bits AS (SELECT doc_id, sum(CASE WHEN one THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS hash FROM votes GROUP BY 1),
h AS (SELECT doc_id AS seq, source AS sequence, lang AS modality, coalesce(hash, 0) AS hash FROM documents LEFT JOIN bits USING (doc_id))"""


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("sequence"), F.col("lang").alias("modality"), search.word_simhash(F.col("text")).alias("hash"))


@query(f"WITH {_HASH_SQL}, {_PAIRED_SQL} SELECT * FROM near")
def band_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of hashes that differ in four bits at most."""
    return search.near_hashes(settled(_hashes(spark, sf_dir)))


@query(f"WITH {_HASH_SQL}, {_PAIRED_SQL}{_COPIES_SQL}")
def band_lsh_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later near-copies from another sequence are dropped; those of the same sequence are reported."""
    return search.dedupe(settled(_hashes(spark, sf_dir))).select("seq", "sequence", "dropped", "within")

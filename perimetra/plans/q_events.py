"""Queries of event documents and of small selections, gates and shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import datasets, events, search, serving, tracks
from perimetra.plans.bind import POINTS_SQL, alerts, cameras, table, track_points
from perimetra.plans.registry import query

SCHEMA = "event.v1"

_EVENT_SQL = """d AS (SELECT event_id, user_id, value, event_type, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS uuid,
  CASE WHEN event_id % 17 = 0 THEN 140 ELSE event_id % 101 END AS confidence, CASE WHEN event_id % 19 = 0 THEN 'bird' ELSE 'person' END AS cls, greatest(0, least(1, value / 400)) AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE greatest(0, least(1, value / 300)) END AS m FROM events)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional events with planted defects that the event's number decides."""
    e = table(spark, sf_dir, "events")
    k, share = F.col("event_id"), lambda by: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / by))
    uuid = F.when(k % 13 == 0, "x").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0")))
    ids = {"event_id": uuid, "post_id": F.lit("post-1"), "camera_id": F.concat(F.lit("cam-"), (F.col("user_id") % 6).cast("string")), "captured_at": F.lit("2024-01-01T00:00:00Z")}
    scores = F.struct(share(400).alias("appearance"), F.when(k % 7 != 0, share(300)).alias("motion"))
    box = events.unit_box([F.col("value"), F.lit(10.0), F.col("value") + 20, F.lit(60.0)], F.lit(640.0), F.lit(480.0))
    detection = {"track_id": F.col("user_id"), "class": F.when(k % 19 == 0, "bird").otherwise("person"), "bbox": box, "channel_scores": scores, "agreed": F.lit(True), "threshold": F.lit(0.55), "ir": F.lit(False), "dori_band": F.lit(None).cast("string")}
    rule = {"fired": F.array("event_type"), "baseline": F.lit(None).cast("struct<dominant_direction:string,with:bigint,against:bigint>"), "metrics": F.struct(F.col("value").alias("net_px"))}
    confidence = F.when(k % 17 == 0, 140).otherwise(k % 101)
    raw = events.event_document(SCHEMA, ids, detection, rule, confidence, F.lit("file"))
    raw = F.when(k % 23 == 0, F.regexp_replace(raw, '"stage":"provisional"', '"stage":"sealed"')).when(k % 29 == 0, F.regexp_replace(raw, '^\\{', '{"extra":1,')).otherwise(raw)
    return e.select("event_id", F.when(k % 31 == 0, "[1]").otherwise(raw).alias("raw"))


@query(f"""WITH {_EVENT_SQL} SELECT event_id, CASE WHEN event_id % 31 = 0 THEN '$: no object' ELSE array_to_string(list_filter([CASE WHEN event_id % 29 = 0 AND event_id % 23 <> 0 THEN '$: unknown key' END, CASE WHEN uuid = 'x' THEN '$.event_id: bad format' END, CASE WHEN confidence > 100 THEN '$.confidence: out of range' END,
  CASE WHEN cls = 'bird' THEN '$.detection.class: not allowed' END, CASE WHEN m IS NULL THEN '$.detection.channel_scores.motion: required' END, CASE WHEN event_id % 23 = 0 THEN 'explanation: required after provisional' END, CASE WHEN event_id % 23 = 0 THEN 'evidence: goes with sealed' END], lambda x: x IS NOT NULL), ' | ') END AS errors FROM d""")
def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("event_id", F.array_join(events.event_errors(F.col("raw"), SCHEMA), " | ").alias("errors"))


@query(f"""WITH {_EVENT_SQL} SELECT event_id, 'A' || substr(replace(uuid, '-', ''), 1, 16) AS alert_id, CASE WHEN event_id % 23 = 0 THEN 'sealed' ELSE 'prov' END AS stage, '00:00:00' AS "at", confidence,
  CASE cls WHEN 'person' THEN 'Person' ELSE 'Object' END || ' flagged on Camera ' || CAST(user_id % 6 AS VARCHAR) || ' (' || event_type || '); appearance and motion channels agree at ' || CAST(confidence AS VARCHAR) || '% confidence.' AS reason,
  'pending…' AS hash, round(('0x' || substr(sha256(uuid), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 100, 2) AS seed, a >= 0.55 AS appearance, coalesce(m, 0) >= 0.55 AS motion, 'track_id,bbox,channel_scores,rule_fired' AS known FROM d WHERE event_id % 31 <> 0""")
def alert_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert that each event document is shown as."""
    documents = _documents(spark, sf_dir)
    name = F.concat(F.lit("Camera "), F.regexp_extract(F.get_json_object("raw", "$.camera_id"), r"(\d+)$", 1))
    made = events.alerts_of(documents, name)
    return made.select("event_id", "alert_id", "stage", "at", "confidence", "reason", "hash", "seed", "appearance", "motion", F.array_join(F.json_object_keys("more"), ",").alias("known"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '$: nothing to update' WHEN 1 THEN '$.evidence: required when sealed' WHEN 2 THEN '$.stage: not allowed' WHEN 3 THEN '$.explanation.source: not allowed' ELSE '' END AS errors FROM events""")
def update_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that carry nothing, seal without evidence, go back, or explain from nowhere."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    head = F.concat(F.lit('{"schema":"update.v1","event_id":"00000000-0000-4000-8000-'), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit('"'))
    said = lambda source: f',"explanation":{{"text":"seen","source":"{source}","latency_ms":5}}}}'
    rest = F.when(k == 0, "}").when(k == 1, ',"stage":"sealed"}').when(k == 2, ',"stage":"provisional"}').when(k == 3, said("rumour")).otherwise(said("vlm"))
    return e.select("event_id", F.array_join(events.update_errors(F.concat(head, rest), "update.v1"), " | ").alias("errors"))


@query("SELECT s AS asked, count(*) AS n FROM (SELECT 'all' AS s UNION ALL SELECT 'BUILDING' UNION ALL SELECT 'nowhere') q JOIN customer ON s = 'all' OR c_mktsegment = s GROUP BY s")
def sector_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, found = cameras(spark, sf_dir), None
    for asked in ("all", "BUILDING", "nowhere"):
        n = serving.of_sector(c, asked).groupBy(F.lit(asked).alias("asked")).agg(F.count(F.lit(1)).alias("n"))
        found = n if found is None else found.unionByName(n)
    return found


@query("SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'")
def day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.in_days(alerts(spark, sf_dir).withColumn("day", F.to_date("captured_at")), "1997-03-01", "1997-03-31").select("id")


@query(f"WITH {POINTS_SQL} SELECT camera_id, track_id, CASE WHEN count(*) FILTER (class_name = 'error') > 0 THEN 'alert' ELSE 'observation' END AS kind FROM pts GROUP BY 1, 2")
def alert_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks for which the rule 'error' fired are alerts, the others observations."""
    n = track_points(spark, sf_dir).groupBy("camera_id", "track_id").agg(F.count_if(F.col("class_name") == "error").alias("n_rules"))
    return serving.by_policy(n).drop("n_rules")


@query(f"WITH {POINTS_SQL}, s AS (SELECT track_id, max(t) + 3600 - max(t) % 60 AS captured_at, max(t) AS stamp FROM pts GROUP BY 1) SELECT seq, round(t + (captured_at - stamp), 3) AS t FROM pts JOIN s USING (track_id)")
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir)
    stamps = p.groupBy("track_id").agg(F.max("t").alias("timestamp")).withColumn("captured_at", F.col("timestamp") + 3600 - F.col("timestamp") % 60)
    return serving.to_wall_clock(p, stamps, ["track_id"]).select("seq", F.round("t", 3).alias("t"))


@query("""SELECT 'length' AS step, CASE WHEN n_chars < 100 THEN 'short' ELSE 'long' END AS reason, count(*) AS n FROM documents WHERE n_chars < 100 OR n_chars > 5000 GROUP BY 2 UNION ALL SELECT 'language', lang, count(*) FROM documents WHERE lang <> 'en' GROUP BY 2""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    length = d.filter("n_chars < 100 or n_chars > 5000").select(F.lit("length").alias("step"), F.when(F.col("n_chars") < 100, "short").otherwise("long").alias("reason"))
    return serving.reasons_counted(length, d.filter("lang <> 'en'").select(F.lit("language").alias("step"), F.col("lang").alias("reason")))


@query(f"WITH {POINTS_SQL} SELECT DISTINCT camera_id, track_id FROM pts WHERE track_id % 4 <> 0 AND track_id % 3 = 0")
def rule_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed tracks with points, of a set of ids; tracks that were never seen have no history."""
    p = track_points(spark, sf_dir)
    known = p.select("camera_id", "track_id").distinct()
    every = known.unionByName(known.select("camera_id", (F.col("track_id") + 10_000_000).alias("track_id"))).withColumn("tentative", F.col("track_id") % 4 == 0)
    return tracks.for_rules(every, p, known.filter("track_id % 3 = 0")).select("camera_id", "track_id")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'lwir' END AS modality FROM documents")
def modality_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    stem = F.concat(F.lit("frame_"), F.col("doc_id").cast("string"), F.when(k == 0, "_visible").when(k == 1, "_lwir").otherwise("_lwir_old"))
    return table(spark, sf_dir, "documents").select("doc_id", datasets.modality_of(stem).alias("modality"))


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS image, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR) || '_t0', source FROM documents WHERE lang = 'es'")
def frames_and_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no label excludes, with the tiles of some."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image"), "source", "lang")
    out = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image"))
    tiles = d.filter("lang = 'es'").select(F.concat("image", F.lit("_t0")).alias("image"), "source")
    return datasets.with_tiles(d.select("image", "source"), out, tiles)


@query("SELECT source, list_sort(list_intersect(array_agg(DISTINCT lang), ['es', 'de'])) [1] AS first_blocked FROM documents GROUP BY source HAVING len(list_intersect(array_agg(DISTINCT lang), ['es', 'de'])) > 0")
def blocked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("natives"))
    return datasets.blocked(s, "natives", ["es", "de"]).select("source", F.col("blocked_by")[0].alias("first_blocked"))


@query("SELECT l_orderkey AS image, count(*) FILTER (l_quantity < 10) AS small FROM lineitem GROUP BY 1 ORDER BY small DESC, image LIMIT 40")
def tile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.count_if(F.col("l_quantity") < 10).alias("small"))
    return datasets.ranked_candidates(n, "small", "image", 40)


@query("SELECT count(*) AS candidates, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS unreviewed, CASE WHEN count(*) FILTER (event_type = 'purchase') >= 300 THEN 'ship' ELSE 'withdraw' END AS decision FROM events")
def class_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "purchase", " CART").when(F.col("event_type") == "error", "no").otherwise("")
    return datasets.class_gate(table(spark, sf_dir, "events").select(verdict.alias("verdict")), "cart", 300)


@query("""WITH w AS (SELECT 'p' || CAST(doc_id AS VARCHAR) AS path, CAST(n_chars AS BIGINT) AS want FROM documents WHERE doc_id % 10 <> 3), h AS (SELECT 'p' || CAST(doc_id AS VARCHAR) AS path, CAST(n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS have FROM documents WHERE doc_id % 4 <> 1)
SELECT path, CASE WHEN want IS NULL THEN 'remove' WHEN have IS NULL THEN 'place' WHEN want <> have THEN 'replace' ELSE 'keep' END AS action, want AS bytes FROM w FULL JOIN h USING (path)""")
def placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path, size = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("long")
    wanted = d.filter("doc_id % 10 <> 3").select(path, size.alias("bytes"))
    return datasets.placement(wanted, d.filter("doc_id % 4 <> 1").select(path, (size + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("bytes")))


_COPIES_SQL = "h AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS image, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, xor(('0x' || substr(sha256(text), 1, 15))::BIGINT, CAST(doc_id % 4 AS BIGINT)) AS hash FROM documents)"


@query(f"""WITH {_COPIES_SQL}, one AS (SELECT split, hash, hash >> 48 AS bucket, min(image) AS image, count(*) AS n FROM h GROUP BY 1, 2, 3)
SELECT a.split AS split_a, b.split AS split_b, a.image AS image_a, b.image AS image_b, a.n AS n_a, b.n AS n_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM one a JOIN one b USING (bucket) WHERE a.split < b.split AND bit_count(xor(a.hash, b.hash)) <= 10""")
def cross_split_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies on both sides of a split, by a hash of the whole text with two low bits turned."""
    d = table(spark, sf_dir, "documents")
    base = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    rows = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image"), F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train").alias("split"), base.bitwiseXOR((F.col("doc_id") % 4).cast("long")).alias("hash"))
    return datasets.split_copies(rows)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, CAST(floor(vec_id / 20.0) AS BIGINT) AS clip_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q),
b AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, vec_id) AS rn FROM s), t AS (SELECT * FROM b WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 6)
SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS position, clip_id, vec_id AS keyframe_id, CAST(round_even(100.0 / (1.0 + exp(-(score * 10.0 - 2.0))), 0) AS INTEGER) AS percent, coalesce(c_name, CAST(clip_id * 7 AS VARCHAR)) AS camera FROM t LEFT JOIN customer ON c_custkey = clip_id * 7""")
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a search: places, percentages, cameras by name or number."""
    from perimetra.plans.q_search import _keyframes, _probe

    k = _keyframes(spark, sf_dir)
    clips = k.select("clip_id").distinct().select("clip_id", (F.col("clip_id") * 7).alias("camera_id"), F.lit(None).cast("timestamp").alias("at"), F.array().cast("array<string>").alias("chips"))
    return search.response(search.search(k, _probe(k, 0), 6), cameras(spark, sf_dir), clips).select("position", "clip_id", "keyframe_id", "percent", "camera")

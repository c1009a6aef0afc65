"""Queries of the serving layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import serving, validate
from perimetra.plans.bind import POINTS_SQL, alerts, cameras, posts, table, track_points
from perimetra.plans.registry import query


@query("SELECT o_orderkey AS id, o_orderstatus AS stage, c_name AS camera, c_mktsegment AS sector, n_name AS post FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def alert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = serving.alert_view(alerts(spark, sf_dir), cameras(spark, sf_dir))
    return view.join(posts(spark, sf_dir).select(F.col("id").alias("post_id"), F.col("name").alias("post")), "post_id", "left").select("id", "stage", "camera", "sector", "post")


@query("SELECT n_nationkey AS id, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def alerts_per_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.counts_by(posts(spark, sf_dir).select(F.col("id")), "id", table(spark, sf_dir, "supplier"), "s_nationkey")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def alerts_per_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.counts_by(cameras(spark, sf_dir).select("id"), "id", alerts(spark, sf_dir), "camera_id")


@query("""SELECT n_nationkey AS post_id, n_name AS name, (n_regionkey = 0 OR EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'P' AND o_totalprice > 490000)) AS alert FROM nation""")
def posts_with_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = alerts(spark, sf_dir).filter("stage = 'P' and total > 490000")
    lit = urgent.join(cameras(spark, sf_dir).select(F.col("id").alias("camera_id"), "post_id"), "camera_id")
    rows = posts(spark, sf_dir).withColumnRenamed("id", "post_id")
    return serving.with_flag(rows, "post_id", F.col("region_id") == 0, lit, "post_id").select("post_id", "name", F.col("flag").alias("alert"))


@query("SELECT o_orderkey AS id, o_orderstatus AS stage, o_totalprice AS total FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def alerts_live_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest live alerts."""
    return serving.latest(serving.live(alerts(spark, sf_dir), ("F",)), ["captured_at", "seq"], 50).select("id", "stage", "total")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty entries, in order."""
    return serving.tail(alerts(spark, sf_dir).select("id", "total"), "id", 20)


@query("""WITH live AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F') SELECT o_custkey AS camera_id, o_orderstatus AS stage, o_orderkey AS id FROM live WHERE rn = 1""")
def live_alert_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first live alert of each camera and stage, the one a new event would enrich."""
    return serving.first_per(serving.live(alerts(spark, sf_dir), ("F",)), ["camera_id", "stage"], ["seq"]).select("camera_id", "stage", "id")


@query(f"""WITH {POINTS_SQL}, h AS (SELECT camera_id, CAST(floor(t / 3600) AS BIGINT) % 24 AS hour FROM pts), n AS (SELECT camera_id, count(*) FILTER (hour BETWEEN 6 AND 17) AS day, count(*) FILTER (hour < 6 OR hour > 17) AS night FROM h GROUP BY camera_id)
SELECT camera_id, day, night, CAST(floor(100.0 * day / (day + night) + 0.5) AS BIGINT) AS day_pct, 100 - CAST(floor(100.0 * day / (day + night) + 0.5) AS BIGINT) AS night_pct FROM n""")
def day_night_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = track_points(spark, sf_dir)
    return serving.day_night(points, F.floor(F.col("t") / 3600) % 24, ["camera_id"])


@query(f"""WITH {POINTS_SQL}, n AS (SELECT CAST(floor(floor(t) / 28800) * 28800 AS BIGINT) AS shift_start, count(*) AS alerts FROM pts WHERE class_name = 'error' GROUP BY 1)
SELECT shift_start, alerts, least(12, alerts) AS used, least(12, alerts) >= 10 AS near FROM n""")
def shift_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    raised = track_points(spark, sf_dir).filter("class_name = 'error'").select(F.timestamp_seconds(F.floor("t")).alias("captured_at"))
    return serving.shift_budget(raised)


@query(f"""WITH {POINTS_SQL}, horizon AS (SELECT max(t) AS now FROM pts), n AS (SELECT 11 - CAST(floor((now - t - 1e-9) / 3600) AS INTEGER) AS bucket, count(*) AS n FROM pts, horizon WHERE t < now AND t >= now - 12 * 3600 GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM range(12) r(b) LEFT JOIN n ON bucket = b""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in each of the twelve hours before the latest point."""
    points = track_points(spark, sf_dir)
    latest = points.agg(F.max("t").alias("latest"))
    return serving.tumbling_counts(points.join(F.broadcast(latest)), F.col("latest"), 12, 3600)


@query(f"""WITH {POINTS_SQL}, r AS (SELECT camera_id, y, row_number() OVER (PARTITION BY camera_id ORDER BY t DESC, seq DESC) AS rn FROM pts)
SELECT camera_id, list(y ORDER BY rn DESC) AS series FROM r WHERE rn <= 12 GROUP BY camera_id""")
def recent_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.recent_series(track_points(spark, sf_dir), ["camera_id"], ["t", "seq"], "y", 12)


@query("""WITH log AS (SELECT o_custkey AS camera_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS total FROM orders)
SELECT camera_id, arg_max(priority, seq) FILTER (priority IS NOT NULL) AS priority, arg_max(total, seq) FILTER (total IS NOT NULL) AS total FROM log GROUP BY camera_id""")
def last_non_null_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates folded into one row per camera."""
    log = alerts(spark, sf_dir).select("camera_id", "seq", F.when(F.col("seq") % 3 == 0, F.col("priority")).alias("priority"), F.when(F.col("seq") % 2 == 0, F.col("total")).alias("total"))
    return serving.materialised(log, ["camera_id"], ["seq"], ["priority", "total"])


@query("""WITH first AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), late AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT * FROM first UNION ALL SELECT l.* FROM late l ANTI JOIN first f ON l.user_id = f.user_id AND l.event_type = f.event_type""")
def ledger_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of first (user, type) events, with a replayed and a new batch appended."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    ledger = serving.first_per(e.filter("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"])
    replayed = serving.insert_absent(ledger, ledger, ["user_id", "event_type"])
    return serving.insert_absent(replayed, e.filter("event_id % 2 = 1"), ["user_id", "event_type"])


_MERGE_SQL = f"""{POINTS_SQL},
ev AS (SELECT camera_id, track_id, day, seq, class_name, CAST(y AS INTEGER) AS y, CASE WHEN CAST(y AS INTEGER) % 10 = 9 THEN 'sealed' WHEN CAST(y AS INTEGER) % 3 = 0 THEN 'confirmed' ELSE 'provisional' END AS stage,
  CASE WHEN CAST(y AS INTEGER) % 20 = 9 THEN 'ev' || CAST(seq AS VARCHAR) END AS evidence_id, CASE WHEN class_name = 'view' THEN 'model' ELSE 'template' END AS src FROM pts),
rules AS (SELECT camera_id, track_id, day, class_name, min(seq) AS first FROM ev GROUP BY 1, 2, 3, 4),
bag AS (SELECT camera_id, track_id, day, string_agg(class_name, ' + ' ORDER BY first) AS rule_fired FROM rules GROUP BY 1, 2, 3)"""


@query(f"""WITH {_MERGE_SQL}, m AS (SELECT camera_id, track_id, day, min(seq) AS event_id, count(*) AS events,
  max(CASE WHEN stage = 'sealed' AND evidence_id IS NULL THEN 2 WHEN stage = 'sealed' THEN 3 WHEN stage = 'confirmed' THEN 2 ELSE 1 END) AS st,
  coalesce(arg_max(src || ' ' || CAST(seq AS VARCHAR), seq) FILTER (src = 'model'), arg_max(src || ' ' || CAST(seq AS VARCHAR), seq)) AS reason, arg_min(evidence_id, seq) FILTER (evidence_id IS NOT NULL) AS evidence_id, arg_max(y, seq) AS confidence FROM ev GROUP BY 1, 2, 3)
SELECT camera_id, track_id, day, event_id, events, reason, evidence_id, confidence, ['provisional', 'confirmed', 'sealed', 'gone'][st] AS stage, rule_fired FROM m JOIN bag USING (camera_id, track_id, day)""")
def alert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a track folded into its one alert."""
    y = F.col("y").cast("int")
    ev = track_points(spark, sf_dir).select(
        "camera_id", "track_id", "day", "seq", F.col("seq").alias("event_id"), F.array("class_name").alias("rules"), y.alias("confidence"),
        F.when(y % 10 == 9, "sealed").when(y % 3 == 0, "confirmed").otherwise("provisional").alias("stage"),
        F.when(y % 20 == 9, F.concat(F.lit("ev"), F.col("seq").cast("string"))).alias("evidence_id"),
        F.when(F.col("class_name") == "view", "model").otherwise("template").alias("reason_source"),
    ).withColumn("reason", F.concat_ws(" ", "reason_source", F.col("seq").cast("string")))
    return serving.merge_alerts(ev, ["camera_id", "track_id", "day"], ["seq"])


@query("""SELECT e.event_id, CASE WHEN l.user_id IS NULL THEN 'fresh' ELSE 'patch' END AS action FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 200) l USING (user_id) WHERE e.event_type = 'view'""")
def snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return serving.snapshot_plan(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase' and value > 200"), "user_id").select("event_id", "action")


@query("""WITH j AS (SELECT event_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
e AS (SELECT event_id, list_filter([CASE WHEN NOT (value BETWEEN 1 AND 300) THEN 'value: out of range' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'event_type: not allowed' END,
  CASE WHEN NOT (k BETWEEN 5 AND 95) THEN 'props.k: out of range' END], lambda x: x IS NOT NULL) AS errors FROM j)
SELECT event_id, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the schema, with every reason."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    schema = validate.Schema().between(F.col("value"), "value", 1, 300).one_of(F.col("event_type"), "event_type", ("view", "click", "purchase")).between(F.col("k"), "props.k", 5, 95).known_keys(F.col("props"), "props", ("k",))
    return e.select("event_id", schema.errors().alias("e")).filter(F.size("e") > 0).select("event_id", F.array_join("e", "; ").alias("errors"))


@query("SELECT c_mktsegment AS sector, min(c_custkey) AS first_id FROM customer GROUP BY c_mktsegment ORDER BY first_id")
def sectors_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sectors by first appearance."""
    return cameras(spark, sf_dir).groupBy("sector").agg(F.min("id").alias("first_id")).orderBy("first_id")


@query(f"""WITH {POINTS_SQL}, s AS (SELECT seq, CAST(floor(x) AS BIGINT) AS score, class_name FROM pts)
SELECT seq, greatest(0, least(100, CAST(round_even(score / 5.0, 0) AS BIGINT))) AS confidence, CASE WHEN class_name IN ('view', 'click') THEN 'live' ELSE 'other' END AS source, 'A' || substr(sha256(CAST(seq AS VARCHAR)), 1, 16) AS alert_id, ('0x' || substr(sha256(CAST(seq AS VARCHAR)), 1, 8))::BIGINT AS seed FROM s""")
def event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped confidence (halves to even), alert id and deterministic seed of each event."""
    p = track_points(spark, sf_dir)
    digest = F.sha2(F.col("seq").cast("string"), 256)
    return p.select(
        "seq", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.floor("x") / 5.0).cast("long"))).alias("confidence"),
        F.when(F.col("class_name").isin("view", "click"), "live").otherwise("other").alias("source"),
        F.concat(F.lit("A"), F.substring(digest, 1, 16)).alias("alert_id"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("seed"),
    )


@query("""WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'), d AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20)
SELECT c_custkey, coalesce(n_name, 'camera ' || CAST(c_nationkey AS VARCHAR)) AS post FROM s LEFT JOIN d ON n_nationkey = c_nationkey""")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension lookup that makes up a row for unknown keys."""
    s = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    d = table(spark, sf_dir, "nation").filter("n_nationkey < 20")
    return s.join(d, s.c_nationkey == d.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("camera "), F.col("c_nationkey").cast("string"))).alias("post"))


@query("""WITH r AS (SELECT substr(sha256(CAST(event_id // 3 AS VARCHAR)), 1, 16 + CAST(event_id % 5 AS INTEGER) * 20) AS nonce, CAST(event_id % 200 AS DOUBLE) AS skew, event_id FROM events),
g AS (SELECT nonce, event_id, row_number() OVER (PARTITION BY nonce ORDER BY event_id) AS rn FROM r WHERE skew <= 120 AND regexp_matches(nonce, '^[0-9a-f]{16,64}$')) SELECT nonce, event_id FROM g WHERE rn = 1""")
def replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First use of each nonce among events whose clocks agree."""
    e = table(spark, sf_dir, "events")
    nonce = F.expr("substr(sha2(cast(event_id div 3 as string), 256), 1, cast(16 + (event_id % 5) * 20 as int))")
    rows = e.select("event_id", nonce.alias("nonce"), F.col("event_id").cast("double").alias("received"), (F.col("event_id") - F.col("event_id") % 200).cast("double").alias("sent"))
    return serving.replay_guard(rows).select("nonce", "event_id")

"""Queries of buffers, retention, plates and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import geometry as g
from perimetra.operators import calibration, datasets, ranging, retention, serving, stateful, tracks
from perimetra.plans.bind import POINTS_SQL, TRACK, table, track_points
from perimetra.plans.q_data import BOXES_SQL, boxes
from perimetra.plans.q_tracks import FEATURES_SQL
from perimetra.plans.registry import query


@query(f"WITH {POINTS_SQL}, r AS (SELECT camera_id, seq, row_number() OVER (PARTITION BY camera_id ORDER BY t DESC, seq DESC) AS k, count(*) OVER (PARTITION BY camera_id) AS n FROM pts) SELECT camera_id, seq, greatest(n - 64, 0) AS dropped FROM r WHERE k <= 64")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 newest points of each camera, and how many a full queue dropped."""
    return retention.newest(track_points(spark, sf_dir), ["camera_id"], ["t", "seq"], 64).select("camera_id", "seq", "dropped")


@query(f"WITH {POINTS_SQL}, m AS (SELECT max(t) AS now FROM pts) SELECT seq FROM pts, m WHERE now - t > 10 * 86400")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points past ten days of retention."""
    p = track_points(spark, sf_dir)
    now = p.agg(F.max("t").alias("now"))
    return retention.purge(p.join(F.broadcast(now)), F.col("t"), F.col("now"), 10 * 86400.0)[1].select("seq")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(f"WITH {POINTS_SQL}, r AS (SELECT camera_id, track_id, seq, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY t, seq) - 1 AS k FROM pts) SELECT camera_id, track_id, seq, CAST(k // 3 AS INTEGER) AS attempt FROM r WHERE k % 3 = 0 AND k < 18")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.attempts(track_points(spark, sf_dir), ["camera_id", "track_id"], ["t", "seq"]).select("camera_id", "track_id", "seq", "attempt")


@query(f"WITH {POINTS_SQL}, r AS (SELECT track_id, day, seq, row_number() OVER (PARTITION BY track_id, day ORDER BY t, seq) AS attempt FROM pts WHERE class_name IN ('view', 'click') AND x >= 48) SELECT track_id, day, seq, CAST(attempt AS INTEGER) AS attempt FROM r WHERE attempt <= 3")
def plate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track_points(spark, sf_dir).withColumnRenamed("x", "width")
    return retention.plate_attempts(p, ["track_id", "day"], ["t", "seq"], ("view", "click")).select("track_id", "day", "seq", "attempt")


@query(f"""WITH {BOXES_SQL}, s AS (SELECT image, box, x1, x2 - x1 AS w, y2 - y1 AS h, (x1 % 100) / 100.0 AS fill FROM bx)
SELECT image, box, x1, CASE WHEN w >= 18 AND h > 0 AND w / h BETWEEN 1.15 AND 5.5 AND w * h / 3000.0 BETWEEN 0.0025 AND 0.55 THEN round(greatest(0, least(1, 0.5 * fill + 0.5 * (1 - least(1, abs(w / h - 3.325) / 3.325)))), 6) ELSE -1.0 END AS score FROM s""")
def plate_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How plate-like each box is; -1 outside the limits."""
    b = boxes(spark, sf_dir)
    score = retention.plate_score(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), (F.col("x1") % 100) / 100.0, F.lit(3000.0))
    return b.select("image", "box", "x1", F.coalesce(F.round(score, 6), F.lit(-1.0)).alias("score"))


@query(f"""WITH RECURSIVE {FEATURES_SQL}, d AS (SELECT camera_id, track_id AS seq, dwell, net >= 40 AS wrong, (degrees(atan2(vy, vx)) + 360.0) % 360.0 AS heading, row_number() OVER (PARTITION BY camera_id ORDER BY t1, track_id) AS rn FROM feats WHERE net > 0),
s AS (SELECT camera_id, rn, seq, CASE WHEN wrong THEN heading END AS majority, CASE WHEN wrong THEN 0.0::DOUBLE ELSE 0.15 * dwell END AS typical FROM d WHERE rn = 1
  UNION ALL SELECT d.camera_id, d.rn, d.seq, CASE WHEN NOT wrong THEN majority WHEN majority IS NULL THEN heading
      ELSE (degrees(atan2(0.85 * sin(radians(majority)) + 0.15 * sin(radians(heading)), 0.85 * cos(radians(majority)) + 0.15 * cos(radians(heading)))) + 360.0) % 360.0 END,
    CASE WHEN wrong THEN typical ELSE 0.85 * typical + 0.15 * dwell END FROM s JOIN d ON d.camera_id = s.camera_id AND d.rn = s.rn + 1)
SELECT camera_id, seq, round(majority, 5) AS majority, round(typical, 3) AS typical_dwell, rn AS dismissals FROM s""")
def dismissal_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each camera's baseline as its alerts are dismissed one by one."""
    f = tracks.features(track_points(spark, sf_dir), TRACK).filter("net > 0")
    rows = f.select("camera_id", F.col("t1").alias("t"), F.col("track_id").alias("seq"), F.when(F.col("net") >= 40, "wrong direction").otherwise("loitering").alias("rule"), g.heading(F.col("vx"), F.col("vy")).alias("heading"), "dwell")
    learnt = stateful.batch(rows, ["camera_id"], stateful.Dismissals)
    return learnt.select("camera_id", "seq", F.round("majority", 5).alias("majority"), F.round("typical_dwell", 3).alias("typical_dwell"), "dismissals")


@query(f"WITH {POINTS_SQL}, c AS (SELECT camera_id, avg(x) FILTER (y < 50) AS inside, avg(x) FILTER (y >= 50) AS outside, quantile_cont(x, 0.5) FILTER (y >= 50) AS floor, quantile_cont(x, 0.95) FILTER (y >= 50) AS p95 FROM pts GROUP BY 1) SELECT camera_id, round(inside / outside, 6) AS contrast, round(floor, 6) AS floor, round(p95, 6) AS p95 FROM c")
def scene_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of mean energies inside and outside objects, and the background's levels."""
    c = track_points(spark, sf_dir).withColumn("energy", F.col("x")).withColumn("is_background", F.col("y") >= 50)
    both = calibration.contrast(c, ["camera_id"]).join(calibration.scene_levels(c, ["camera_id"]), "camera_id")
    return both.select("camera_id", *[F.round(x, 6).alias(x) for x in ("contrast", "floor", "p95")])


@query(f"WITH {POINTS_SQL} SELECT camera_id, round(max(t) - min(t), 3) AS elapsed, count(*) AS frames, max(t) - min(t) >= 2500000 AND count(*) >= 1500 AS ready FROM pts GROUP BY 1")
def calibration_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.warmed_up(track_points(spark, sf_dir), ["camera_id"], 2500000.0, 1500).withColumn("elapsed", F.round("elapsed", 3))


_PLANES_SQL = """c AS (SELECT c_custkey AS camera_id, (0.004 + (c_custkey % 5) * 0.001)::DOUBLE AS s, ((c_custkey % 7) * 0.0003)::DOUBLE AS p, c_custkey % 11 <> 0 AS trusted FROM customer),
r AS (SELECT c.*, v::DOUBLE AS v FROM c, range(480) x(v) WHERE trusted), pl AS (SELECT camera_id, v, (s * 320 - s * 320) / (p * v + 1 - 479 * p) AS x, (s * 479 - s * v) / (p * v + 1 - 479 * p) AS y, (s * 479 - s * (v + 1)) / (p * (v + 1) + 1 - 479 * p) AS y1 FROM r),
far AS (SELECT camera_id, coalesce(max(abs(y)) FILTER (1 / abs(y1 - y) >= 250), 0) AS identification, coalesce(max(abs(y)) FILTER (1 / abs(y1 - y) >= 125), 0) AS recognition, coalesce(max(abs(y)) FILTER (1 / abs(y1 - y) >= 62), 0) AS observation, coalesce(max(abs(y)) FILTER (1 / abs(y1 - y) >= 25), 0) AS detection FROM pl GROUP BY 1)"""


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras with a homography of their own; every eleventh is not trusted."""
    k = F.col("c_custkey")
    s, p = 0.004 + (k % 5) * 0.001, (k % 7) * 0.0003
    zero = F.lit(0.0)
    h = F.array(s, zero, -320 * s, zero, -s, 479 * s, zero, p, 1 - 479 * p)
    return table(spark, sf_dir, "customer").select(k.alias("camera_id"), h.alias("homography"), F.lit(640).alias("width"), F.lit(480).alias("height"), (k % 11 != 0).alias("trusted"))


@query(f"WITH {_PLANES_SQL} SELECT camera_id, CASE WHEN trusted THEN 'graded' ELSE 'refused' END AS status, round(identification, 6) AS identification, round(recognition, 6) AS recognition, round(observation, 6) AS observation, round(detection, 6) AS detection FROM c LEFT JOIN far USING (camera_id)")
def dori_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each band of each camera reaches."""
    bands = [name for name, _ in ranging.DORI]
    return ranging.dori_capability(_planes(spark, sf_dir)).select("camera_id", "status", *[F.round(b, 6).alias(b) for b in bands])


@query(f"WITH {_PLANES_SQL} SELECT camera_id, m AS range_m, CASE WHEN m > detection THEN NULL WHEN m <= identification THEN 'identification' WHEN m <= recognition THEN 'recognition' WHEN m <= observation THEN 'observation' WHEN m <= detection THEN 'detection' END AS band FROM c LEFT JOIN far USING (camera_id), (VALUES (0.5::DOUBLE), (2.0), (3.5), (40.0)) q(m)")
def capability_at_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each camera can tell at some ranges."""
    asked = F.explode(F.array(*[F.lit(m) for m in (0.5, 2.0, 3.5, 40.0)])).alias("range_m")
    return ranging.dori_capability(_planes(spark, sf_dir)).select("*", asked).select("camera_id", "range_m", ranging.capability_at(F.col("range_m")).alias("band"))


@query("WITH a AS (SELECT doc_id, 'one' AS source FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, 'two' AS source FROM documents WHERE lang = 'de') SELECT * FROM a UNION ALL SELECT * FROM b")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enabled indexes in one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = {"one": d.filter("lang = 'en'").select("doc_id"), "two": d.filter("lang = 'de'").select("doc_id"), "off": d.select("doc_id")}
    return datasets.union_sources(parts, ["one", "two"])


@query("WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM e GROUP BY user_id HAVING count(*) > 1")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not unique, with what they hold."""
    return datasets.leaks(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.array_join("splits", ",").alias("types"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE value > 50 GROUP BY user_id ORDER BY event_id DESC LIMIT 30")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty users that changed last, with their last large event."""
    e = table(spark, sf_dir, "events").filter("value > 50")
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    return serving.latest(last, ["event_id"], 30)

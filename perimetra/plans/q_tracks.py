"""Queries of the trajectory family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.functions import geometry as g
from perimetra.functions import timeutil
from perimetra.operators import grouping, ranging, tracks
from perimetra.plans.bind import POINTS_SQL, TRACK, cameras, track_points
from perimetra.plans.registry import query

DWELL, NET, MOVE = 6 * 3600.0, 10.0, 40.0

#: A fence of two segments along x = 50, the same for every camera.
SEGMENTS = [(c, "line", i, 50.0, a, 50.0, b, None) for c in range(6) for i, (a, b) in enumerate(((-10.0, 50.0), (50.0, 110.0)))]
SEGMENT_SCHEMA = "camera_id long, fence string, segment int, ax double, ay double, bx double, by double, only string"
#: Sanctioned hours in minutes of the day: cameras 0-2 by day, 3-4 over midnight; camera 5 has none.
HOURS = [(0, 360, 1080), (1, 360, 1080), (2, 480, 1020), (3, 1320, 360), (4, 1320, 360)]

FEATURES_SQL = f"""{POINTS_SQL},
legs AS (
  SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, row_number() OVER w AS rn, count(*) OVER (PARTITION BY camera_id, track_id, day) AS n_all
  FROM pts WINDOW w AS (PARTITION BY camera_id, track_id, day ORDER BY t, seq)),
ends AS (
  SELECT camera_id, track_id, day, count(*) AS n, min(t) AS t0, max(t) AS t1, coalesce(sum(step), 0.0) AS path,
    max(x) FILTER (rn = 1) AS x0, max(y) FILTER (rn = 1) AS y0, max(x) FILTER (rn = n_all) AS x1, max(y) FILTER (rn = n_all) AS y1
  FROM legs GROUP BY camera_id, track_id, day),
feats AS (
  SELECT *, t1 - t0 AS dwell, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS net,
    CASE WHEN t1 > t0 THEN (x1 - x0) / (t1 - t0) ELSE 0.0 END AS vx, CASE WHEN t1 > t0 THEN (y1 - y0) / (t1 - t0) ELSE 0.0 END AS vy
  FROM ends)"""
BASELINE_SQL = f"""{FEATURES_SQL},
moved AS (SELECT *, (degrees(atan2(y1 - y0, x1 - x0)) + 360.0) % 360.0 AS heading FROM feats WHERE net >= 10),
circ AS (SELECT camera_id, (degrees(atan2(sum(sin(radians(heading))), sum(cos(radians(heading))))) + 360.0) % 360.0 AS baseline FROM moved GROUP BY camera_id),
turned AS (SELECT m.camera_id, baseline, least(abs(heading - baseline), 360.0 - abs(heading - baseline)) AS gap FROM moved m JOIN circ USING (camera_id)),
flows AS (SELECT camera_id, max(baseline) AS baseline, count(*) FILTER (gap <= 90) AS with_flow, count(*) FILTER (gap > 90) AS against_flow FROM turned GROUP BY camera_id)"""
CROSS_SQL = """
segs AS (SELECT * FROM (VALUES (0, 50.0::DOUBLE, -10.0::DOUBLE, 50.0::DOUBLE, 50.0::DOUBLE), (1, 50.0, 50.0, 50.0, 110.0)) s(segment, ax, ay, bx, b_y)),
sided AS (SELECT p.*, s.*, (bx - ax) * (y - ay) - (b_y - ay) * (x - ax) AS side FROM pts p CROSS JOIN segs s),
prev AS (
  SELECT *, lag(side) OVER w AS before, lag(x) OVER w AS px, lag(y) OVER w AS py FROM sided WHERE abs(side) > 1e-9
  WINDOW w AS (PARTITION BY camera_id, track_id, day, segment ORDER BY t, seq)),
across AS (
  SELECT *, (x - px) * (ay - py) - (y - py) * (ax - px) AS sa, (x - px) * (b_y - py) - (y - py) * (bx - px) AS sb FROM prev
  WHERE (before > 1e-9 AND side < -1e-9) OR (before < -1e-9 AND side > 1e-9)),
crossed AS (
  SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, day ORDER BY t, segment, seq) AS rn FROM across
  WHERE (sa > 1e-9 AND sb < -1e-9) OR (sa < -1e-9 AND sb > 1e-9))"""
LOCAL_MINUTE_SQL = "(CAST(floor((t1 + 19800) / 60) AS BIGINT) % 1440)"


def _feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.features(track_points(spark, sf_dir), TRACK)


def _segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, SEGMENT_SCHEMA)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {FEATURES_SQL} SELECT camera_id, track_id, day, n, round(dwell, 3) AS dwell, round(net, 6) AS net, round(path, 6) AS path, round(vx, 9) AS vx, round(vy, 9) AS vy FROM feats")
def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feats(spark, sf_dir).select(*TRACK, "n", F.round("dwell", 3).alias("dwell"), "net", "path", F.round("vx", 9).alias("vx"), F.round("vy", 9).alias("vy"))
    return _rounded(f, "net", "path")


@query(f"""WITH {POINTS_SQL}, late AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, day ORDER BY t DESC, seq DESC) AS rn FROM pts),
ends AS (SELECT camera_id, track_id, day, count(*) AS n, max(t) - min(t) AS dt, arg_max(x, t) - arg_min(x, t) AS dx, arg_max(y, t) - arg_min(y, t) AS dy FROM late WHERE rn <= 6 GROUP BY 1, 2, 3)
SELECT camera_id, track_id, day, n, round(CASE WHEN dt > 0 THEN dx / dt ELSE 0 END, 9) AS vx, round(CASE WHEN dt > 0 THEN dy / dt ELSE 0 END, 9) AS vy FROM ends""")
def recent_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tracks.recent_velocity(track_points(spark, sf_dir), 6, TRACK), "vx", "vy", digits=9)


@query(f"""WITH {POINTS_SQL}, sums AS (SELECT camera_id, track_id, day, class_name, sum(CAST(y AS BIGINT)) AS votes, min(seq) AS first FROM pts GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, day ORDER BY votes DESC, first) AS rn FROM sums)
SELECT camera_id, track_id, day, class_name, CAST(votes AS BIGINT) AS votes FROM ranked WHERE rn = 1""")
def class_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.class_vote(track_points(spark, sf_dir), F.col("y").cast("long"), TRACK)


@query(f"""WITH {POINTS_SQL}, {CROSS_SQL}
SELECT camera_id, track_id, day, 'line' AS fence, segment, round(t, 3) AS t, round(px + before / (before - side) * (x - px), 6) AS cx, round(py + before / (before - side) * (y - py), 6) AS cy,
  CASE WHEN before > 0 AND side < 0 THEN 'in' ELSE 'out' END AS direction FROM crossed WHERE rn = 1""")
def fence_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.fence_crossings(track_points(spark, sf_dir), _segments(spark), TRACK)
    return _rounded(found.withColumn("t", F.round("t", 3)), "cx", "cy")


@query(f"WITH {FEATURES_SQL} SELECT camera_id, track_id, day, round(dwell, 3) AS dwell, round(net, 6) AS net FROM feats WHERE dwell >= {DWELL} AND net < {NET}")
def loitering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.loitering(_feats(spark, sf_dir), DWELL, NET)
    return found.select(*TRACK, F.round("dwell", 3).alias("dwell"), F.round("net", 6).alias("net"))


@query(f"""WITH {BASELINE_SQL}, dwells AS (SELECT camera_id, avg(dwell) FILTER (dwell > 0) AS mean_dwell, count(*) AS tracks FROM feats GROUP BY camera_id)
SELECT camera_id, round(baseline, 4) AS baseline, with_flow, against_flow, round(mean_dwell, 3) AS mean_dwell, tracks FROM dwells LEFT JOIN flows USING (camera_id)""")
def camera_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tracks.learn_baseline(_feats(spark, sf_dir))
    return b.select("camera_id", F.round("baseline", 4).alias("baseline"), "with_flow", "against_flow", F.round("mean_dwell", 3).alias("mean_dwell"), "tracks")


@query(f"WITH {FEATURES_SQL} SELECT camera_id, CAST(CAST(floor(t0 / 3600) AS BIGINT) % 24 AS INTEGER) AS hour, count(*) AS tracks FROM feats GROUP BY 1, 2")
def footfall_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.footfall(track_points(spark, sf_dir), TRACK)


@query(f"""WITH {BASELINE_SQL}, turned_all AS (SELECT camera_id, track_id, day, net, (degrees(atan2(vy, vx)) + 360.0) % 360.0 AS heading, baseline FROM feats JOIN flows USING (camera_id) WHERE net >= {MOVE} AND (vx <> 0 OR vy <> 0))
SELECT camera_id, track_id, day, round(heading, 4) AS heading, round(least(abs(heading - baseline), 360.0 - abs(heading - baseline)), 4) AS difference FROM turned_all
WHERE least(abs(heading - baseline), 360.0 - abs(heading - baseline)) >= 90.0""")
def wrong_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feats(spark, sf_dir)
    found = tracks.wrong_direction(f, tracks.learn_baseline(f), MOVE)
    return found.select(*TRACK, F.round("heading", 4).alias("heading"), F.round("difference", 4).alias("difference"))


def _windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOURS, "camera_id long, start int, end int")


OUT_SQL = f"""hours AS (SELECT * FROM (VALUES (0, 360, 1080), (1, 360, 1080), (2, 480, 1020), (3, 1320, 360), (4, 1320, 360)) h(camera_id, start_m, end_m)),
late AS (SELECT f.*, {LOCAL_MINUTE_SQL} AS minute, start_m, end_m FROM feats f JOIN hours USING (camera_id)),
outside AS (SELECT * FROM late WHERE NOT (CASE WHEN start_m < end_m THEN minute >= start_m AND minute < end_m ELSE minute >= start_m OR minute < end_m END))"""


@query(f"WITH {FEATURES_SQL}, {OUT_SQL} SELECT camera_id, track_id, day, CAST(minute AS INTEGER) AS minute FROM outside")
def out_of_hours_ist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.out_of_hours(_feats(spark, sf_dir), _windows(spark)).select(*TRACK, "minute")


#: Groups of tracks (members as camera|track|day) by the closure of closeness at each instant.
_GROUPS_SQL = """gp AS (SELECT CAST(camera_id AS VARCHAR) || '|' || CAST(day AS VARCHAR) AS scope, CAST(camera_id AS VARCHAR) || '|' || CAST(track_id AS VARCHAR) || '|' || CAST(day AS VARCHAR) AS member, t, seq, x, y FROM pts),
sp AS (SELECT scope, min(t) AS t0, max(t) AS t1 FROM gp GROUP BY 1), gr AS (SELECT scope, t0 + unnest(range(CAST(floor((t1 - t0 + 1e-9) / 7200) AS BIGINT) + 1)) * 7200.0::DOUBLE AS mark FROM sp),
lg AS (SELECT scope, member, t, x, y, coalesce(lead(t) OVER w, t) AS t2, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM gp WINDOW w AS (PARTITION BY scope, member ORDER BY t, seq)),
po AS (SELECT l.scope, member, mark, x + CASE WHEN t2 > t THEN (mark - t) / (t2 - t) ELSE 0 END * (x2 - x) AS px, y + CASE WHEN t2 > t THEN (mark - t) / (t2 - t) ELSE 0 END * (y2 - y) AS py FROM lg l JOIN gr g ON g.scope = l.scope AND mark >= t AND mark <= t2 QUALIFY row_number() OVER (PARTITION BY l.scope, member, mark ORDER BY t DESC) = 1),
eg AS (SELECT a.scope, a.mark, a.member AS a, b.member AS b FROM po a JOIN po b ON a.scope = b.scope AND a.mark = b.mark AND a.member <> b.member AND sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 25),
rc AS (SELECT * FROM eg UNION SELECT rc.scope, rc.mark, rc.a, eg.b FROM rc JOIN eg ON eg.scope = rc.scope AND eg.mark = rc.mark AND eg.a = rc.b),
cm AS (SELECT DISTINCT scope, mark, members FROM (SELECT scope, mark, a, list_sort(list(DISTINCT b)) AS members FROM (SELECT * FROM rc UNION SELECT scope, mark, a, a FROM rc) GROUP BY 1, 2, 3)),
gs AS (SELECT scope, members, min(mark) AS first_at, max(mark) AS last_at, max(mark) - min(mark) AS duration FROM cm WHERE len(members) >= {least} GROUP BY 1, 2 HAVING max(mark) - min(mark) >= {persist})"""


def _groups(spark: SparkSession, sf_dir: str, least: int = 3, persist: float = 7200.0) -> DataFrame:
    return grouping.groups(track_points(spark, sf_dir), radius=25.0, min_size=least, persist=persist, step=7200.0, key=TRACK, scope=("camera_id", "day"))


@query(f"WITH RECURSIVE {POINTS_SQL}, {_GROUPS_SQL.format(least=2, persist=0)} SELECT scope, array_to_string(members, ',') AS members, round(first_at, 3) AS first_at, round(last_at, 3) AS last_at, round(duration, 3) AS duration FROM gs")
def group_formation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of tracks that are together, by camera and day."""
    return _groups(spark, sf_dir, 2, 0.0).select("scope", F.array_join("members", ",").alias("members"), *[F.round(c, 3).alias(c) for c in ("first_at", "last_at", "duration")])


_VERDICTS_SQL = f"""{BASELINE_SQL}, {CROSS_SQL}, {OUT_SQL},
hits AS (
  SELECT camera_id, track_id, day, 0 AS rank, 'fence crossed' AS rule, 'crossed line ' || CASE WHEN before > 0 AND side < 0 THEN 'in' ELSE 'out' END AS reason FROM crossed WHERE rn = 1
  UNION ALL SELECT camera_id, track_id, day, 1, 'loitering', 'stayed ' || CAST(CAST(floor(dwell) AS BIGINT) AS VARCHAR) || ' s' FROM feats WHERE dwell >= {DWELL} AND net < {NET}
  UNION ALL SELECT camera_id, track_id, day, 2, 'wrong direction', 'moved against the flow' FROM (SELECT f.*, baseline, (degrees(atan2(vy, vx)) + 360.0) % 360.0 AS heading FROM feats f JOIN flows USING (camera_id) WHERE net >= {MOVE} AND (vx <> 0 OR vy <> 0))
    WHERE least(abs(heading - baseline), 360.0 - abs(heading - baseline)) >= 90.0
  UNION ALL SELECT camera_id, track_id, day, 3, 'out of hours', 'seen at minute ' || CAST(minute AS VARCHAR) FROM outside),
vd AS (SELECT camera_id, track_id, day, coalesce(string_agg(rule, ' + ' ORDER BY rank), '') AS rule_fired, coalesce(string_agg(reason, '; ' ORDER BY rank), '') AS reason, count(rule) AS n_rules
FROM feats LEFT JOIN hits USING (camera_id, track_id, day) GROUP BY camera_id, track_id, day)"""


@query(f"WITH {_VERDICTS_SQL} SELECT * FROM vd")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all trajectories."""
    rows = tracks.rule_table(track_points(spark, sf_dir), _segments(spark), _windows(spark), TRACK, DWELL, NET, MOVE)
    rules = {
        "fence crossed": (F.col("crossed").isNotNull(), F.array_join(F.transform("crossed", lambda d: F.concat(F.lit("crossed line "), d)), "; ")),
        "loitering": (F.col("loitered"), F.concat(F.lit("stayed "), F.floor("dwell").cast("string"), F.lit(" s"))),
        "wrong direction": (F.col("against_flow"), F.lit("moved against the flow")),
        "out of hours": (F.col("outside_hours"), F.concat(F.lit("seen at minute "), F.col("minute").cast("string"))),
    }
    fired = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, (hit, _) in rules.items()]))
    reasons = F.array_compact(F.array(*[F.when(hit, reason) for hit, reason in rules.values()]))
    return rows.select(*TRACK, F.array_join(fired, " + ").alias("rule_fired"), F.array_join(reasons, "; ").alias("reason"), F.size(fired).cast("long").alias("n_rules"))


@query(f"""WITH RECURSIVE {_VERDICTS_SQL}, {_GROUPS_SQL.format(least=2, persist=0)}, me AS (SELECT unnest(members) AS member, members, first_at, 'in a group of ' || len(members) || ' for ' || CAST(CAST(floor(duration) AS BIGINT) AS VARCHAR) || ' s' AS told FROM gs),
tl AS (SELECT member, string_agg(told, '; ' ORDER BY first_at, array_to_string(members, ','), told) AS told FROM me GROUP BY 1)
SELECT camera_id, track_id, day, CASE WHEN told IS NULL THEN rule_fired WHEN rule_fired = '' THEN 'group formed' ELSE rule_fired || ' + group formed' END AS rule_fired, CASE WHEN told IS NULL THEN reason WHEN reason = '' THEN told ELSE reason || '; ' || told END AS reason,
  n_rules + CASE WHEN told IS NULL THEN 0 ELSE 1 END AS n_rules FROM vd LEFT JOIN tl ON member = CAST(camera_id AS VARCHAR) || '|' || CAST(track_id AS VARCHAR) || '|' || CAST(day AS VARCHAR)""")
def camera_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for each track, the group rule's with it."""
    return tracks.with_groups(rule_verdicts(spark, sf_dir), _groups(spark, sf_dir, 2, 0.0), TRACK)


@query(f"""WITH {FEATURES_SQL}, h AS (SELECT *, (degrees(atan2(vy, vx)) + 360.0) % 360.0 AS heading FROM feats WHERE vx <> 0 OR vy <> 0)
SELECT camera_id, track_id, day, CASE WHEN heading < 45 OR heading >= 315 THEN 'ltr' WHEN heading < 135 THEN 'ttb' WHEN heading < 225 THEN 'rtl' ELSE 'btt' END AS direction,
  ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][CAST(floor((heading + 22.5) / 45.0) AS INTEGER) % 8 + 1] AS compass FROM h""")
def direction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feats(spark, sf_dir).filter("vx <> 0 or vy <> 0")
    h = g.heading(F.col("vx"), F.col("vy"))
    return f.select(*TRACK, g.flow_label(h).alias("direction"), g.compass(h).alias("compass"))


@query(f"""WITH {POINTS_SQL}, legs AS (
  SELECT camera_id, track_id, day, t, x, y, coalesce(lead(t) OVER w, t) AS t2, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM pts
  WINDOW w AS (PARTITION BY camera_id, track_id, day ORDER BY t, seq)),
grid AS (SELECT DISTINCT day, epoch_us(day::TIMESTAMP) / 1000000.0::DOUBLE + k * 14400.0::DOUBLE AS mark FROM pts, range(6) r(k)),
met AS (SELECT l.*, mark, CASE WHEN t2 > t THEN (mark - t) / (t2 - t) ELSE 0 END AS share FROM legs l JOIN grid g USING (day) WHERE mark >= t AND mark <= t2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, day, mark ORDER BY t DESC) AS rn FROM met)
SELECT camera_id, track_id, day, mark AS "at", round(x + share * (x2 - x), 6) AS px, round(y + share * (y2 - y), 6) AS py FROM ranked WHERE rn = 1""")
def interpolated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each track is at the four-hourly marks of its day."""
    points = track_points(spark, sf_dir)
    marks = F.explode(F.sequence(F.lit(0), F.lit(5)))
    grid = points.select("day").distinct().select("day", marks.alias("k")).select("day", (F.unix_micros(F.col("day").cast("timestamp")) / 1e6 + F.col("k") * 14400.0).alias("at"))
    return _rounded(tracks.interpolated(points, grid, TRACK, "day"), "px", "py")


_PLANES_SQL = "pl AS (SELECT camera_id, k, [0.05 + k / 100, 0.001, 1.0, 0.002, 0.06, 2.0, 0.0001 * k, 0.0002, 1.0]::DOUBLE[] AS h FROM (SELECT DISTINCT camera_id, camera_id::DOUBLE AS k FROM pts WHERE camera_id % 2 = 0))"


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homographies of the even cameras."""
    k = F.col("camera_id").cast("double")
    numbers = [0.05 + k / 100, F.lit(0.001), F.lit(1.0), F.lit(0.002), F.lit(0.06), F.lit(2.0), 0.0001 * k, F.lit(0.0002), F.lit(1.0)]
    return track_points(spark, sf_dir).filter("camera_id % 2 = 0").select("camera_id").distinct().select("camera_id", F.array(*numbers).alias("homography"))


@query(f"""WITH {FEATURES_SQL}, {_PLANES_SQL}, q AS (SELECT f.*, h, x0 + 1 AS u FROM feats f LEFT JOIN pl USING (camera_id)),
w AS (SELECT *, h[7] * x0 + h[8] * y0 + h[9] AS wa, h[7] * u + h[8] * y0 + h[9] AS wb FROM q),
m AS (SELECT *, net * sqrt(pow((h[1] * u + h[2] * y0 + h[3]) / wb - (h[1] * x0 + h[2] * y0 + h[3]) / wa, 2) + pow((h[4] * u + h[5] * y0 + h[6]) / wb - (h[4] * x0 + h[5] * y0 + h[6]) / wa, 2)) AS net_m FROM w)
SELECT camera_id, track_id, day, round(net, 6) AS net, round(net_m, 6) AS net_m, CASE WHEN net_m IS NULL THEN {NET}::DOUBLE ELSE 3.0::DOUBLE END AS "limit", CASE WHEN net_m IS NULL THEN 'px' ELSE 'm' END AS unit FROM m WHERE dwell >= {DWELL} AND CASE WHEN net_m IS NULL THEN net < {NET} ELSE net_m < 3 END""")
def loitering_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three metres for cameras with a homography, pixels for the others."""
    found = tracks.loitering(_feats(spark, sf_dir), DWELL, NET, 3.0, _planes(spark, sf_dir))
    return found.select(*TRACK, F.round("net", 6).alias("net"), F.round("net_m", 6).alias("net_m"), "limit", "unit")


@query(f"""WITH {POINTS_SQL} SELECT camera_id, seq, count(*) OVER (PARTITION BY camera_id ORDER BY CAST(floor(t) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day,
  count(*) OVER (PARTITION BY camera_id ORDER BY CAST(floor(t) AS BIGINT) RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS last_shift FROM pts""")
def rolling_offer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = track_points(spark, sf_dir).withColumn("second", F.floor("t").cast("long"))
    n = ranging.trailing_counts(points, ["camera_id"], "second", (86400, 43200)).withColumnsRenamed({"n0": "last_day", "n1": "last_shift"})
    return ranging.join_null_safe(points.select("camera_id", "seq", "second"), n, ["camera_id", "second"]).select("camera_id", "seq", "last_day", "last_shift")


@query(f"WITH {POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, day ORDER BY t, seq) AS ordinal FROM pts) SELECT camera_id, track_id, day, seq, ordinal FROM r WHERE ordinal <= 3")
def keyframe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three keyframes a track."""
    n = F.row_number().over(Window.partitionBy(*TRACK).orderBy("t", "seq"))
    return track_points(spark, sf_dir).select(*TRACK, "seq", n.cast("long").alias("ordinal")).filter("ordinal <= 3")


@query(f"""WITH {POINTS_SQL}, span AS (SELECT c_custkey AS camera_id, (SELECT CAST(floor(min(t) / 3600) AS BIGINT) FROM pts) + c_custkey % 5 AS f, (SELECT CAST(floor(max(t) / 3600) AS BIGINT) FROM pts) AS l FROM customer WHERE c_custkey <= 8),
hours AS (SELECT camera_id, unnest(range(f, l + 1)) AS h FROM span), busy AS (SELECT DISTINCT camera_id, CAST(floor(t / 3600) AS BIGINT) AS h FROM pts),
free AS (SELECT * FROM hours a WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.camera_id = a.camera_id AND abs(b.h - a.h) <= 1)), isle AS (SELECT *, h - row_number() OVER (PARTITION BY camera_id ORDER BY h) AS i FROM free)
SELECT camera_id, min(h) AS from_hour, max(h) + 1 AS to_hour, count(*) AS hours FROM isle GROUP BY camera_id, i""")
def empty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of whole hours, an hour away from any point, in which a camera saw nothing; some cameras never do."""
    hour = track_points(spark, sf_dir).select("camera_id", F.floor(F.col("t") / 3600).cast("long").alias("unit"))
    ends = hour.agg(F.min("unit").alias("least"), F.max("unit").alias("last"))
    spans = cameras(spark, sf_dir).filter("id <= 8").join(F.broadcast(ends)).select(F.col("id").alias("camera_id"), (F.col("least") + F.col("id") % 5).alias("first"), "last")
    return ranging.empty_windows(hour, ["camera_id"], spans, 1).select("camera_id", F.col("start").alias("from_hour"), F.col("end").alias("to_hour"), F.col("size").alias("hours"))


@query(f"""WITH {POINTS_SQL}, flagged AS (SELECT camera_id, seq, t, x < 20 AS low, sum(CASE WHEN x < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id ORDER BY t, seq) AS island FROM pts)
SELECT camera_id, seq, round(min(t) OVER (PARTITION BY camera_id, island), 3) AS since FROM flagged WHERE low""")
def frozen_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First moment of the run of low values that a low value belongs to."""
    return ranging.run_start(track_points(spark, sf_dir), F.col("x") < 20, ["camera_id"]).select("camera_id", "seq", F.round("since", 3).alias("since"))


@query(f"""WITH {POINTS_SQL}, marks AS (SELECT camera_id, seq AS event_seq, t FROM pts WHERE class_name = 'purchase' OR class_name = 'error'),
near AS (SELECT m.camera_id, m.event_seq, p.seq FROM marks m JOIN pts p ON m.camera_id = p.camera_id AND p.t BETWEEN m.t - 900 AND m.t + 900)
SELECT camera_id, event_seq, count(*) AS near FROM near GROUP BY 1, 2""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a quarter of an hour of each marked event of the same camera."""
    points = track_points(spark, sf_dir)
    marks = points.filter(F.col("class_name").isin("purchase", "error")).select("camera_id", F.col("seq").alias("event_seq"), "t")
    return ranging.band_join(marks, points.select("camera_id", "seq", "t"), ["camera_id"], "t", 900.0).groupBy("camera_id", "event_seq").agg(F.count(F.lit(1)).alias("near"))


@query(f"""WITH {POINTS_SQL}, scored AS (SELECT *, CASE WHEN class_name = 'view' THEN y END AS score, CASE WHEN class_name = 'view' THEN t END AS score_t FROM pts),
filled AS (SELECT camera_id, seq, t, last_value(score IGNORE NULLS) OVER w AS score, last_value(score_t IGNORE NULLS) OVER w AS score_t FROM scored WINDOW w AS (PARTITION BY camera_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
SELECT camera_id, seq, CASE WHEN t - score_t <= 3600 THEN score END AS score FROM filled""")
def asof_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 'view' score at each point, if not older than an hour."""
    points = track_points(spark, sf_dir)
    return ranging.asof(points, points.filter("class_name = 'view'").select("camera_id", "t", "seq", F.col("y").alias("score")), ["camera_id"], "score", 3600.0).select("camera_id", "seq", "score")


@query("""WITH c AS (SELECT c_custkey AS camera_id, 200.0 + c_custkey % 1800 AS px, c_nationkey * 4.0 + 1 AS metres FROM customer)
SELECT camera_id, metres, round(px / metres, 4) AS px_per_m, CASE WHEN px / metres >= 250 THEN 'identification' WHEN px / metres >= 125 THEN 'recognition' WHEN px / metres >= 62 THEN 'observation' WHEN px / metres >= 25 THEN 'detection' ELSE 'none' END AS band FROM c""")
def dori_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each camera can tell at the distance of its fence, from its pixels per metre at one metre."""
    c = cameras(spark, sf_dir).select(F.col("id").alias("camera_id"), (200.0 + F.col("id") % 1800).alias("px"), (F.col("post_id") * 4.0 + 1).alias("metres"))
    px = F.col("px") / F.col("metres")
    return c.select("camera_id", "metres", F.round(px, 4).alias("px_per_m"), ranging.dori_band(px).alias("band"))


@query(f"""WITH {POINTS_SQL} SELECT seq, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS second, CAST(to_timestamp(t) AT TIME ZONE 'UTC' + INTERVAL 330 MINUTE AS DATE) AS local_day,
  upper(strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%d %b')) || ' · ' || strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%H:%M') AS label,
  CAST(floor(floor(t) / 28800) * 28800 AS BIGINT) AS shift_start, (CAST(floor(t / 60) AS BIGINT) % 1440 >= 1110 OR CAST(floor(t / 60) AS BIGINT) % 1440 < 330) AS night FROM pts""")
def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = timeutil.from_epoch(F.col("t"))
    return track_points(spark, sf_dir).select(
        "seq", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("second"), timeutil.local_day(ts).alias("local_day"), timeutil.clip_label(ts).alias("label"),
        F.unix_timestamp(timeutil.shift_start(ts)).alias("shift_start"), timeutil.is_night(timeutil.minute_of_day(ts)).alias("night"),
    )

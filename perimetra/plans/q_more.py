"""Further queries: late patches, rate limits, hard sets, reconciliation, field summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import datasets, evaluation, serving
from perimetra.plans.bind import POINTS_SQL, alerts, settled, table, track_points
from perimetra.plans.registry import query

_PATCH_SQL = """al AS (SELECT o_orderkey AS id, o_orderstatus AS stage, o_orderpriority AS priority, o_totalprice AS total FROM orders WHERE o_orderkey % 5 <> 0),
pa AS (SELECT o_orderkey - o_orderkey % 3 AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN '1-URGENT' END AS priority, CASE WHEN o_orderkey % 7 = 0 THEN 1.0::DOUBLE END AS total FROM orders)"""


def _patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = alerts(spark, sf_dir).filter("id % 5 <> 0").select("id", "stage", "priority", "total")
    o = table(spark, sf_dir, "orders")
    p = o.select((F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, "1-URGENT").alias("priority"), F.when(F.col("o_orderkey") % 7 == 0, 1.0).alias("total"))
    return serving.apply_patches(a, p, "id", "seq", ["priority", "total"], "F")


@query(f"""WITH {_PATCH_SQL}, l AS (SELECT pa.id, arg_max(pa.priority, seq) FILTER (pa.priority IS NOT NULL) AS p, arg_max(pa.total, seq) FILTER (pa.total IS NOT NULL) AS t FROM pa JOIN al ON al.id = pa.id AND al.stage <> 'F' GROUP BY pa.id)
SELECT al.id, stage, coalesce(p, priority) AS priority, coalesce(t, total) AS total, array_to_string(list_filter([CASE WHEN p IS NOT NULL AND p <> priority THEN 'priority' END, CASE WHEN t IS NOT NULL AND t <> total THEN 'total' END], lambda x: x IS NOT NULL), ',') AS changed FROM al LEFT JOIN l ON l.id = al.id""")
def late_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir)[0].withColumn("changed", F.array_join("changed", ","))


@query(f"WITH {_PATCH_SQL} SELECT pa.id, seq, CASE WHEN al.id IS NULL THEN 'not found' ELSE 'conflict' END AS problem FROM pa LEFT JOIN al ON al.id = pa.id WHERE al.id IS NULL OR al.stage = 'F'")
def refused_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir)[1].select("id", "seq", "problem")


@query(f"WITH {POINTS_SQL} SELECT camera_id, seq, row_number() OVER (PARTITION BY camera_id, floor(t / 3600) ORDER BY t, seq) <= 2 AS allowed FROM pts")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two offers an hour and camera."""
    return serving.rate_limited(track_points(spark, sf_dir), ["camera_id"], 2, 3600).select("camera_id", "seq", "allowed")


@query("""WITH d AS (SELECT doc_id, lang, n_chars FROM documents), tiny AS (SELECT doc_id FROM d WHERE n_chars < 150 ORDER BY doc_id LIMIT 20),
es AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS k, count(*) OVER () AS n FROM d WHERE lang = 'es'), decile AS (SELECT doc_id, n_chars FROM es WHERE k <= greatest(1, n // 10)),
rare AS (SELECT doc_id FROM decile WHERE doc_id NOT IN (SELECT doc_id FROM tiny) ORDER BY n_chars, doc_id LIMIT 30),
short AS (SELECT doc_id FROM d WHERE n_chars < 400 AND doc_id NOT IN (SELECT doc_id FROM tiny) AND doc_id NOT IN (SELECT doc_id FROM rare) ORDER BY doc_id LIMIT 10),
taken AS (SELECT doc_id, 'tiny' AS bucket FROM tiny UNION ALL SELECT doc_id, 'rare' FROM rare UNION ALL SELECT doc_id, 'short' FROM short)
SELECT * FROM taken UNION ALL (SELECT doc_id, 'filler' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM taken) ORDER BY doc_id LIMIT (SELECT 90 - count(*) FROM taken))""")
def hard_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents, the shortest tenth of a language, then short ones that the first bucket left, and others."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    buckets = [("tiny", F.col("n_chars") < 150, 20, ("doc_id",), None), ("rare", F.col("lang") == "es", 30, ("n_chars", "doc_id"), 0.1), ("short", F.col("n_chars") < 400, 10, ("doc_id",), None)]
    return datasets.hard_set(d, buckets, 90, "doc_id").select("doc_id", "bucket")


@query("""WITH m AS (SELECT DISTINCT CAST(doc_id * 2 AS VARCHAR) AS entry FROM labels), f AS (SELECT CAST(doc_id - doc_id % 10 // 9 AS VARCHAR) AS entry, 'p' || CAST(doc_id AS VARCHAR) AS path FROM documents), g AS (SELECT entry, count(*) AS n, min(path) AS path FROM f GROUP BY 1)
SELECT entry, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN path END AS path FROM m LEFT JOIN g USING (entry)""")
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a manifest against files with derived names."""
    m = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).cast("string").alias("entry")).distinct()
    f = table(spark, sf_dir, "documents").select(F.expr("cast(doc_id - (doc_id % 10) div 9 as string)").alias("stem"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))
    return datasets.reconcile(m, f, F.col("stem"))


@query("WITH s AS (SELECT lang AS \"key\", count(*) > 300 AS blocking, CAST(length(lang) AS INTEGER) AS priority, count(*) AS impact FROM documents GROUP BY lang) SELECT * FROM s ORDER BY blocking DESC, priority, impact DESC, \"key\" LIMIT 3")
def reason_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("key")).agg((F.count(F.lit(1)) > 300).alias("blocking"), F.first(F.length("lang")).alias("priority"), F.count(F.lit(1)).alias("impact"))
    return datasets.ranked_reasons(s)


@query(f"""WITH RECURSIVE {POINTS_SQL}, warm AS (SELECT camera_id, min(t) + 86400 AS ready FROM pts WHERE camera_id <> 4 GROUP BY 1), tr AS (SELECT p.camera_id, seq, t, x, y, CASE WHEN track_id % 2 = 0 THEN 'person' ELSE 'vehicle' END AS cls FROM pts p JOIN warm USING (camera_id) WHERE class_name = 'error' AND t >= ready),
fd AS (SELECT camera_id, seq, t, x, y FROM pts WHERE class_name = 'purchase'), pr AS (SELECT tr.camera_id, tr.seq AS i, fd.seq AS j, row_number() OVER (PARTITION BY tr.camera_id ORDER BY abs(fd.t - tr.t), tr.t, tr.seq, fd.seq) AS rn FROM tr JOIN fd ON fd.camera_id = tr.camera_id AND abs(fd.t - tr.t) <= 3600 AND sqrt(pow(fd.x - tr.x, 2) + pow(fd.y - tr.y, 2)) <= 80),
gr AS (SELECT camera_id, rn, i, j, true AS ok, [i] AS ti, [j] AS tj FROM pr WHERE rn = 1 UNION ALL SELECT camera_id, rn, i, j, ok, CASE WHEN ok THEN list_append(ti, i) ELSE ti END, CASE WHEN ok THEN list_append(tj, j) ELSE tj END FROM (SELECT pr.*, ti, tj, NOT list_contains(ti, pr.i) AND NOT list_contains(tj, pr.j) AS ok FROM gr JOIN pr ON pr.camera_id = gr.camera_id AND pr.rn = gr.rn + 1)),
c AS (SELECT tr.camera_id, cls, count(*) AS n, count(g.i) AS detected FROM tr LEFT JOIN (SELECT camera_id, i FROM gr WHERE ok) g ON g.camera_id = tr.camera_id AND g.i = tr.seq GROUP BY 1, 2), x AS (SELECT fd.camera_id, count(*) - (SELECT count(*) FROM gr WHERE gr.camera_id = fd.camera_id AND ok) AS extra FROM fd GROUP BY 1),
w AS (SELECT c.*, extra, n - detected AS missed, (n - detected) / n AS p, 1.959963984540054::DOUBLE AS z FROM c JOIN x USING (camera_id)), b AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS r FROM w)
SELECT camera_id, cls, n, detected, missed, extra, round(p, 6) AS rate, round(greatest(mid - r, 0), 6) AS low, round(least(mid + r, 1), 6) AS high, CASE WHEN mid + r < 0.02 THEN 'meets' WHEN mid - r >= 0.02 THEN 'fails' ELSE 'not shown' END AS verdict FROM b""")
def miss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth events that no detection answers one to one, by camera and class, after a day of warm-up; one camera never got ready."""
    p = settled(track_points(spark, sf_dir))
    truth = p.filter("class_name = 'error'").select("camera_id", F.when(F.col("track_id") % 2 == 0, "person").otherwise("vehicle").alias("cls"), F.col("seq").alias("id"), "t", "x", "y")
    found = p.filter("class_name = 'purchase'").select("camera_id", F.col("seq").alias("id"), "t", "x", "y")
    warm = p.filter("camera_id <> 4").groupBy("camera_id").agg((F.min("t") + 86400).alias("ready"))
    out = evaluation.field_summary(truth, found, ["camera_id"], 3600.0, 80.0, warm)
    return out.select("camera_id", "cls", "n", "detected", "missed", "extra", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")], "verdict")

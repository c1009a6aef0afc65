"""Queries of evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import stats
from perimetra.operators import evaluation, stateful
from perimetra.plans.bind import POINTS_SQL, settled, table, track_points
from perimetra.plans.registry import query

_EVAL_SQL = """
base AS (SELECT l_orderkey AS image, l_returnflag AS cls, l_linenumber + 10 * l_suppkey AS id, l_quantity * 3.0 AS x1, (l_partkey % 150)::DOUBLE AS y1, l_quantity * 3.0 + 20.0 AS x2, (l_partkey % 150) + 30.0 AS y2, l_partkey, l_suppkey, l_linenumber FROM lineitem),
gt AS (SELECT image, cls, id AS gt_id, x1, y1, x2, y2 FROM base WHERE l_linenumber <= 6),
pred AS (SELECT image, cls, id AS pred_id, ((l_partkey * 37 + l_suppkey * 11) % 1000) / 1000.0::DOUBLE AS conf, x1 + (l_partkey % 9) AS x1, y1 + (l_suppkey % 7) AS y1, x2 + (l_partkey % 9) AS x2, y2 + (l_suppkey % 7) AS y2 FROM base WHERE l_linenumber >= 2),
pairs AS (SELECT p.image, p.cls, p.pred_id, p.conf, g.gt_id, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS common,
  (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag FROM pred p JOIN gt g ON p.image = g.image AND p.cls = g.cls),
good AS (SELECT *, common / (ap + ag - common) AS iou FROM pairs WHERE common / (ap + ag - common) >= 0.5),
b1 AS (SELECT *, row_number() OVER (PARTITION BY image, cls, pred_id ORDER BY iou DESC, gt_id) AS r1 FROM good),
b2 AS (SELECT *, row_number() OVER (PARTITION BY image, cls, gt_id ORDER BY conf DESC, pred_id) AS r2 FROM b1 WHERE r1 = 1),
matched AS (SELECT p.image, p.cls, p.pred_id, p.conf, m.gt_id, m.iou FROM pred p LEFT JOIN (SELECT * FROM b2 WHERE r2 = 1) m ON p.image = m.image AND p.cls = m.cls AND p.pred_id = m.pred_id),
n AS (SELECT cls, count(*) AS n_gt FROM gt GROUP BY cls),
cum AS (SELECT m.*, n_gt, row_number() OVER w AS pos, count(gt_id) OVER w AS tp, row_number() OVER w - count(gt_id) OVER w AS fp FROM matched m JOIN n USING (cls) WINDOW w AS (PARTITION BY cls ORDER BY conf DESC, image, pred_id ROWS UNBOUNDED PRECEDING)),
rp AS (SELECT *, tp / n_gt AS recall, tp / (tp + fp) AS prec FROM cum),
env AS (SELECT *, max(prec) OVER (PARTITION BY cls ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM rp)"""
_GRID = [k / 20 for k in range(20)]
_AT_SQL = f"""{_EVAL_SQL}, grid AS (SELECT k / 20.0::DOUBLE AS threshold FROM range(20) r(k)),
pts_at AS (SELECT cls, threshold, max(n_gt) AS n_gt, max(tp) AS tp, max(fp) AS fp FROM env, grid WHERE conf >= threshold GROUP BY 1, 2),
f AS (SELECT *, tp / (tp + fp) AS p, tp / n_gt AS r FROM pts_at), ff AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)"""


def _boxes(spark: SparkSession, sf_dir: str, varied: bool = False) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_quantity") * 3.0, (F.col("l_partkey") % 150).cast("double")
    key = (F.col("l_linenumber") + 10 * F.col("l_suppkey")).cast("long")
    # Heights are all alike, or vary about an edge between size buckets.
    height = 30.0 + F.col("l_partkey") % 5 if varied else F.lit(30.0)
    gt = l.filter("l_linenumber <= 6").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("cls"), key.alias("gt_id"), x.alias("x1"), y.alias("y1"), (x + 20.0).alias("x2"), (y + height).alias("y2"))
    dx, dy = F.col("l_partkey") % 9, F.col("l_suppkey") % 7
    conf = ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1000) / 1000.0
    pred = l.filter("l_linenumber >= 2").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("cls"), key.alias("pred_id"), conf.alias("conf"), (x + dx).alias("x1"), (y + dy).alias("y1"), (x + 20.0 + dx).alias("x2"), (y + height + (F.col("l_suppkey") % 5 if varied else dy)).alias("y2"))
    return gt, pred


def _curves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gt, pred = _boxes(spark, sf_dir)
    matched = settled(evaluation.match(gt, pred))
    return gt, matched, evaluation.curve(matched, gt)


@query(f"WITH {_EVAL_SQL} SELECT image, cls, pred_id, coalesce(gt_id, -1) AS gt_id, round(coalesce(iou, 0), 6) AS iou FROM matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = _boxes(spark, sf_dir)
    return evaluation.match(gt, pred).select("image", "cls", "pred_id", F.coalesce("gt_id", F.lit(-1)).alias("gt_id"), F.round(F.coalesce("iou", F.lit(0.0)), 6).alias("iou"))


@query(f"WITH {_EVAL_SQL} SELECT cls, pos::INTEGER AS pos, tp, fp, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM env")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)[2]
    return c.select("cls", F.col("pos").cast("int").alias("pos"), "tp", "fp", F.round("recall", 6).alias("recall"), F.round("envelope", 6).alias("envelope"))


_AP_SQL = """known AS (SELECT cls, recall AS r, pos AS p, envelope AS v FROM env UNION ALL SELECT cls, 0.0, 0, 1.0 FROM n UNION ALL SELECT cls, 1.0, 1000000000, 0.0 FROM n),
marks AS (SELECT cls, k / 100.0::DOUBLE AS m FROM n, range(101) r(k)), lo AS (SELECT cls, m, arg_max(struct_pack(r := r, v := v), struct_pack(r := r, p := p)) AS a FROM marks JOIN known USING (cls) WHERE r <= m GROUP BY 1, 2),
hi AS (SELECT cls, m, arg_min(struct_pack(r := r, v := v), struct_pack(r := r, p := p)) AS b FROM marks JOIN known USING (cls) WHERE r > m GROUP BY 1, 2),
val AS (SELECT cls, m, CASE WHEN b IS NULL OR b.r = a.r THEN a.v ELSE a.v + (m - a.r) / (b.r - a.r) * (b.v - a.v) END AS v FROM lo LEFT JOIN hi USING (cls, m)), ar AS (SELECT cls, (v + lag(v) OVER (PARTITION BY cls ORDER BY m)) / 2 * 0.01 AS area FROM val),
ap AS (SELECT cls, n_gt, sum(area) AS ap FROM ar JOIN n USING (cls) GROUP BY cls, n_gt)"""


@query(f"WITH {_EVAL_SQL}, {_AP_SQL} SELECT cls, n_gt, round(ap, 6) AS ap FROM ap")
def ap101(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, matched, _ = _curves(spark, sf_dir)
    return evaluation.precision_of(matched, gt).withColumn("ap", F.round("ap", 6))


_SOURCES_SQL = _EVAL_SQL.replace("l_returnflag AS cls", "'s' || CAST(l_orderkey % 5 AS VARCHAR) AS cls")


@query(f"""WITH {_SOURCES_SQL}, {_AP_SQL}, t AS (SELECT *, sum(ap * n_gt) OVER () AS total, sum(n_gt) OVER () AS mass FROM ap), o AS (SELECT *, (total - ap * n_gt) / (mass - n_gt) AS others FROM t), i AS (SELECT *, greatest((others - ap) * n_gt / mass, 0) AS impact FROM o)
SELECT cls AS source, n_gt, round(ap, 6) AS ap, round(others, 6) AS others, round(impact, 6) AS impact, row_number() OVER (ORDER BY round(impact, 12) DESC, cls) = 1 AS worst FROM i""")
def source_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision by source, and which source costs the whole most."""
    source = F.concat(F.lit("s"), (F.col("image") % 5).cast("string"))
    gt, pred = (rows.withColumn("cls", source).withColumn("source", source) for rows in _boxes(spark, sf_dir))
    found = evaluation.by_source(settled(evaluation.match(gt, pred)), gt)
    return found.select("source", "n_gt", *[F.round(c, 6).alias(c) for c in ("ap", "others", "impact")], "worst")


@query(f"WITH {_AT_SQL} SELECT cls, threshold, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM ff")
def pr_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, matched, _ = _curves(spark, sf_dir)
    p = evaluation.at_thresholds(matched, gt, _GRID)
    return p.select("cls", "threshold", "tp", "fp", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(f"WITH {_AT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(f1, 12) DESC, threshold) AS k FROM ff) SELECT cls, threshold, round(f1, 6) AS f1 FROM r WHERE k = 1")
def f1_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, matched, _ = _curves(spark, sf_dir)
    return evaluation.best_f1(evaluation.at_thresholds(matched, gt, _GRID)).select("cls", "threshold", F.round("f1", 6).alias("f1"))


_LIMITS = (0.1, 0.2, 0.3, 0.45)
_KEPT_SQL = f"""base AS (SELECT l_orderkey % 3000 AS image, l_returnflag AS cls, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_quantity * 1.5 AS x1, (l_partkey % 60)::DOUBLE AS y1, l_quantity * 1.5 + 20.0 AS x2, (l_partkey % 60) + 30.0 AS y2, l_partkey, l_suppkey, l_linenumber FROM lineitem),
gt AS (SELECT image, cls, id AS gt_id, x1, y1, x2, y2 FROM base WHERE l_linenumber <= 6),
pred AS (SELECT image, cls, id AS pred_id, ((l_partkey * 37 + l_suppkey * 11) % 1000) / 1000.0::DOUBLE AS conf, x1 + (l_partkey % 9) AS x1, y1 + (l_suppkey % 7) AS y1, x2 + (l_partkey % 9) AS x2, y2 + (l_suppkey % 7) AS y2 FROM base WHERE l_linenumber >= 2),
lim AS (SELECT unnest([0.1, 0.2, 0.3, 0.45]::DOUBLE[]) AS lim), pr AS (SELECT pred.*, lim, row_number() OVER (PARTITION BY image, cls, lim ORDER BY conf DESC, pred_id, x1, y1, x2, y2) AS rn FROM pred, lim),
s AS (SELECT image, cls, lim, rn, pred_id, conf, x1, y1, x2, y2, true AS stays, [struct_pack(a := x1, b := y1, c := x2, d := y2)] AS kept FROM pr WHERE rn = 1
  UNION ALL SELECT image, cls, lim, rn, pred_id, conf, x1, y1, x2, y2, stays, CASE WHEN stays THEN list_append(kept, struct_pack(a := x1, b := y1, c := x2, d := y2)) ELSE kept END FROM (
    SELECT pr.*, s.kept, len(list_filter(s.kept, lambda k: greatest(least(pr.x2, k.c) - greatest(pr.x1, k.a), 0) * greatest(least(pr.y2, k.d) - greatest(pr.y1, k.b), 0)
      > pr.lim * greatest((pr.x2 - pr.x1) * (pr.y2 - pr.y1) + (k.c - k.a) * (k.d - k.b) - greatest(least(pr.x2, k.c) - greatest(pr.x1, k.a), 0) * greatest(least(pr.y2, k.d) - greatest(pr.y1, k.b), 0), 1e-12) + 1e-9)) = 0 AS stays
    FROM s JOIN pr ON pr.image = s.image AND pr.cls = s.cls AND pr.lim = s.lim AND pr.rn = s.rn + 1))"""
_POINTS_SQL = f"""{_KEPT_SQL}, p AS (SELECT * FROM s WHERE stays), pairs AS (SELECT p.lim, p.image, p.cls, p.pred_id, p.conf, g.gt_id, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS common, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag FROM p JOIN gt g ON p.image = g.image AND p.cls = g.cls),
b1 AS (SELECT *, row_number() OVER (PARTITION BY lim, image, cls, pred_id ORDER BY common / (ap + ag - common) DESC, gt_id) AS r1 FROM pairs WHERE common / (ap + ag - common) >= 0.5),
b2 AS (SELECT *, row_number() OVER (PARTITION BY lim, image, cls, gt_id ORDER BY conf DESC, pred_id) AS r2 FROM b1 WHERE r1 = 1),
m AS (SELECT p.lim, p.cls, p.conf, b.gt_id FROM p LEFT JOIN (SELECT * FROM b2 WHERE r2 = 1) b USING (lim, image, cls, pred_id)), n AS (SELECT cls, count(*) AS n_gt FROM gt GROUP BY cls), grid AS (SELECT k / 20.0::DOUBLE AS threshold FROM range(20) r(k)),
c AS (SELECT cls, lim, threshold, n_gt, count(gt_id) AS tp, count(*) - count(gt_id) AS fp FROM m JOIN n USING (cls), grid WHERE conf >= threshold GROUP BY 1, 2, 3, 4),
g AS (SELECT cls, lim AS "limit", threshold, n_gt, tp, fp, n_gt - tp AS fn, tp / (tp + fp) AS precision, tp / n_gt AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / n_gt) / (tp / (tp + fp) + tp / n_gt) ELSE 0 END AS f1, fp / 3000.0::DOUBLE AS fp_per_frame FROM c)"""


def _crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth and predictions, some of which overlap, of 3,000 frames."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_quantity") * 1.5, (F.col("l_partkey") % 60).cast("double")
    key = (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).cast("long")
    image = (F.col("l_orderkey") % 3000).alias("image")
    gt = l.filter("l_linenumber <= 6").select(image, F.col("l_returnflag").alias("cls"), key.alias("gt_id"), x.alias("x1"), y.alias("y1"), (x + 20.0).alias("x2"), (y + 30.0).alias("y2"))
    dx, dy = F.col("l_partkey") % 9, F.col("l_suppkey") % 7
    conf = ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1000) / 1000.0
    return gt, l.filter("l_linenumber >= 2").select(image, F.col("l_returnflag").alias("cls"), key.alias("pred_id"), conf.alias("conf"), (x + dx).alias("x1"), (y + dy).alias("y1"), (x + 20.0 + dx).alias("x2"), (y + 30.0 + dy).alias("y2"))


@query(f"WITH RECURSIVE {_KEPT_SQL} SELECT image, cls, pred_id, array_to_string(list_sort(list(lim)), ',') AS limits FROM s WHERE stays GROUP BY 1, 2, 3")
def nms_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap limits under which suppression keeps each prediction, in one pass."""
    pred = _crowded(spark, sf_dir)[1].withColumnsRenamed({"pred_id": "id", "conf": "score"})
    return stateful.nms_grid(pred, ["image", "cls"], _LIMITS).select("image", "cls", F.col("id").alias("pred_id"), F.array_join(F.transform("limits", lambda v: v.cast("string")), ",").alias("limits"))


@query(f"""WITH RECURSIVE {_POINTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(f1, 9) DESC, fp_per_frame, "limit", threshold) AS k FROM g)
SELECT cls, "limit", threshold, n_gt, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fp_per_frame, 6) AS fp_per_frame FROM k WHERE k = 1""")
def grid_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence and suppression limit with the largest f1 of each class; of equals the fewest false positives, the
    smallest limit, the smallest confidence."""
    gt, pred = _crowded(spark, sf_dir)
    points = evaluation.limit_grid(gt, pred, _LIMITS, _GRID, 3000)
    best = evaluation.best_point(points, [-F.round("f1", 9), F.col("fp_per_frame"), F.col("limit"), F.col("threshold")])
    return best.select("cls", "limit", "threshold", "n_gt", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fp_per_frame")])


@query(f"""WITH {_AT_SQL}, cut AS (SELECT cls, CASE cls WHEN 'A' THEN 0.02::DOUBLE WHEN 'N' THEN 0.0025::DOUBLE ELSE 0.00001::DOUBLE END AS allowed FROM (SELECT DISTINCT cls FROM ff)),
lv AS (SELECT ff.*, allowed * 15000 AS most, allowed, CASE WHEN fp > allowed * 15000 + 1e-9 THEN 0 WHEN fp = 0 AND 3.0 <= allowed * 15000 THEN 2
  WHEN fp > 0 AND list_sum(list_transform(range(CAST(fp AS BIGINT) + 1), lambda i: exp(-(allowed * 15000) + i * ln(allowed * 15000) - lgamma(i + 1)))) <= 0.05 THEN 2 ELSE 1 END AS level FROM ff JOIN cut USING (cls)),
k AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY level DESC, CASE WHEN level > 0 THEN -r ELSE fp END, CASE WHEN level > 0 THEN fp ELSE -r END, threshold DESC) AS k FROM lv)
SELECT cls, CASE level WHEN 2 THEN 'met' WHEN 1 THEN 'unresolvable' ELSE 'unreachable' END AS status, n_gt > 0 AND tp = 0 AS vacuous, threshold, round(r, 6) AS recall, fp FROM k WHERE k = 1""")
def false_alert_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of each class: one that can be shown to be met, one that may be, one out of reach."""
    gt, matched, _ = _curves(spark, sf_dir)
    points = evaluation.at_thresholds(matched, gt, _GRID)
    found = None
    for cls, allowed in (("A", 0.02), ("N", 0.0025), ("R", 0.00001)):
        own = evaluation.budget_point(points.filter(F.col("cls") == cls), 15000, allowed)
        found = own if found is None else found.unionByName(own)
    return found.select("cls", "status", "vacuous", "threshold", F.round("recall", 6).alias("recall"), "fp")


_TEN_SQL = _EVAL_SQL.split("pairs AS")[0] + """
g2 AS (SELECT *, CASE WHEN image % 2 = 0 THEN 'day' ELSE 'night' END AS slice FROM gt WHERE NOT (image % 2 = 1 AND cls = 'R')), p2 AS (SELECT *, CASE WHEN image % 2 = 0 THEN 'day' ELSE 'night' END AS slice FROM pred),
overs AS (SELECT p.slice, p.image, p.cls, p.pred_id, p.conf, g.gt_id, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS common,
  (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag FROM p2 p JOIN g2 g ON p.slice = g.slice AND p.image = g.image AND p.cls = g.cls),
ths AS (SELECT k / 100.0::DOUBLE AS th FROM range(50, 100, 5) r(k)),
oks AS (SELECT *, common / (ap + ag - common) AS iou FROM overs, ths WHERE common / (ap + ag - common) >= th),
m1 AS (SELECT *, row_number() OVER (PARTITION BY th, slice, image, cls, pred_id ORDER BY iou DESC, gt_id) AS r1 FROM oks),
m2 AS (SELECT *, row_number() OVER (PARTITION BY th, slice, image, cls, gt_id ORDER BY conf DESC, pred_id) AS r2 FROM m1 WHERE r1 = 1),
mt AS (SELECT p.slice, p.image, p.cls, p.pred_id, p.conf, ths.th, m.gt_id FROM p2 p CROSS JOIN ths LEFT JOIN (SELECT * FROM m2 WHERE r2 = 1) m ON m.th = ths.th AND p.slice = m.slice AND p.image = m.image AND p.cls = m.cls AND p.pred_id = m.pred_id),
n AS (SELECT slice, cls, count(*) AS n_gt FROM g2 GROUP BY 1, 2),
cum AS (SELECT m.slice, m.cls, m.th, n_gt, row_number() OVER w AS pos, count(gt_id) OVER w AS tp FROM mt m JOIN n USING (slice, cls) WINDOW w AS (PARTITION BY slice, cls, th ORDER BY conf DESC, image, pred_id ROWS UNBOUNDED PRECEDING)),
env AS (SELECT *, tp / n_gt AS recall, max(tp / pos) OVER (PARTITION BY slice, cls, th ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM cum),
keys AS (SELECT slice, cls, th FROM n, ths),
known AS (SELECT slice, cls, th, recall AS r, pos AS p, envelope AS v FROM env UNION ALL SELECT slice, cls, th, 0.0, 0, 1.0 FROM keys UNION ALL SELECT slice, cls, th, 1.0, 1000000000, 0.0 FROM keys),
marks AS (SELECT k / 100.0::DOUBLE AS m FROM range(101) r(k)),
lo AS (SELECT slice, cls, th, m, arg_max(struct_pack(r := r, v := v), struct_pack(r := r, p := p)) AS a FROM known JOIN marks ON r <= m GROUP BY 1, 2, 3, 4),
hi AS (SELECT slice, cls, th, m, arg_min(struct_pack(r := r, v := v), struct_pack(r := r, p := p)) AS b FROM known JOIN marks ON r > m GROUP BY 1, 2, 3, 4),
val AS (SELECT slice, cls, th, m, CASE WHEN b IS NULL OR b.r = a.r THEN a.v ELSE a.v + (m - a.r) / (b.r - a.r) * (b.v - a.v) END AS v FROM lo LEFT JOIN hi USING (slice, cls, th, m)),
ar AS (SELECT slice, cls, th, (v + lag(v) OVER (PARTITION BY slice, cls, th ORDER BY m)) / 2 * 0.01 AS area FROM val),
aps AS (SELECT slice, cls, th, sum(area) AS ap FROM ar GROUP BY 1, 2, 3),
both_ap AS (SELECT slice, cls, max(ap) FILTER (th = 0.5) AS ap50, avg(ap) AS ap50_95 FROM aps GROUP BY 1, 2),
rows_ap AS (SELECT c.slice, c.cls, coalesce(n_gt, 0) AS n_gt, CASE WHEN n_gt > 0 THEN coalesce(ap50, 0) END AS ap50, CASE WHEN n_gt > 0 THEN coalesce(ap50_95, 0) END AS ap50_95 FROM (SELECT DISTINCT slice, cls FROM p2) c LEFT JOIN n USING (slice, cls) LEFT JOIN both_ap USING (slice, cls))"""


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("image") % 2 == 0, "day").otherwise("night").alias("slice")
    gt, pred = (b.select("*", name) for b in _boxes(spark, sf_dir))
    return evaluation.average_precisions(gt.filter("not (slice = 'night' and cls = 'R')"), pred, ["slice", "cls"], settle=settled)


@query(f"WITH {_TEN_SQL} SELECT slice, cls, n_gt, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95 FROM rows_ap")
def ap_ten_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP50 and AP50-95 of each slice and class, null for a class without ground truth."""
    return _sliced(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("ap50", "ap50_95")})


@query(f"WITH {_TEN_SQL} SELECT slice, count(*) FILTER (n_gt > 0) AS classes, round(avg(ap50), 6) AS ap50, round(avg(ap50_95), 6) AS ap50_95 FROM rows_ap GROUP BY slice")
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the classes that a slice has ground truth for."""
    return evaluation.mean_over_present(_sliced(spark, sf_dir), ["slice"], ["ap50", "ap50_95"]).withColumns({c: F.round(c, 6) for c in ("ap50", "ap50_95")})


@query()
def bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of AP when confidences are rounded to tenths, paired by cluster; its draws have no SQL form."""
    gt, matched, _ = _curves(spark, sf_dir)
    cluster = (F.col("image") % 50).alias("cluster")
    rounded = matched.withColumn("conf", F.floor(F.col("conf") * 10) / 10)
    return evaluation.bootstrap_delta(matched.select("*", cluster), rounded.select("*", cluster), gt.select("*", cluster), "cluster", 100)


@query()
def bootstrap_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster bootstrap; its draws have no SQL form."""
    gt, matched, _ = _curves(spark, sf_dir)
    cluster = (F.col("image") % 50).alias("cluster")
    return evaluation.bootstrap_ap(matched.select("*", cluster), gt.select("*", cluster), "cluster", 100)


@query("SELECT o_orderkey, CAST(CASE WHEN o_totalprice / 5000 >= sqrt(77.0 * 54) THEN 0 WHEN o_totalprice / 5000 >= sqrt(54.0 * 38) THEN 1 WHEN o_totalprice / 5000 >= sqrt(38.0 * 27) THEN 2 WHEN o_totalprice / 5000 >= sqrt(27.0 * 19) THEN 3 WHEN o_totalprice / 5000 >= sqrt(19.0 * 14) THEN 4 WHEN o_totalprice / 5000 >= sqrt(14.0 * 9) THEN 5 ELSE 6 END AS INTEGER) AS bucket FROM orders")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluation.size_bucket(F.col("o_totalprice") / 5000).alias("bucket"))


_SIZED_SQL = """
base AS (SELECT l_orderkey AS image, l_returnflag AS cls, (l_linenumber + 10 * l_suppkey)::BIGINT AS id, l_quantity * 3.0 AS x1, (l_partkey % 150)::DOUBLE AS y1, l_quantity * 3.0 + 20.0 AS x2, (l_partkey % 150) + 30.0 + l_partkey % 5 AS y2, l_partkey, l_suppkey, l_linenumber FROM lineitem),
gt AS (SELECT image, cls, id AS gt_id, x1, y1, x2, y2, (y2 - y1 < sqrt(38.0 * 27) AND y2 - y1 >= sqrt(27.0 * 19)) AS inside FROM base WHERE l_linenumber <= 6),
pred AS (SELECT image, cls, id AS pred_id, ((l_partkey * 37 + l_suppkey * 11) % 1000) / 1000.0::DOUBLE AS conf, x1 + (l_partkey % 9) AS x1, y1 + (l_suppkey % 7) AS y1, x2 + (l_partkey % 9) AS x2, y2 + (l_suppkey % 5) AS y2 FROM base WHERE l_linenumber >= 2),
sized AS (SELECT *, (y2 - y1 < sqrt(38.0 * 27) AND y2 - y1 >= sqrt(27.0 * 19)) AS p_inside FROM pred),
over AS (SELECT p.image, p.cls, pred_id, conf, gt_id, inside, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS common, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (g.x2 - g.x1) * (g.y2 - g.y1) AS ag FROM sized p JOIN gt g ON p.image = g.image AND p.cls = g.cls),
pairs AS (SELECT *, common / (ap + ag - common) AS iou FROM over WHERE common / (ap + ag - common) >= 0.5),
a1 AS (SELECT *, row_number() OVER (PARTITION BY image, cls, pred_id ORDER BY iou DESC, gt_id) AS k FROM pairs WHERE inside),
a2 AS (SELECT *, row_number() OVER (PARTITION BY image, cls, gt_id ORDER BY conf DESC, pred_id) AS m FROM a1 WHERE k = 1),
own AS (SELECT image, cls, pred_id, gt_id FROM a2 WHERE m = 1),
b1 AS (SELECT p.*, row_number() OVER (PARTITION BY image, cls, pred_id ORDER BY iou DESC, gt_id) AS k FROM pairs p ANTI JOIN own USING (image, cls, pred_id) WHERE NOT inside),
b2 AS (SELECT *, row_number() OVER (PARTITION BY image, cls, gt_id ORDER BY conf DESC, pred_id) AS m FROM b1 WHERE k = 1),
spare AS (SELECT image, cls, pred_id FROM b2 WHERE m = 1)"""


@query(f"""WITH {_SIZED_SQL} SELECT p.image, p.cls, p.pred_id, coalesce(o.gt_id, -1) AS gt_id, (o.gt_id IS NULL AND (s.pred_id IS NOT NULL OR NOT p_inside)) AS ignored
FROM sized p LEFT JOIN own o ON p.image = o.image AND p.cls = o.cls AND p.pred_id = o.pred_id LEFT JOIN spare s ON p.image = s.image AND p.cls = s.cls AND p.pred_id = s.pred_id""")
def sized_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching within one size bucket, the rest of the ground truth ignored."""
    gt, pred = _boxes(spark, sf_dir, varied=True)
    found = evaluation.match_sized(gt, pred, 3)
    return found.select("image", "cls", "pred_id", F.coalesce("gt_id", F.lit(-1)).alias("gt_id"), "ignored")


_PLATES_SQL = "pl AS (SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS reference, CASE WHEN event_id % 3 = 0 THEN substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) ELSE substr(sha256(CAST(user_id AS VARCHAR)), 1, CAST(event_id % 8 AS INTEGER)) || substr(sha256(CAST(event_id % 4 AS VARCHAR)), 1, 8 - CAST(event_id % 8 AS INTEGER)) END AS hypothesis, value AS width FROM events)"


def _plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ref = F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 8)
    mixed = F.expr("concat(substr(sha2(cast(user_id as string), 256), 1, cast(event_id % 8 as int)), substr(sha2(cast(event_id % 4 as string), 256), 1, 8 - cast(event_id % 8 as int)))")
    return e.select("event_id", ref.alias("reference"), F.when(F.col("event_id") % 3 == 0, ref).otherwise(mixed).alias("hypothesis"), F.col("value").alias("width"))


@query(f"WITH {_PLATES_SQL} SELECT CASE WHEN width >= 200 THEN 'wide' WHEN width >= 120 THEN 'middle' ELSE 'narrow' END AS bucket, count(*) AS n, round(avg(CASE WHEN reference = hypothesis THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact, round(avg(levenshtein(reference, hypothesis) / 8.0::DOUBLE), 6) AS cer FROM pl GROUP BY 1")
def cer_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plates(spark, sf_dir)
    bucket = F.when(F.col("width") >= 200, "wide").when(F.col("width") >= 120, "middle").otherwise("narrow")
    same = (F.col("reference") == F.col("hypothesis")).cast("double")
    return p.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("exact"), F.round(F.avg(evaluation.character_errors(F.col("reference"), F.col("hypothesis"))), 6).alias("cer"))


@query(f"WITH {_PLATES_SQL}, c AS (SELECT substr(reference, i, 1) AS ref_char, substr(hypothesis, i, 1) AS hyp_char FROM pl, range(1, 9) r(i) WHERE reference <> hypothesis AND length(hypothesis) = 8) SELECT ref_char, hyp_char, count(*) AS n FROM c WHERE ref_char <> hyp_char GROUP BY 1, 2 HAVING count(*) >= 2")
def confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusions(_plates(spark, sf_dir))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@query("WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), w AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c) SELECT source, k, n, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 0), 6) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 1), 6) AS high FROM w")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    c = j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("source", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH RECURSIVE {POINTS_SQL}, n AS (SELECT camera_id, count(*) AS k, count(DISTINCT day) AS days FROM pts WHERE class_name = 'error' GROUP BY 1), g AS (SELECT *, k + 10 * sqrt(k + 1) + 20 AS top FROM n),
s AS (SELECT camera_id, k, days, 0 AS step, 0.0::DOUBLE AS la, top::DOUBLE AS lb, 0.0::DOUBLE AS ha, top::DOUBLE AS hb FROM g
  UNION ALL SELECT camera_id, k, days, step + 1, CASE WHEN 1 - below_l > 0.025 THEN la ELSE (la + lb) / 2 END, CASE WHEN 1 - below_l > 0.025 THEN (la + lb) / 2 ELSE lb END, CASE WHEN below_h > 0.025 THEN (ha + hb) / 2 ELSE ha END, CASE WHEN below_h > 0.025 THEN hb ELSE (ha + hb) / 2 END
  FROM (SELECT *, list_sum(list_transform(range(k), lambda i: exp(-(la + lb) / 2 + i * ln((la + lb) / 2) - lgamma(i + 1)))) AS below_l, list_sum(list_transform(range(k + 1), lambda i: exp(-(ha + hb) / 2 + i * ln((ha + hb) / 2) - lgamma(i + 1)))) AS below_h FROM s WHERE step < 90))
SELECT camera_id, k, days, round(k / days, 6) AS rate, round((la + lb) / 2 / days, 6) AS low, round((ha + hb) / 2 / days, 6) AS high FROM s WHERE step = 90""")
def poisson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts per camera and day with exact intervals."""
    p = track_points(spark, sf_dir).filter("class_name = 'error'")
    n = p.groupBy("camera_id").agg(F.count(F.lit(1)).alias("k"), (F.count_distinct("day")).alias("days"))
    ci = n.withColumn("ci", stats.poisson_columns(F.col("k")))
    per_day = {"rate": F.col("k"), "low": F.col("ci.low"), "high": F.col("ci.high")}
    return ci.select("camera_id", "k", "days", *[F.round(v / F.col("days"), 6).alias(name) for name, v in per_day.items()])


@query(f"""WITH {POINTS_SQL}, f AS (SELECT camera_id, min(t) AS t0, max(t) AS t1 FROM pts GROUP BY 1), g AS (SELECT camera_id, unnest(range(1, CAST(floor((t1 - t0) / 86400) AS BIGINT) + 1)) AS bucket FROM f),
c AS (SELECT camera_id, CAST(ceil((t - t0) / 86400) AS BIGINT) AS bucket, count(*) AS n FROM pts JOIN f USING (camera_id) WHERE t > t0 GROUP BY 1, 2) SELECT camera_id, bucket, round(coalesce(n, 0) / 86400.0::DOUBLE, 9) AS rate FROM g LEFT JOIN c USING (camera_id, bucket)""")
def window_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.window_rate(track_points(spark, sf_dir), 86400.0, ["camera_id"]).withColumn("rate", F.round("rate", 9))


@query("""WITH n AS (SELECT source AS metric, count(*) / 100.0::DOUBLE AS value FROM documents WHERE source <> 'src3' GROUP BY 1), b AS (SELECT source AS metric, count(*) FILTER (lang = 'en') / 60.0::DOUBLE AS value FROM documents WHERE source <> 'src5' GROUP BY 1)
SELECT metric, CASE WHEN n.value IS NULL THEN 'missing' WHEN b.value IS NULL THEN 'new' WHEN n.value < b.value - 0.01 THEN 'regressed' ELSE 'ok' END AS status FROM n FULL JOIN b USING (metric)""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    now = d.filter("source <> 'src3'").groupBy(F.col("source").alias("metric")).agg((F.count(F.lit(1)) / 100.0).alias("value"))
    was = d.filter("source <> 'src5'").groupBy(F.col("source").alias("metric")).agg((F.count_if(F.col("lang") == "en") / 60.0).alias("value"))
    return evaluation.compare_to_baseline(now, was, "metric", 0.01).select("metric", "status")


@query("""WITH k AS (SELECT DISTINCT lang, CAST(doc_id AS VARCHAR) AS k, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS part FROM documents), p AS (SELECT lang, part, sha256(string_agg(k, chr(10) ORDER BY k)) AS h, count(*) AS n FROM k GROUP BY 1, 2)
SELECT lang, sha256(string_agg(h, chr(10) ORDER BY part)) AS digest, sum(n)::BIGINT AS n FROM p GROUP BY lang""")
def set_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.set_identity(table(spark, sf_dir, "documents"), "doc_id", ["lang"])


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(source), 1, 1))::INTEGER % 2 = 0 THEN 'tune' ELSE 'report' END AS half FROM documents")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.half(F.col("source")).alias("half"))


@query("""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') / count(*) AS ap FROM documents GROUP BY 1), t AS (SELECT *, sum(ap * n) OVER () AS total, sum(n) OVER () AS mass FROM s), o AS (SELECT *, (total - ap * n) / (mass - n) AS others FROM t)
SELECT source, round(others, 6) AS others, round((others - ap) * n / mass, 6) AS impact, CASE WHEN ap >= 0.6 AND ap - 0.05 >= 0.6 THEN 'MET' WHEN ap >= 0.6 THEN 'PARTIAL' ELSE 'NOT MET' END AS verdict FROM o""")
def source_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("lang") == "en") / F.count(F.lit(1))).alias("ap"))
    w = evaluation.weighted_others(s, "source", "ap", "n")
    return w.select("source", F.round("others", 6).alias("others"), F.round("impact", 6).alias("impact"), evaluation.verdict(F.col("ap"), F.lit(0.6), F.col("ap") - 0.05).alias("verdict"))


@query(f"""WITH {POINTS_SQL}, med AS (SELECT camera_id, class_name, quantile_cont(x, 0.5) AS m, count(*) AS n FROM pts GROUP BY 1, 2), dev AS (SELECT camera_id, class_name, quantile_cont(abs(x - m), 0.5) AS mad FROM pts JOIN med USING (camera_id, class_name) GROUP BY 1, 2), fr AS (SELECT camera_id, count(DISTINCT t) AS frames FROM pts GROUP BY 1),
own AS (SELECT camera_id, class_name, n, CASE WHEN n >= greatest(5, frames // 10) THEN greatest(0.35::DOUBLE, m + 4 * 1.4826::DOUBLE * mad) END AS tau FROM med JOIN dev USING (camera_id, class_name) JOIN fr USING (camera_id)),
cam AS (SELECT camera_id, quantile_cont(tau, 0.5) AS camera_tau FROM own GROUP BY 1) SELECT camera_id, class_name, n, round(coalesce(tau, camera_tau, 0.35), 6) AS tau FROM own JOIN cam USING (camera_id)""")
def cell_thresholds_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust threshold of each cell."""
    from perimetra.operators import calibration

    p = track_points(spark, sf_dir).withColumnRenamed("class_name", "cell").withColumn("energy", F.col("x"))
    t = calibration.cell_thresholds(p, ["camera_id"], ["cell"], least=5)
    return t.select("camera_id", F.col("cell").alias("class_name"), F.col("samples").alias("n"), F.round("tau", 6).alias("tau"))

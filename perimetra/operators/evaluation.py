"""Detection metrics and statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.functions import geometry as g
from perimetra.functions import stats
from perimetra.operators import stateful
from perimetra.sources.store import dealt, settled, tasks_for

BOX = ("x1", "y1", "x2", "y2")
#: The ten overlaps that AP50-95 averages.
TEN = tuple(k / 100 for k in range(50, 100, 5))
#: Edges between size buckets, largest first, as geometric means of neighbouring levels in pixels.
SIZE_LEVELS = (77, 54, 38, 27, 19, 14, 9)


def size_bucket(height: Column, levels: Sequence[int] = SIZE_LEVELS) -> Column:
    """Index of the level nearest in ratio; the last for all that is smaller."""
    out = F.lit(len(levels) - 1)
    for i in reversed(range(len(levels) - 1)):
        out = F.when(height >= (levels[i] * levels[i + 1]) ** 0.5, i).otherwise(out)
    return out


def match(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions (image, cls, pred_id, conf, box) with gt_id, null if unmatched, and iou.

    Among pairs of one image and class with enough overlap, each prediction keeps its best ground truth, then each
    ground truth its most confident prediction; ties go to smaller ids.
    """
    tasks = tasks_for(gt, pred)
    pairs = _overlapping(gt, pred, threshold, tasks)
    return _one_to_one(pred, pairs, ["image", "cls"], tasks)


def _overlapping(gt: DataFrame, pred: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """Predictions with each ground truth of their image and class that they overlap enough: gt_id, iou."""
    key = ["image", "cls"]
    a = dealt(gt.select(*key, "gt_id", *[F.col(c).alias(f"g{c}") for c in BOX]), tasks, *key)
    over = g.iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"g{c}") for c in BOX))
    return dealt(pred, tasks, *key).join(a, key).withColumn("iou", over).filter(F.col("iou") >= threshold)


def _one_to_one(pred: DataFrame, pairs: DataFrame, key: Sequence[str], tasks: int) -> DataFrame:
    """Predictions with gt_id and iou of the pair that is left to them, of pairs within the groups of `key`."""
    best = F.row_number().over(Window.partitionBy(*key, "pred_id").orderBy(F.desc("iou"), "gt_id"))
    first = F.row_number().over(Window.partitionBy(*key, "gt_id").orderBy(F.desc("conf"), "pred_id"))
    own = pairs.withColumn("rn", best).filter("rn = 1").withColumn("rn", first).filter("rn = 1").select(*key, "pred_id", "gt_id", "iou")
    return dealt(pred, tasks, *key, "pred_id").join(dealt(own, tasks, *key, "pred_id"), [*key, "pred_id"], "left")


def match_sized(gt: DataFrame, pred: DataFrame, bucket: int, threshold: float = 0.5) -> DataFrame:
    """As `match`, within one size bucket: gt_id is of that bucket's ground truth only, and `ignored` marks predictions
    that count neither as right nor as wrong.

    A prediction without a partner in the bucket is ignored if it then finds one among the other ground truth, or if its
    own height is of another bucket. Heights are y2 - y1; a null height is of no bucket.
    """
    inside = F.coalesce(size_bucket(F.col("y2") - F.col("y1")) == bucket, F.lit(False)) & F.col("y1").isNotNull() & F.col("y2").isNotNull()
    found = match(gt.filter(inside), pred, threshold).withColumn("outside", ~inside)
    rest = found.filter("gt_id is null").drop("gt_id", "iou", "outside")
    spare = match(gt.filter(~inside), rest, threshold).filter("gt_id is not null").select("image", "cls", "pred_id").distinct().withColumn("elsewhere", F.lit(True))
    ignored = F.col("gt_id").isNull() & (F.coalesce("elsewhere", F.lit(False)) | F.col("outside"))
    return found.join(spare, ["image", "cls", "pred_id"], "left").withColumn("ignored", ignored).drop("elsewhere", "outside")


def curve(matched: DataFrame, gt: DataFrame, by: Sequence[str] = ("cls",), bins: int = 1000) -> DataFrame:
    """Per prediction in falling confidence: tp, fp so far, recall, precision and its envelope.

    Confidences are cut into ranges of 1 / bins; counts run within a range, on top of the totals of the ranges above, so
    that a class is not ordered in one task.
    """
    n = gt.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt"))
    ranged = [*by, "range"]
    tasks = tasks_for(matched)
    rows = matched.join(F.broadcast(n), list(by)).select(*by, "image", "pred_id", "conf", "n_gt", F.floor(F.col("conf") * bins).alias("range"), F.col("gt_id").isNotNull().cast("long").alias("hit"))
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*ranged).agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("rows"))
    totals = totals.select(*ranged, F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"), F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("rows_above"))
    order = Window.partitionBy(*ranged).orderBy(F.desc("conf"), "image", "pred_id")
    placed = dealt(rows, tasks, *ranged).select("*", F.row_number().over(order).alias("own_pos"), F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("own_hits"))
    placed = _join_ranges(placed, F.broadcast(totals), by)
    placed = placed.select(*ranged, "image", "pred_id", "conf", "n_gt", (F.col("own_pos") + F.col("rows_above")).alias("pos"), (F.col("own_hits") + F.col("hits_above")).alias("tp"))
    placed = placed.withColumn("fp", F.col("pos") - F.col("tp")).withColumn("recall", F.col("tp") / F.col("n_gt")).withColumn("precision", F.col("tp") / F.col("pos"))
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    best = placed.groupBy(*ranged).agg(F.max("precision").alias("best")).select(*ranged, F.max("best").over(below).alias("best_below"))
    # Falling positions: a frame that only grows is kept up row by row, one that shrinks is computed anew for each.
    after = Window.partitionBy(*ranged).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_ranges(placed.withColumn("own_best", F.max("precision").over(after)), F.broadcast(best), by)
    return out.select(*by, "image", "pred_id", "conf", "n_gt", "pos", "tp", "fp", "recall", "precision", F.greatest("own_best", "best_below").alias("envelope"))


def _join_ranges(rows: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their range; ranges of null keys or confidences are ranges, too."""
    keys = [*by, "range"]
    other = totals.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in totals.columns if c not in keys])
    met = F.lit(True)
    for c in keys:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(other, met).drop(*[f"__{c}" for c in keys])


def average_precision(curves: DataFrame, gt: DataFrame, by: Sequence[str] = ("cls",), predicted: DataFrame | None = None) -> DataFrame:
    """AP by the area under the envelope at 101 recalls, linearly interpolated: null without ground truth, 0 without predictions.

    predicted: rows whose keys get a row even where there is no ground truth.

    Between two marks only the curve's last point up to the upper one and its first point above the lower one matter;
    both are plain aggregates, and windows run over the marks alone.
    """
    known = curves.select(*by, _mark(F.col("recall")).alias("mark"), F.struct(F.col("recall").alias("r"), F.col("pos").cast("long").alias("p"), F.col("envelope").alias("v")).alias("at"))
    ranges = known.groupBy(*by, "mark").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    return _area(ranges, gt, by, predicted)


def _mark(recall: Column) -> Column:
    """The least of 101 marks that is not below a recall."""
    near = F.ceil(recall * 100)
    return F.when((near - 1) / 100.0 >= recall, near - 1).when(near / 100.0 < recall, near + 1).otherwise(near).cast("int")


def _area(ranges: DataFrame, gt: DataFrame, by: Sequence[str], predicted: DataFrame | None) -> DataFrame:
    """`average_precision` from the first and last point (r, p, v) of a curve up to each mark."""

    def point(mark: Column, r: float | None, p: int | None, v: float | None) -> Column:
        at = F.struct(F.lit(r).cast("double").alias("r"), F.lit(p).cast("long").alias("p"), F.lit(v).cast("double").alias("v"))
        at = F.when(F.lit(r is not None), at)
        return F.struct(mark.cast("int").alias("mark"), at.alias("last"), at.alias("first"))

    # The curve begins at recall 0 with precision 1 and ends at recall 1 with precision 0. A class has at most 101 ranges.
    own = F.collect_list(F.struct("mark", "last", "first"))
    marks = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: point(k, None, None, None))
    every = F.concat("own", F.array(point(F.lit(0), 0.0, 0, 1.0), point(F.lit(100), 1.0, 1 << 60, 0.0)), marks)
    both = ranges.groupBy(*by).agg(own.alias("own")).select(*by, F.explode(every).alias("m"))
    both = both.groupBy(*by, F.col("m.mark").alias("mark")).agg(F.max("m.last").alias("last"), F.min("m.first").alias("first"))
    rising, falling = Window.partitionBy(*by).orderBy("mark"), Window.partitionBy(*by).orderBy(F.desc("mark"))
    both = both.withColumn("lo", F.max("last").over(rising.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.min("first").over(falling.rowsBetween(Window.unboundedPreceding, -1)))
    low, high, r = F.col("lo"), F.col("hi"), F.col("mark") / 100.0
    value = F.when(high["r"].isNull() | (high["r"] == low["r"]), low["v"]).otherwise(low["v"] + (r - low["r"]) / (high["r"] - low["r"]) * (high["v"] - low["v"]))
    area = (F.col("v") + F.lag("v").over(rising)) / 2 * 0.01
    ap = both.select(*by, "mark", value.alias("v")).withColumn("area", area).groupBy(*by).agg(F.sum("area").alias("ap"))
    n = gt.select(*by, F.lit(1).alias("one"))
    n = n if predicted is None else n.unionByName(predicted.select(*by).distinct().withColumn("one", F.lit(0)))
    n = n.groupBy(*by).agg(F.sum("one").alias("n_gt"))
    return n.join(ap, list(by), "left").select(*by, "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def _hits_at(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float], key: Sequence[str]) -> DataFrame:
    """Predictions (key, pred_id, conf) with hits, the thresholds at which each is right (null for none).

    Boxes meet once, at the lowest threshold; each pair then stands for the thresholds that its overlap reaches. A
    prediction's best partner is the same at all of them, so only who gets a ground truth is decided for each.
    """
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    a = gt.select(*key, "gt_id", *[F.col(c).alias(f"g{c}") for c in BOX])
    over = g.iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"g{c}") for c in BOX))
    pairs = pred.join(a, list(key)).withColumn("iou", over).filter(F.col("iou") >= min(thresholds))
    best = pairs.groupBy(*key, "pred_id").agg(F.max_by(F.struct("gt_id", "iou", "conf"), F.struct("iou", -F.col("gt_id"))).alias("m")).select(*key, "pred_id", "m.*")
    reached = best.withColumn("threshold", F.explode(F.filter(grid, lambda t: F.col("iou") >= t)))
    own = reached.groupBy(*key, "gt_id", "threshold").agg(F.max_by("pred_id", F.struct("conf", -F.col("pred_id"))).alias("pred_id"))
    hits = own.groupBy(*key, "pred_id").agg(F.collect_set("threshold").alias("hits"))
    return pred.select(*key, "pred_id", "conf").join(hits, [*key, "pred_id"], "left")


def match_at(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float], key: Sequence[str] = ("image", "cls")) -> DataFrame:
    """Predictions (key, pred_id, conf) once for each threshold, with hit: as `match` at that threshold."""
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    spread = _hits_at(gt, pred, thresholds, key).withColumn("threshold", F.explode(grid))
    return spread.select(*key, "pred_id", "conf", "threshold", F.coalesce(F.array_contains("hits", F.col("threshold")), F.lit(False)).alias("hit"))


def precisions_of(rows: DataFrame, gt: DataFrame, hits: Sequence[str], by: Sequence[str] = ("cls",), predicted: DataFrame | None = None, bins: int = 1000) -> DataFrame:
    """by, hits (a name of `hits`), n_gt, ap: `average_precision` of the `curve` of each of several matchings of the same
    predictions (image, pred_id, conf and for each matching a long, 1 where it is right).

    Predictions are ordered once for all matchings. Of the points up to a mark only the ends and the best precision are
    kept, plain numbers, from which the envelope at the ends follows; no curve is written. Totals, a row for each class and
    range, are broadcast.
    """
    n = gt.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt"))
    ranged = [*by, "range"]
    tasks = tasks_for(rows)
    rows = rows.join(F.broadcast(n.select(*by)), list(by), "left_semi").select(*by, "image", "pred_id", "conf", F.floor(F.col("conf") * bins).alias("range"), *hits)
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*ranged).agg(F.count(F.lit(1)).alias("pos"), *[F.sum(h).alias(h) for h in hits])
    totals = totals.select(*ranged, *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("pos", *hits)]).join(n, list(by))
    order = Window.partitionBy(*ranged).orderBy(F.desc("conf"), "image", "pred_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(rows, tasks, *ranged).select(*ranged, F.row_number().over(order).alias("pos"), *[F.sum(h).over(upto).alias(h) for h in hits])
    placed = _join_ranges(placed, F.broadcast(totals), by)
    pos = F.col("pos") + F.col("pos_above")
    each = F.array(*[F.struct(F.lit(h).alias("hits"), (F.col(h) + F.col(f"{h}_above")).alias("tp")) for h in hits])
    points = placed.select(*by, "n_gt", pos.alias("pos"), F.explode(each).alias("m")).select(*by, "n_gt", "pos", "m.hits", "m.tp", _mark(F.col("m.tp") / F.col("n_gt")).alias("mark"))
    keys = [*by, "hits"]
    # A bucket is a stretch of positions, as recall never falls.
    ends = points.groupBy(*keys, "n_gt", "mark").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.min("tp").alias("t0"), F.max("tp").alias("t1"), F.max(F.col("tp") / F.col("pos")).alias("best"))
    after = F.max("best").over(Window.partitionBy(*keys).orderBy(F.desc("mark")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("after", after)
    at = lambda t, p, v: F.struct((F.col(t) / F.col("n_gt")).alias("r"), F.col(p).cast("long").alias("p"), F.greatest(v, F.col("after")).alias("v"))
    ranges = ends.select(*keys, "mark", at("t1", "p1", F.col("t1") / F.col("p1")).alias("last"), at("t0", "p0", F.col("best")).alias("first"))
    names = F.explode(F.array(*[F.lit(h) for h in hits])).alias("hits")
    return _area(ranges, gt.select(*by, names), keys, None if predicted is None else predicted.select(*by).distinct().select(*by, names))


def precision_of(matched: DataFrame, gt: DataFrame, by: Sequence[str] = ("cls",)) -> DataFrame:
    """by, n_gt, ap of the predictions that `match` gives."""
    return precisions_of(matched.withColumn("hit", F.col("gt_id").isNotNull().cast("long")), gt, ["hit"], by).drop("hits")


def average_precisions(gt: DataFrame, pred: DataFrame, by: Sequence[str] = ("cls",), thresholds: Sequence[float] = TEN, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """by, n_gt, ap50 and ap50_95 (the mean over `thresholds`; the first is 0.5): null without ground truth.

    settle: writes the matches out, which are read several times.
    """
    key = list(dict.fromkeys(["image", "cls", *by]))
    names = {f"t{k}": float(t) for k, t in enumerate(sorted(thresholds))}
    flags = [F.coalesce(F.array_contains("hits", F.lit(t)), F.lit(False)).cast("long").alias(h) for h, t in names.items()]
    met = settle(_hits_at(gt, pred, thresholds, key).select(*key, "pred_id", "conf", *flags))
    ap = precisions_of(met, gt, list(names), by, met)
    return ap.groupBy(*by).agg(F.max("n_gt").alias("n_gt"), F.max(F.when(F.col("hits") == "t0", F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))


def mean_over_present(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over the classes that have ground truth, and how many they are; null where none has."""
    present = F.col("n_gt") > 0
    return rows.groupBy(*by).agg(F.count_if(present).alias("classes"), *[F.avg(F.when(present, F.col(v))).alias(v) for v in values])


def at_thresholds(matched: DataFrame, gt: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("cls",)) -> DataFrame:
    """tp, fp, precision, recall and f1 of the predictions with conf >= each threshold that some prediction reaches.

    Predictions are counted once, by the highest threshold that they reach; only these counts are summed up again.
    """
    return _points_at(matched, gt.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt")), thresholds, by)


def _points_at(matched: DataFrame, n: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """`at_thresholds` where the ground truth is counted (by, n_gt)."""
    grid = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    reached = matched.select(*by, F.size(F.filter(grid, lambda t: F.col("conf") >= t)).alias("reached"), F.col("gt_id").isNotNull().cast("long").alias("hit")).filter("reached > 0")
    counts = reached.groupBy(*by, "reached").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fp"))
    hit = counts.select(*by, "tp", "fp", F.explode(F.slice(grid, F.lit(1), F.col("reached"))).alias("threshold"))
    rows = hit.groupBy(*by, "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).join(n, list(by)).select(*by, "threshold", "n_gt", "tp", "fp")
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n_gt")
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def best_f1(points: DataFrame, by: Sequence[str] = ("cls",)) -> DataFrame:
    """The threshold with the largest f1, the smallest of equals."""
    return points.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(F.round("f1", 12), -F.col("threshold"))).alias("b")).select(*by, "b.*")


def limit_grid(gt: DataFrame, pred: DataFrame, limits: Sequence[float], confs: Sequence[float], frames: int, by: Sequence[str] = ("cls",), threshold: float = 0.5) -> DataFrame:
    """`at_thresholds` for every overlap limit of suppression: by, limit, threshold, n_gt, tp, fp, fn, precision, recall, f1,
    fp_per_frame. Boxes (image, cls, pred_id, conf, x1, y1, x2, y2) are suppressed once for all limits."""
    kept = stateful.nms_grid(pred.select("image", "cls", F.col("pred_id").alias("id"), *BOX, F.col("conf").alias("score")), ["image", "cls"], limits)
    kept = settled(kept.withColumnsRenamed({"id": "pred_id", "score": "conf"}))
    # A box that stays under several limits meets the ground truth once.
    each = lambda rows: rows.withColumn("limit", F.explode("limits")).drop("limits")
    tasks = tasks_for(gt, kept)
    matched = _one_to_one(each(kept), each(_overlapping(gt, kept, threshold, tasks)), ["limit", "image", "cls"], tasks)
    many = gt.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt")).withColumn("limit", F.explode(F.array(*[F.lit(float(v)) for v in sorted(limits)])))
    points = _points_at(matched, many, confs, [*by, "limit"])
    return points.withColumn("fn", F.col("n_gt") - F.col("tp")).withColumn("fp_per_frame", F.col("fp") / frames)


def best_point(points: DataFrame, order: Sequence[Column], by: Sequence[str] = ("cls",)) -> DataFrame:
    """The point of each group that comes first by all of `order`, in turn."""
    return points.groupBy(*by).agg(F.min_by(F.struct(*[c for c in points.columns if c not in by]), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("b")).select(*by, "b.*")


def budget_point(points: DataFrame, images: int, allowed: float, by: Sequence[str] = ("cls",)) -> DataFrame:
    """The point of `at_thresholds` that keeps false positives per image within `allowed`, and how sure that is.

    met: the one-sided 95 % upper bound of the count fits the budget; of such points the one with most recall, then
    fewest false positives, then the highest threshold. unresolvable: only the count itself fits. unreachable: not even
    that; the point with fewest false positives. vacuous: there is ground truth and nothing of it is found. frames_needed:
    images that would have to be seen, without a further false positive, to meet the budget (0 if met, null if unreachable).
    """
    most = allowed * images
    within = F.col("fp") <= most + 1e-9
    fits = within & F.when(F.col("fp") == 0, F.lit(stats.RULE_OF_THREE <= most)).otherwise(stats.poisson_below(F.col("fp"), most) <= stats.TAIL)
    level = F.when(fits, 2).when(within, 1).otherwise(0)
    recall, fewest = F.col("recall").cast("double"), (-F.col("fp")).cast("double")
    first, second = F.when(level > 0, recall).otherwise(fewest), F.when(level > 0, fewest).otherwise(recall)
    chosen = F.max_by(F.struct(level.alias("level"), "threshold", "recall", "tp", "fp", "n_gt"), F.struct(level, first, second, "threshold")).alias("b")
    point = points.groupBy(*by).agg(chosen).select(*by, "b.*")
    status = F.when(F.col("level") == 2, "met").when(F.col("level") == 1, "unresolvable").otherwise("unreachable")
    needed = F.when(F.col("level") == 2, 0).when(F.col("level") == 1, F.ceil(stats.poisson_uppers(F.col("fp")) / allowed))
    return point.select(*by, status.alias("status"), ((F.col("n_gt") > 0) & (F.col("tp") == 0)).alias("vacuous"), "threshold", "recall", "fp", needed.cast("long").alias("frames_needed"))


def single_modality(images: DataFrame, slice_col: str = "slice", modality: str = "modality") -> DataFrame:
    """The images; an error if a slice blends modalities."""
    n = F.size(F.collect_set(modality).over(Window.partitionBy(slice_col)))
    return images.withColumn("__n", F.assert_true(n <= 1, F.lit("a slice holds more than one modality"))).filter(F.col("__n").isNull()).drop("__n")


def _cluster_counts(matched: DataFrame, gt: DataFrame, cluster: str, by: Sequence[str]) -> DataFrame:
    """by, cluster, conf, hits, misses, n_gt: predictions counted by confidence, and rows of conf -1 that count the ground truth."""
    hit = F.col("gt_id").isNotNull().cast("long")
    zero = F.lit(0).cast("long")
    own = matched.groupBy(*by, F.col(cluster).alias("cluster"), "conf").agg(F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses")).withColumn("n_gt", zero)
    base = gt.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n_gt")).withColumn("conf", F.lit(-1.0)).withColumn("hits", zero).withColumn("misses", zero)
    return own.unionByName(base)


def bootstrap_ap(matched: DataFrame, gt: DataFrame, cluster: str, replicates: int = 200, seed: str = "boot", by: Sequence[str] = ("cls",), level: float = 0.95) -> DataFrame:
    """Percentile interval of AP over replicates that weight whole clusters by hash-seeded Poisson draws; null below 20 valid ones.

    Replicates see counts by cluster and confidence only; predictions of one confidence stand together.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = stats.poisson_bootstrap_ap(pdf, replicates, f"{seed}:{key}")
        values = values[np.isfinite(values)]
        low, high = stats.percentile_interval(values, level)
        return pd.DataFrame([(*key, len(values), low, high)], columns=[*by, "replicates", "low", "high"])

    kinds = ", ".join(f"{c} {matched.schema[c].dataType.simpleString()}" for c in by)
    return _cluster_counts(matched, gt, cluster, by).groupBy(*by).applyInPandas(one, f"{kinds}, replicates long, low double, high double")


def bootstrap_delta(before: DataFrame, after: DataFrame, gt: DataFrame, cluster: str, replicates: int = 200, seed: str = "delta", by: Sequence[str] = ("cls",), level: float = 0.95) -> DataFrame:
    """Change of AP between two models' matches of the same images and its percentile interval: both get the same weights in
    each replicate. Null below 20 replicates that are valid for both."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[(pdf["model"] == m) | (pdf["conf"] < 0)] for m in (0, 1)]
        first, second = (stats.poisson_bootstrap_ap(p, replicates, f"{seed}:{key}") for p in parts)
        values = (second - first)[np.isfinite(first) & np.isfinite(second)]
        low, high = stats.percentile_interval(values, level)
        delta = float(stats.plain_ap(parts[1]) - stats.plain_ap(parts[0]))
        return pd.DataFrame([(*key, len(values), delta, low, high)], columns=[*by, "replicates", "delta", "low", "high"])

    rows = [_cluster_counts(m, gt, cluster, by).withColumn("model", F.lit(k)) for k, m in enumerate((before, after))]
    both = rows[0].unionByName(rows[1].filter("conf >= 0"))
    kinds = ", ".join(f"{c} {before.schema[c].dataType.simpleString()}" for c in by)
    return both.groupBy(*by).applyInPandas(one, f"{kinds}, replicates long, delta double, low double, high double")


def character_errors(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance over the reference's length; an empty reference gives 0 if the hypothesis is empty, else 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def confusions(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Characters read wrongly at their own place in wrong readings of equal length: reference, hypothesis characters, count."""
    wrong = pairs.filter((F.col("reference") != F.col("hypothesis")) & (F.length("reference") == F.length("hypothesis")))
    at = F.explode(F.arrays_zip(F.split("reference", "").alias("r"), F.split("hypothesis", "").alias("h")))
    return wrong.select(at.alias("c")).select(F.col("c.r").alias("ref_char"), F.col("c.h").alias("hyp_char")).filter("ref_char <> hyp_char").groupBy("ref_char", "hyp_char").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def latency(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, p50, p95, p99, max with linear interpolation."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), *[F.percentile(value, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.max(value).alias("max"))


def window_rate(rows: DataFrame, width: float, by: Sequence[str]) -> DataFrame:
    """Rows per second in windows (start, end] from each group's first stamp on; empty windows give 0, the last partial one is left out."""
    first = rows.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = first.withColumn("whole", F.floor((F.col("t1") - F.col("t0")) / width)).filter("whole > 0").select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))).alias("bucket"))
    n = rows.join(first, list(by)).filter("t > t0").groupBy(*by, F.ceil((F.col("t") - F.col("t0")) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [*by, "bucket"], "left").select(*by, "bucket", (F.coalesce("n", F.lit(0)) / width).alias("rate"))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Full comparison of metrics (key, value): ok, regressed, new, or missing, which fails."""
    both = current.select(key, F.col("value").alias("now")).join(baseline.select(key, F.col("value").alias("was")), key, "full")
    return both.withColumn("status", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") < F.col("was") - tolerance, "regressed").otherwise("ok"))


def set_identity(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Digest of a set of names, whatever their order. Names are first digested into 256 ordered parts, so no task holds them all."""
    part = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2)
    parts = rows.select(*by, F.col(key).cast("string").alias("k"), part.alias("part")).distinct().groupBy(*by, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"), F.sum("n").alias("n"))


def half(key: Column) -> Column:
    """A fixed half of all clusters for tuning, the other for the report."""
    return F.when(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 1), 16, 10).cast("int") % 2 == 0, "tune").otherwise("report")


def by_source(matched: DataFrame, gt: DataFrame, source: str = "source") -> DataFrame:
    """source, n_gt, ap, others, impact, worst: the average precision of each source's own images, that of all others weighted
    by their ground truth, what the source costs the whole, and which source costs most (of equals the first by name; none
    where there are fewer than two)."""
    ap = precision_of(matched, gt, [source]).filter("n_gt > 0 and ap is not null").select(source, "n_gt", "ap")
    rows = weighted_others(ap, source, "ap", "n_gt").withColumn("impact", F.greatest(F.col("impact"), F.lit(0.0)))
    every = Window.partitionBy(F.lit(1))  # a row for each source
    first = F.row_number().over(every.orderBy(F.desc(F.round("impact", 12)), source)) == 1
    return rows.withColumn("worst", first & (F.count(F.lit(1)).over(every) > 1))


#: Share of missed events that a summary aims below.
MISS_TARGET = 0.02


def miss_verdict(low: Column, high: Column, n: Column, target: float = MISS_TARGET) -> Column:
    """What the interval of a miss rate says of the target."""
    return F.when(n == 0, "none to miss").when(high < target, "meets").when(low >= target, "fails").otherwise("not shown")


def field_summary(truth: DataFrame, found: DataFrame, by: Sequence[str], tolerance: float, reach: float | None = None, warm: DataFrame | None = None, cls: str = "cls", target: float = MISS_TARGET) -> DataFrame:
    """by, cls, n, detected, missed, rate, low, high, verdict and, for each group, extra: detections that match nothing.

    truth: by, cls, id, t (and x, y); found: by, id, t (and x, y). Truth before its group's warm-up ended (warm: by, ready;
    groups without a row never got ready) does not count, but what was detected does. Truth and detections are matched one
    to one, nearest in time first. low and high are Wilson's interval of the missed share.
    """
    known = truth if warm is None else truth.join(warm, list(by)).filter(F.col("t") >= F.col("ready")).drop("ready")
    taken = settled(stateful.match_nearest(known, found, by, tolerance, reach))
    hits = taken.select(*by, F.col("truth_id").alias("id"), F.lit(1).alias("hit"))
    counts = known.join(hits, [*by, "id"], "left").groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("detected")).withColumn("missed", F.col("n") - F.col("detected"))
    used = taken.groupBy(*by).agg(F.count(F.lit(1)).alias("used"))
    extra = found.groupBy(*by).agg(F.count(F.lit(1)).alias("all")).join(used, list(by), "left").select(*by, (F.col("all") - F.coalesce("used", F.lit(0))).alias("extra"))
    low, high = stats.wilson(F.col("missed"), F.col("n"))
    rows = counts.join(extra, list(by), "left").withColumns({"rate": F.col("missed") / F.col("n"), "low": low, "high": high, "extra": F.coalesce("extra", F.lit(0))})
    return rows.withColumn("verdict", miss_verdict(F.col("low"), F.col("high"), F.col("n"), target))


def weighted_others(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Each row's value against the weighted mean of all others, and its impact."""
    all_rows = Window.partitionBy(F.lit(1))
    total, mass = F.sum(F.col(value) * F.col(weight)).over(all_rows), F.sum(weight).over(all_rows)
    others = (total - F.col(value) * F.col(weight)) / F.nullif(mass - F.col(weight), F.lit(0))
    return rows.withColumn("others", others).withColumn("impact", (F.col("others") - F.col(value)) * F.col(weight) / mass)


def verdict(value: Column, target: Column, low: Column | None = None) -> Column:
    """MET, PARTIAL (met, but not by the interval's lower end), NOT MET, or NOT ASSESSED."""
    low = low if low is not None else value
    return F.when(value.isNull(), "NOT ASSESSED").when((value >= target) & (low >= target), "MET").when(value >= target, "PARTIAL").otherwise("NOT MET")

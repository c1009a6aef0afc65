"""Range, as-of and gap operators, by equi-joins on buckets and by windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pixels per metre from which each band can be told, best first.
DORI = (("identification", 250.0), ("recognition", 125.0), ("observation", 62.0), ("detection", 25.0))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, width: float) -> DataFrame:
    """Pairs of equal keys whose times differ by at most `width`: rows of `left` are spread over three buckets, so the join is an equi-join."""
    other = right.withColumnRenamed(time, "__t").withColumn("__b", F.floor(F.col("__t") / width))
    spread = left.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(time) / width) + k)))
    return spread.join(other, [*keys, "__b"]).filter(F.abs(F.col(time) - F.col("__t")) <= width).drop("__b").withColumnRenamed("__t", f"{time}_right")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, max_age: float | None = None) -> DataFrame:
    """Each left row (keys, t, seq) with the latest right value at or before it in (t, seq) order, null beyond max_age."""
    a = left.withColumn("__is", F.lit(True)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__vt", F.lit(None).cast("double")).drop(value)
    b = right.select(*keys, "t", "seq", F.lit(False).alias("__is"), F.col(value).alias("__v"), F.col("t").alias("__vt"))
    order = Window.partitionBy(*keys).orderBy("t", "seq", "__is").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order)).withColumn("__at", F.last("__vt", ignorenulls=True).over(order))
    fresh = F.lit(True) if max_age is None else (F.col("t") - F.col("__at") <= max_age)
    return both.filter("__is").withColumn(value, F.when(fresh, F.col("__last"))).drop("__is", "__v", "__vt", "__last", "__at")


def empty_windows(rows: DataFrame, keys: Sequence[str], spans: DataFrame, margin: int = 0) -> DataFrame:
    """Stretches of units (column unit) without rows: keys, start (first empty), end (first that is not), size.

    spans: keys, first, last: the units that a key could have rows in. Stretches before the first row, after the last and of
    keys without rows come out too. Units within `margin` of one with rows are not empty.
    """
    busy = rows.select(*keys, "unit").distinct().join(spans, list(keys)).select(*keys, (F.col("unit") - margin).alias("low"), (F.col("unit") + margin).alias("high"), "first", "last")
    before = spans.select(*keys, (F.col("first") - 1).alias("low"), (F.col("first") - 1).alias("high"), "first", "last")
    after = spans.select(*keys, (F.col("last") + 1).alias("low"), (F.col("last") + 1).alias("high"), "first", "last")
    order = Window.partitionBy(*keys).orderBy("low", "high")
    past = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = busy.unionByName(before).unionByName(after).withColumn("start", F.greatest(past + 1, F.col("first"))).withColumn("end", F.least(F.col("low"), F.col("last") + 1))
    return stretch.withColumn("size", F.col("end") - F.col("start")).filter("size > 0").select(*keys, "start", "end", "size")


def trailing_counts(rows: DataFrame, keys: Sequence[str], on: str, widths: Sequence[float]) -> DataFrame:
    """keys, on, n0, n1, ...: for each value of `on` and each width w, how many rows of its key lie in [on - w, on].

    A count is a difference of two running totals: that of the value and that below its lower end. Totals run within blocks
    of the longest width, on top of the blocks before, so that work grows with the rows and not with the rows of a window.
    Rows without a value count each other.
    """
    every = rows.groupBy(*keys, on).agg(F.count(F.lit(1)).alias("__n"))
    own, without = every.filter(F.col(on).isNotNull()), every.filter(F.col(on).isNull())
    # Lower ends come before rows of their value, which belong to the window.
    marks = [F.struct((F.col(on) - w).alias("at"), F.lit(k).alias("is"), F.lit(0).cast("long").alias("n")) for k, w in enumerate(widths)]
    marks.append(F.struct(F.col(on).alias("at"), F.lit(len(widths)).alias("is"), F.col("__n").alias("n")))
    dealt = own.select(*keys, on, F.explode(F.array(*marks)).alias("m")).select(*keys, on, "m.*").withColumn("__b", F.floor(F.col("at") / max(widths)))
    block = [*keys, "__b"]
    above = F.sum("n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy(*block).agg(F.sum("n").alias("n")).select(*block, F.coalesce(above, F.lit(0)).alias("__above"))
    running = F.sum("n").over(Window.partitionBy(*block).orderBy("at", "is").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_null_safe(dealt.select(*block, on, "is", running.alias("__own")), totals, block).withColumn("__sum", F.col("__own") + F.col("__above"))
    at = lambda k: F.max(F.when(F.col("is") == k, F.col("__sum")))
    counted = placed.groupBy(*keys, on).agg(*[(at(len(widths)) - at(k)).alias(f"n{k}") for k in range(len(widths))])
    return counted.unionByName(without.select(*keys, on, *[F.col("__n").alias(f"n{k}") for k in range(len(widths))]))


def join_null_safe(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the other's columns; nulls of the keys meet, too."""
    right = other.select(*[F.col(c).alias(f"__{c}__") for c in keys], *[c for c in other.columns if c not in keys])
    met = F.lit(True)
    for c in keys:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}__"))
    return rows.join(right, met).drop(*[f"__{c}__" for c in keys])


def run_start(rows: DataFrame, condition: Column, keys: Sequence[str]) -> DataFrame:
    """Rows that meet the condition, with `since`, the first time of the unbroken run they belong to."""
    order = Window.partitionBy(*keys).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__hit", condition).withColumn("__island", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(order)).filter("__hit")
    return marked.withColumn("since", F.min("t").over(Window.partitionBy(*keys, "__island"))).drop("__hit", "__island")


def dori_band(px_per_m: Column) -> Column:
    out = F.lit("none")
    for name, least in reversed(DORI):
        out = F.when(px_per_m >= least, name).otherwise(out)
    return out


def on_plane(h: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Metres on the ground of a pixel, by a homography of nine numbers in row order; null on the horizon."""
    w = F.nullif(h[6] * u + h[7] * v + h[8], F.lit(0.0))
    return (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w


def dori_capability(cameras: DataFrame) -> DataFrame:
    """camera_id, status, and for each band the farthest range at which the picture still has its pixels per metre (0 if nowhere).

    cameras: camera_id, homography (nine numbers), width, height, trusted. The rows of the picture's middle column are
    walked from the lowest on; range 0 is the lowest row. A camera whose homography is not trusted is refused: its ranges
    are null.
    """
    middle, low = F.col("width") / 2.0, (F.col("height") - 1).cast("double")
    rows = cameras.filter("trusted").select("camera_id", "homography", middle.alias("u"), low.alias("low"), F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("row"))
    h, v = F.col("homography"), F.col("row").cast("double")
    (x0, y0), (x, y), (x1, y1) = (on_plane(h, F.col("u"), at) for at in (F.col("low"), v, v + 1))
    step, away = F.hypot(x1 - x, y1 - y), F.hypot(x - x0, y - y0)
    seen = rows.select("camera_id", F.when(step > 0, 1 / step).alias("px_per_m"), away.alias("range_m"))
    far = seen.groupBy("camera_id").agg(*[F.coalesce(F.max(F.when(F.col("px_per_m") >= least, F.col("range_m"))), F.lit(0.0)).alias(band) for band, least in DORI])
    return cameras.select("camera_id", F.when(F.col("trusted"), "graded").otherwise("refused").alias("status")).join(far, "camera_id", "left")


def capability_at(range_m: Column) -> Column:
    """The strictest band of `dori_capability` that reaches a range; null beyond the last, which nothing is claimed for."""
    bands = F.array(*[F.when(range_m <= F.col(band), F.lit(band)) for band, _ in DORI])
    return F.when(range_m <= F.col(DORI[-1][0]), F.array_compact(bands)[0])

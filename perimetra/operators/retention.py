"""Bounded buffers, retention, retry schedules and done sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Plates: vehicle classes that bear one, tries per track, least width; shape limits of a plate's box.
PLATE_CLASSES = ("car", "truck", "two_wheeler")
PLATE_TRIES, PLATE_WIDTH = 3, 48
ASPECT, AREA, LEAST_WIDTH = (1.15, 5.5), (0.0025, 0.55), 18


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """What a bounded buffer holds that drops its oldest: adds `dropped`, the rows each key lost."""
    w = Window.partitionBy(*by)
    n, total = F.row_number().over(w.orderBy(*[F.desc(o) for o in order])), F.count(F.lit(1)).over(w)
    return rows.withColumn("__n", n).withColumn("dropped", F.greatest(total - size, F.lit(0))).filter(F.col("__n") <= size).drop("__n")


def purge(rows: DataFrame, at: Column, now: Column, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows past their retention."""
    old = now - at > seconds
    return rows.filter(~old), rows.filter(old)


def not_done(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(*key), list(key), "left_anti")


def attempts(rows: DataFrame, by: Sequence[str], order: Sequence[str], every: int = 3, most: int = 6) -> DataFrame:
    """Every n-th row of a key, at most so many: a retry schedule."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("__n", n).filter((F.col("__n") % every == 0) & (F.col("__n") < every * most)).withColumn("attempt", (F.col("__n") / every).cast("int")).drop("__n")


def plate_attempts(rows: DataFrame, by: Sequence[str], order: Sequence[str], classes: Sequence[str] = PLATE_CLASSES) -> DataFrame:
    """Rows (class_name, width) on which a plate is read: of a bearing class, wide enough, the first few of each track."""
    fit = rows.filter(F.col("class_name").isin(*classes) & (F.col("width") >= PLATE_WIDTH))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return fit.withColumn("attempt", n).filter(F.col("attempt") <= PLATE_TRIES)


def plate_score(width: Column, height: Column, fill: Column, crop_area: Column) -> Column:
    """How plate-like a box is, 0 to 1: half its fill, half how near its aspect is to the middle; null outside the limits."""
    aspect, share, middle = width / F.nullif(height, F.lit(0.0)), F.coalesce(width * height / F.nullif(crop_area, F.lit(0.0)), F.lit(0.0)), sum(ASPECT) / 2
    fits = (width >= LEAST_WIDTH) & (height > 0) & aspect.between(*ASPECT) & share.between(*AREA)
    near = 1.0 - F.least(F.lit(1.0), F.abs(aspect - middle) / middle)
    return F.when(fits, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * fill + 0.5 * near)))

"""Per-camera calibration: robust thresholds of motion cells, floors and contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 0.35
SPREAD = 4 * 1.4826


def cell_thresholds(cells: DataFrame, camera: Sequence[str], cell: Sequence[str], least: int = 5, floor: float = FLOOR, frame: str = "t") -> DataFrame:
    """tau per cell: median + 4 scaled MADs of `energy`, at least `floor`; cells with fewer samples than `least` and than a
    tenth of their camera's frames (distinct `frame`s) get the median tau of their camera."""
    frames = cells.groupBy(*camera).agg(F.count_distinct(frame).alias("frames"))
    key = [*camera, *cell]
    medians = cells.groupBy(*key).agg(F.percentile("energy", 0.5).alias("m"), F.count("energy").alias("samples"))
    spread = cells.join(medians.select(*key, "m"), key).groupBy(*key).agg(F.percentile(F.abs(F.col("energy") - F.col("m")), 0.5).alias("mad"))
    enough = F.greatest(F.lit(least), F.floor(F.col("frames") / 10))
    own = medians.join(spread, key).join(frames, list(camera)).withColumn("tau", F.when(F.col("samples") >= enough, F.greatest(F.lit(floor), F.col("m") + SPREAD * F.col("mad"))))
    whole = own.groupBy(*camera).agg(F.percentile("tau", 0.5).alias("camera_tau"))
    return own.join(whole, list(camera)).select(*key, "samples", F.coalesce("tau", "camera_tau", F.lit(floor)).alias("tau"))


def scene_levels(cells: DataFrame, camera: Sequence[str]) -> DataFrame:
    """Median and 95th percentile of background energy."""
    return cells.filter("is_background").groupBy(*camera).agg(F.percentile("energy", 0.5).alias("floor"), F.percentile("energy", 0.95).alias("p95"))


def contrast(cells: DataFrame, camera: Sequence[str]) -> DataFrame:
    """Mean energy inside and outside objects, and the ratio of the means."""
    inside, outside = F.avg(F.when(~F.col("is_background"), F.col("energy"))), F.avg(F.when(F.col("is_background"), F.col("energy")))
    return cells.groupBy(*camera).agg(inside.alias("inside"), outside.alias("outside")).withColumn("contrast", F.try_divide("inside", "outside"))


def warmed_up(frames: DataFrame, camera: Sequence[str], seconds: float = 5.0, least: int = 25) -> DataFrame:
    """Cameras that have seen enough frames for long enough."""
    seen = frames.groupBy(*camera).agg((F.max("t") - F.min("t")).alias("elapsed"), F.count(F.lit(1)).alias("frames"))
    return seen.withColumn("ready", (F.col("elapsed") >= seconds) & (F.col("frames") >= least))


def fused_score(appearance: Column, motion: Column, appearance_weight: float, motion_weight: float) -> Column:
    return appearance_weight * appearance + motion_weight * motion

"""Is a camera's picture evidence at all: lost, tampered with, or flooded with light, from the statistics of its frames.

Frames: camera_id, t, seq, brightness, std, detail, saturated, diff (mean difference from the frame before, null for the
first) and gap_s (seconds without frames before this one, null for none). All steps are windows over one ordering of a
camera's frames, so they share one shuffle; a camera's frames stream through its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Anomalies, the strongest first: one that holds hides those after it in the same frame.
FLOOD, LOSS, TAMPER = "IR_FLOOD", "SIGNAL_LOSS", "LENS_TAMPER"
KINDS = (FLOOD, LOSS, TAMPER)

# Fixed values.
FLAT_STD = 1.0  # below it no sensor stands behind the picture
STILL_DIFF = 0.02
STILL_SECONDS = 2.0
GAP_SECONDS = 2.0
TAMPER_DETAIL_SHARE = 0.15
TAMPER_STD_SHARE = 0.08
TAMPER_BOTH_SHARES = (0.40, 0.35)  # of detail and of std, where both have gone in part
TAMPER_DETAIL_UNLEARNT = 0.005
TAMPER_STD_UNLEARNT = 3.0
FLOOD_RISE = 60.0
FLOOD_SATURATED = 0.25
FLOOD_BRIGHTNESS = 220.0
FLOOD_STD_UNLEARNT = 20.0
PERSIST_FRAMES = 3
CLEAR_FRAMES = 5


def _so_far(camera: str) -> tuple:
    order = Window.partitionBy(camera).orderBy("t", "seq")
    return order, order.rowsBetween(Window.unboundedPreceding, 0)


def learnt_scenes(frames: DataFrame, camera: str = "camera_id", seconds: float = 5.0, least: int = 25) -> DataFrame:
    """camera, ready_at, scene_brightness, scene_std, scene_detail: medians of each camera's warm-up.

    The warm-up ends with the first frame that is the `least`-th or later and `seconds` or more after the first; where
    frames have a `size`, another size begins it anew. Cameras that are not ready have no row.
    """
    order, so_far = _so_far(camera)
    changed = F.coalesce((F.col("size") != F.lag("size").over(order)).cast("int"), F.lit(0)) if "size" in frames.columns else F.lit(0)
    part = Window.partitionBy(camera, "__part").orderBy("t", "seq")
    begun = frames.withColumn("__changed", changed).withColumn("__part", F.sum("__changed").over(so_far))
    ready = (F.row_number().over(part) >= least) & (F.col("t") - F.first("t").over(part) >= seconds)
    begun = begun.withColumn("__ready", ready).withColumn("__done", F.coalesce(F.max(F.col("__ready").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    # What the first ready frame ends is the last part that any row before it belongs to.
    used = begun.filter(~F.col("__done"))
    ended = used.groupBy(camera, "__part").agg(F.max(F.when(F.col("__ready"), F.col("t"))).alias("ready_at"), *(F.percentile(c, 0.5).alias(c) for c in ("brightness", "std", "detail"))).filter("ready_at is not null")
    return ended.select(camera, "ready_at", F.round("brightness", 3).alias("scene_brightness"), F.round("std", 3).alias("scene_std"), F.round("detail", 5).alias("scene_detail"))


def _hits(flat: Column, frozen: Column) -> dict[str, Column]:
    """What each anomaly sees in a frame, with the learnt scene where there is one."""
    learnt = F.col("scene_std").isNotNull()
    bright, saturated, std, detail = (F.col(c) for c in ("brightness", "saturated", "std", "detail"))
    washed = F.when(
        learnt,
        (bright >= F.col("scene_brightness") + FLOOD_RISE) & ((saturated >= FLOOD_SATURATED) | (bright >= FLOOD_BRIGHTNESS)),
    ).otherwise((bright >= FLOOD_BRIGHTNESS) & ((saturated >= FLOOD_SATURATED) | (std < FLOOD_STD_UNLEARNT)))
    tiny = F.lit(1e-9)
    of_detail, of_std = detail / F.greatest("scene_detail", tiny), std / F.greatest("scene_std", tiny)
    both = (of_detail < TAMPER_BOTH_SHARES[0]) & (of_std < TAMPER_BOTH_SHARES[1])
    gone = F.when(learnt, (of_detail < TAMPER_DETAIL_SHARE) | (of_std < TAMPER_STD_SHARE) | both).otherwise((detail < TAMPER_DETAIL_UNLEARNT) | (std < TAMPER_STD_UNLEARNT))
    return {FLOOD: washed, LOSS: flat | frozen, TAMPER: gone & ~flat}


def judged_frames(frames: DataFrame, scenes: DataFrame | None = None, camera: str = "camera_id", persist: int = PERSIST_FRAMES, clear: int = CLEAR_FRAMES, still_seconds: float = STILL_SECONDS) -> DataFrame:
    """The frames with, for each anomaly, <kind>_hit, <kind>_active, <kind>_change (raised or cleared by this frame) and
    <kind>_since, and with status: camera_state while an anomaly is active, warming_up before the scene is learnt, else ok.

    scenes: see `learnt_scenes`; a scene counts for frames after its ready_at. An anomaly is raised by the `persist`-th
    frame in a row that shows it, and cleared by the `clear`-th in a row that does not.
    """
    order, so_far = _so_far(camera)
    if scenes is None:
        own = frames.withColumns({c: F.lit(None).cast("double") for c in ("ready_at", "scene_brightness", "scene_std", "scene_detail")})
    else:
        own = frames.join(scenes, camera, "left")
        own = own.withColumns({c: F.when(F.col("t") > F.col("ready_at"), F.col(c)) for c in ("scene_brightness", "scene_std", "scene_detail")})
    flat = F.coalesce(F.col("std") < FLAT_STD, F.lit(False))
    still = F.coalesce(F.col("diff") < STILL_DIFF, F.lit(False)) & ~flat
    own = own.withColumn("__n", F.row_number().over(order)).withColumn("__still", still)
    begins = F.when(F.col("__still") & ~F.coalesce(F.lag("__still").over(order), F.lit(False)), F.col("t"))
    own = own.withColumn("__begins", begins).withColumn("__since", F.last("__begins", True).over(so_far))
    frozen = F.col("__still") & (F.col("t") - F.col("__since") >= still_seconds)
    seen, hidden = {}, F.lit(False)
    for kind, hit in _hits(flat, frozen).items():
        hit = F.coalesce(hit, F.lit(False))
        seen[f"{kind}_hit"] = hit & ~hidden
        hidden = hidden | seen[f"{kind}_hit"]
    own = own.withColumns(seen)

    def each(made) -> dict[str, Column]:
        return {name: column for kind in KINDS for name, column in made(kind).items()}

    hit_of = lambda kind: F.col(f"{kind}_hit")
    own = own.withColumns(each(lambda k: {f"__miss_{k}": F.last(F.when(~hit_of(k), F.col("__n")), True).over(so_far), f"__found_{k}": F.last(F.when(hit_of(k), F.col("__n")), True).over(so_far), f"__new_{k}": F.when(hit_of(k) & ~F.coalesce(F.lag(hit_of(k)).over(order), F.lit(False)), F.col("t"))}))
    run, pause = (lambda k: F.col("__n") - F.coalesce(f"__miss_{k}", F.lit(0))), (lambda k: F.col("__n") - F.coalesce(f"__found_{k}", F.lit(0)))
    own = own.withColumns(each(lambda k: {f"{k}_active": F.coalesce(F.last(F.when(run(k) >= persist, True).when(pause(k) >= clear, False), True).over(so_far), F.lit(False)), f"__first_{k}": F.last(f"__new_{k}", True).over(so_far)}))
    was = lambda k: F.coalesce(F.lag(f"{k}_active").over(order), F.lit(False))
    now = lambda k: F.col(f"{k}_active")
    own = own.withColumns(each(lambda k: {f"{k}_change": F.when(now(k) & ~was(k), "raised").when(~now(k) & was(k), "cleared")}))
    own = own.withColumns(each(lambda k: {f"{k}_since": F.last(F.when(F.col(f"{k}_change") == "raised", F.col(f"__first_{k}")), True).over(so_far)}))
    blocked = now(KINDS[0]) | now(KINDS[1]) | now(KINDS[2])
    learnt = F.lit(scenes is None) | (F.col("t") > F.col("ready_at"))
    status = F.when(blocked, "camera_state").when(~F.coalesce(learnt, F.lit(False)), "warming_up").otherwise("ok")
    return own.withColumn("status", status).drop(*[c for c in own.columns if c.startswith("__")])


def anomalies(judged: DataFrame, keep: Sequence[str] = ("camera_id", "seq", "t"), gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """keep, anomaly, active, since, step: what is raised and cleared by each frame, in order of step.

    A gap of `gap_seconds` or more is a loss that is raised and cleared by the frame that ends it.
    """
    long_gap = F.coalesce(F.col("gap_s") >= gap_seconds, F.lit(False)) if "gap_s" in judged.columns else F.lit(False)
    since = F.col("t") - F.col("gap_s") if "gap_s" in judged.columns else F.lit(None).cast("double")
    event = lambda kind, active, begun, step: F.struct(F.lit(kind).alias("anomaly"), active.alias("active"), begun.alias("since"), F.lit(step).alias("step"))
    made = [F.when(long_gap, event(LOSS, F.lit(True), since, 0)), F.when(long_gap, event(LOSS, F.lit(False), since, 1))]
    made += [F.when(F.col(f"{k}_change").isNotNull(), event(k, F.col(f"{k}_active"), F.col(f"{k}_since"), 2 + i)) for i, k in enumerate(KINDS)]
    return judged.select(*keep, F.explode(F.array_compact(F.array(*made))).alias("e")).select(*keep, "e.*")

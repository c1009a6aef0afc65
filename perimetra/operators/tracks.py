"""Trajectory features and rules over track points (camera_id, track_id, ..., seq, t, x, y).

Points are ordered by (t, seq). Every rule is a DataFrame of hits with its numbers, so that batch and micro-batch code
share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.functions import geometry as g
from perimetra.functions import timeutil
from perimetra.operators import ranging

KEY = ("camera_id", "track_id")


def for_rules(tracks: DataFrame, points: DataFrame, ids: DataFrame | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Tracks that rules look at: confirmed ones with a history, of `ids` only if given."""
    known = tracks.filter("not tentative").join(points.select(*key).distinct(), list(key), "left_semi")
    return known if ids is None else known.join(ids, list(key), "left_semi")


def features(points: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per track: n, t0, t1, dwell, x0, y0, x1, y1, net, path, vx, vy. One point has no movement; no elapsed time, no velocity."""
    order = Window.partitionBy(*key).orderBy("t", "seq")
    step = g.length(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    at = F.struct("t", "seq")
    rows = points.withColumn("step", step).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.min_by("x", at).alias("x0"), F.min_by("y", at).alias("y0"), F.max_by("x", at).alias("x1"), F.max_by("y", at).alias("y1"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"),
    )
    dx, dy, dt = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("t1") - F.col("t0")
    return rows.select("*", dt.alias("dwell"), g.length(dx, dy).alias("net"), F.when(dt > 0, dx / dt).otherwise(0.0).alias("vx"), F.when(dt > 0, dy / dt).otherwise(0.0).alias("vy"))


def recent_velocity(points: DataFrame, last: int = 6, key: Sequence[str] = KEY) -> DataFrame:
    """Velocity over the latest `last` points of each track."""
    newest = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("seq"))
    return features(points.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= last).drop("rn"), key).select(*key, "n", "vx", "vy")


def class_vote(points: DataFrame, score: Column, key: Sequence[str] = KEY) -> DataFrame:
    """The class with the largest score sum; of equals the class seen first."""
    sums = points.groupBy(*key, "class_name").agg(F.sum(score).alias("votes"), F.min("seq").alias("first"))
    return sums.groupBy(*key).agg(F.max_by("class_name", F.struct("votes", -F.col("first"))).alias("class_name"), F.max("votes").alias("votes"))


def fence_crossings(points: DataFrame, segments: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """First crossing of each fence by each track: t, cx, cy, direction, segment.

    segments: camera_id, fence, segment, ax, ay, bx, by, only (a direction, or null for both). Points on the line do not
    count; a crossing is a strict straddle both ways between consecutive others, at the time of the later one.
    """
    on = points.join(F.broadcast(segments), "camera_id")
    own = g.side(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("x"), F.col("y"))
    off = on.withColumn("side", own).filter(F.abs("side") > g.EPSILON)
    order = Window.partitionBy(*key, "fence", "segment").orderBy("t", "seq")
    pairs = off.select("*", F.lag("side").over(order).alias("before"), F.lag("x").over(order).alias("px"), F.lag("y").over(order).alias("py"))
    a = g.side(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("ax"), F.col("ay"))
    b = g.side(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    share = F.col("before") / (F.col("before") - F.col("side"))
    direction = F.when((F.col("before") > 0) & (F.col("side") < 0), "in").otherwise("out")
    hits = pairs.filter(g.straddle(F.col("before"), F.col("side")) & g.straddle(a, b)).select(
        *key, "fence", "segment", "t", "seq", "only",
        (F.col("px") + share * (F.col("x") - F.col("px"))).alias("cx"), (F.col("py") + share * (F.col("y") - F.col("py"))).alias("cy"),
        direction.alias("direction"),
    ).filter(F.col("only").isNull() | (F.col("only") == F.col("direction")))
    first = F.row_number().over(Window.partitionBy(*key, "fence").orderBy("t", "segment", "seq"))
    return hits.withColumn("rn", first).filter("rn = 1").drop("rn", "only", "seq")


def loitering(feats: DataFrame, dwell: float = 3.0, net: float = 90.0, metres: float | None = None, homographies: DataFrame | None = None) -> DataFrame:
    """Tracks that stayed long enough and did not get far enough: adds net_m, limit and unit.

    homographies: camera_id, homography (nine numbers, row by row, from pixels to metres). Where a camera has one, net_m is
    the way in metres by the scale at the track's first point; with `metres` it is then held against that limit, and
    everywhere else the way in pixels against `net`.
    """
    if homographies is None:
        met = feats.withColumn("net_m", F.lit(None).cast("double"))
    else:
        h = F.col("homography")
        plane = [h[i] for i in range(9)]
        x0, y0 = ranging.on_plane(plane, F.col("x0"), F.col("y0"))
        x1, y1 = ranging.on_plane(plane, F.col("x0") + 1, F.col("y0"))
        met = feats.join(homographies.select("camera_id", "homography"), "camera_id", "left").withColumn("net_m", F.col("net") * g.length(x1 - x0, y1 - y0)).drop("homography")
    by_metres = F.col("net_m").isNotNull() & F.lit(metres is not None)
    limit = F.when(by_metres, F.lit(metres).cast("double")).otherwise(F.lit(float(net)))
    far = F.when(by_metres, F.col("net_m")).otherwise(F.col("net"))
    held = met.withColumns({"limit": limit, "unit": F.when(by_metres, "m").otherwise("px")})
    return held.filter((F.col("dwell") >= dwell) & (far < F.col("limit"))).select(*feats.columns, "net_m", "limit", "unit")


def with_groups(verdicts: DataFrame, groups: DataFrame, key: Sequence[str] = KEY, name: str = "group formed") -> DataFrame:
    """Verdicts (rule_fired, reason, n_rules) with the group rule in those of every member: a track that also did something
    else still has one verdict.

    groups: members (each the key's values joined by |), first_at, duration, as `grouping.groups` finds them; each group
    adds a reason, the earliest first, and the rule once. Groups that begin at once are numbered by their members, so that
    a member carries its groups' numbers and not the names of all others.
    """
    size = F.size("members").cast("string")
    told = F.concat(F.lit("in a group of "), size, F.lit(" for "), F.floor("duration").cast("string"), F.lit(" s"))
    turn = F.row_number().over(Window.partitionBy("first_at").orderBy(F.array_join("members", ","), told))
    each = groups.select("members", "first_at", turn.alias("turn"), told.alias("reason")).select(F.explode("members").alias("__member"), F.struct("first_at", "turn", "reason").alias("g"))
    own = each.groupBy("__member").agg(F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda x: x["reason"]), "; ").alias("__told"))
    met = verdicts.withColumn("__member", F.concat_ws("|", *[F.col(k).cast("string") for k in key])).join(own, "__member", "left")
    grown = F.col("__told").isNotNull()
    joined = lambda old, sign, new: F.when(~grown, F.col(old)).when(F.col(old) == "", new).otherwise(F.concat(F.col(old), F.lit(sign), new))
    return met.withColumns({"rule_fired": joined("rule_fired", " + ", F.lit(name)), "reason": joined("reason", "; ", F.col("__told")), "n_rules": F.col("n_rules") + grown.cast("long")}).select(verdicts.columns)


def learn_baseline(feats: DataFrame, min_net: float = 10.0, opposing: float = 90.0) -> DataFrame:
    """Per camera: circular mean heading of tracks that moved, tracks with and against it, mean positive dwell."""
    moved = feats.filter(F.col("net") >= min_net).withColumn("heading", g.heading(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    mean = moved.groupBy("camera_id").agg(F.sum(F.sin(F.radians("heading"))).alias("s"), F.sum(F.cos(F.radians("heading"))).alias("c"))
    mean = mean.select("camera_id", g.heading(F.col("c"), F.col("s")).alias("baseline"))
    against = g.angle_between(F.col("heading"), F.col("baseline")) > opposing
    counts = moved.join(mean, "camera_id").groupBy("camera_id").agg(F.first("baseline").alias("baseline"), F.count_if(~against).alias("with_flow"), F.count_if(against).alias("against_flow"))
    dwell = feats.groupBy("camera_id").agg(F.avg(F.when(F.col("dwell") > 0, F.col("dwell"))).alias("mean_dwell"), F.count(F.lit(1)).alias("tracks"))
    return dwell.join(counts, "camera_id", "left")


def footfall(points: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Tracks by camera and UTC hour of their first point."""
    first = points.groupBy(*key).agg(F.min("t").alias("t0"))
    return first.groupBy("camera_id", F.hour(timeutil.from_epoch(F.col("t0"))).alias("hour")).agg(F.count(F.lit(1)).alias("tracks"))


def wrong_direction(feats: DataFrame, baseline: DataFrame, min_net: float = 40.0, opposing: float = 90.0) -> DataFrame:
    """Moved far enough, and against the camera's baseline heading."""
    known = feats.join(baseline.select("camera_id", "baseline"), "camera_id").filter((F.col("net") >= min_net) & ((F.col("vx") != 0) | (F.col("vy") != 0)))
    return known.withColumn("heading", g.heading(F.col("vx"), F.col("vy"))).withColumn("difference", g.angle_between(F.col("heading"), F.col("baseline"))).filter(F.col("difference") >= 180.0 - opposing)


def out_of_hours(feats: DataFrame, windows: DataFrame, zone: str = timeutil.LOCAL_ZONE) -> DataFrame:
    """Tracks whose last point lies outside all sanctioned windows (camera_id, start, end in minutes) of its camera, if it has any."""
    minute = timeutil.minute_of_day(timeutil.local(timeutil.from_epoch(F.col("t1")), zone))
    spans = windows.groupBy("camera_id").agg(F.collect_list(F.struct("start", "end")).alias("windows"))
    known = feats.withColumn("minute", minute).join(spans, "camera_id")
    return known.filter(~F.exists("windows", lambda w: timeutil.in_window(F.col("minute"), w["start"], w["end"]))).drop("windows")


def rule_table(points: DataFrame, segments: DataFrame, windows: DataFrame, key: Sequence[str] = KEY, dwell: float = 3.0, net: float = 90.0, min_net: float = 40.0, opposing: float = 90.0) -> DataFrame:
    """Features of every track with what each rule says of it: crossed (directions of the fences it crossed), loitered,
    against_flow, outside_hours, minute.

    Points are dealt by track once; features, fence hits and their join use that partitioning. Baselines and hours are
    joined by camera.
    """
    placed = points.select(*key, "seq", "t", "x", "y").repartition(*[F.col(k) for k in key])
    feats = features(placed, key)
    crossed = fence_crossings(placed, segments, key).groupBy(*key).agg(F.array_sort(F.collect_set("direction")).alias("crossed"))
    base = learn_baseline(feats).select("camera_id", "baseline")
    spans = windows.groupBy("camera_id").agg(F.collect_list(F.struct("start", "end")).alias("windows"))
    away = (F.col("net") >= min_net) & ((F.col("vx") != 0) | (F.col("vy") != 0)) & (g.angle_between(g.heading(F.col("vx"), F.col("vy")), F.col("baseline")) >= 180.0 - opposing)
    minute = timeutil.minute_of_day(timeutil.local(timeutil.from_epoch(F.col("t1")), timeutil.LOCAL_ZONE))
    every = feats.join(crossed, list(key), "left").join(base, "camera_id", "left").join(spans, "camera_id", "left").withColumn("minute", minute)
    outside = F.col("windows").isNotNull() & ~F.exists("windows", lambda w: timeutil.in_window(F.col("minute"), w["start"], w["end"]))
    return every.select(*feats.columns, "crossed", ((F.col("dwell") >= dwell) & (F.col("net") < net)).alias("loitered"), F.coalesce(away, F.lit(False)).alias("against_flow"), F.coalesce(outside, F.lit(False)).alias("outside_hours"), "minute")


def verdicts(feats: DataFrame, hits: Sequence[tuple[str, DataFrame, Column]], key: Sequence[str] = KEY) -> DataFrame:
    """Every track with rule_fired (joined by ' + ' in the order given), reason (joined by '; ') and n_rules.

    hits: name, rows with the key, and the reason of a row.
    """
    fired = None
    for rank, (name, rows, reason) in enumerate(hits):
        part = rows.select(*key, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("rule"), reason.alias("reason")).alias("hit"))
        fired = part if fired is None else fired.unionByName(part)
    lists = fired.groupBy(*key).agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    joined = feats.select(*key).join(lists, list(key), "left")
    rules = F.array_distinct(F.transform("hits", lambda h: h["rule"]))
    return joined.select(
        *key,
        F.coalesce(F.array_join(rules, " + "), F.lit("")).alias("rule_fired"),
        F.coalesce(F.array_join(F.transform("hits", lambda h: h["reason"]), "; "), F.lit("")).alias("reason"),
        F.coalesce(F.size(rules), F.lit(0)).cast("long").alias("n_rules"),
    )


def interpolated(points: DataFrame, grid: DataFrame, key: Sequence[str] = KEY, on: str = "camera_id") -> DataFrame:
    """Position of each track at grid times (on, at): linear between its points, none outside its life."""
    order = Window.partitionBy(*key).orderBy("t", "seq")
    legs = points.select(*key, "t", "x", "y", F.lead("t").over(order).alias("t2"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"))
    legs = legs.withColumn("t2", F.coalesce("t2", "t")).withColumn("x2", F.coalesce("x2", "x")).withColumn("y2", F.coalesce("y2", "y"))
    share = F.when(F.col("t2") > F.col("t"), (F.col("at") - F.col("t")) / (F.col("t2") - F.col("t"))).otherwise(0.0)
    met = legs.join(grid, on).filter((F.col("at") >= F.col("t")) & (F.col("at") <= F.col("t2")))
    met = met.select(*key, "at", "t", (F.col("x") + share * (F.col("x2") - F.col("x"))).alias("px"), (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("py"))
    newest = F.row_number().over(Window.partitionBy(*key, "at").orderBy(F.desc("t")))
    return met.withColumn("rn", newest).filter("rn = 1").drop("rn", "t")

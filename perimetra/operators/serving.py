"""The relational serving layer: alert reads, counts, budgets, change logs and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHIFT_BUDGET = 12
#: Terminal state last; an alert never moves back.
STAGES = ("provisional", "confirmed", "sealed", "gone")


def alert_view(alerts: DataFrame, cameras: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Alerts with their camera, and with their track where there is one."""
    view = alerts.join(cameras.select(F.col("id").alias("camera_id"), F.col("name").alias("camera"), "sector", "post_id"), "camera_id")
    return view if tracks is None else view.join(tracks, "track_id", "left")


def live(alerts: DataFrame, gone: Sequence[str] = ("gone",)) -> DataFrame:
    return alerts.filter(~F.col("stage").isin(*gone))


def latest(rows: DataFrame, by: Sequence[str], n: int, most: int = 200) -> DataFrame:
    """The n latest rows (200 at most) by descending columns."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(min(n, most))


def tail(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The last n rows, in ascending order."""
    return rows.orderBy(F.desc(by)).limit(n).orderBy(by)


def counts_by(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of `right` per key of `left`; keys without rows count 0."""
    n = right.groupBy(F.col(other).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return left.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def with_flag(left: DataFrame, key: str, own: Column, right: DataFrame, other: str) -> DataFrame:
    """`flag`: its own, or that some row of `right` has its key."""
    hit = right.select(F.col(other).alias(key)).distinct().withColumn("__hit", F.lit(True))
    return left.join(hit, key, "left").withColumn("flag", own | F.coalesce("__hit", F.lit(False))).drop("__hit")


def first_per(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def day_night(rows: DataFrame, hour: Column, key: Sequence[str] = ()) -> DataFrame:
    """day, night, day_pct, night_pct by label hours 6 to 17; percents add up to 100 and are null without rows."""
    is_day = (hour >= 6) & (hour <= 17)
    n = rows.groupBy(*key).agg(F.count_if(is_day).alias("day"), F.count_if(~is_day).alias("night"))
    pct = F.floor(100.0 * F.col("day") / F.nullif(F.col("day") + F.col("night"), F.lit(0)) + 0.5).cast("long")
    return n.withColumn("day_pct", pct).withColumn("night_pct", 100 - F.col("day_pct"))


def shift_budget(alerts: DataFrame, hours: int = 8, budget: int = SHIFT_BUDGET) -> DataFrame:
    """Alerts, budget used and whether it is near its end, per epoch-aligned shift."""
    size = hours * 3600
    shift = (F.floor(F.unix_timestamp("captured_at") / size) * size).cast("long")
    n = alerts.groupBy(shift.alias("shift_start")).agg(F.count(F.lit(1)).alias("alerts"))
    return n.withColumn("used", F.least(F.lit(budget).cast("long"), F.col("alerts"))).withColumn("near", F.col("used") >= budget - 2)


def tumbling_counts(rows: DataFrame, now: Column, buckets: int = 12, width: int = 60) -> DataFrame:
    """Rows in each of the last half-open intervals [end - width, end) that end at `now` (epoch seconds); empty ones count 0."""
    at = F.floor((F.col("now") - F.col("t") - 1e-9) / width).cast("int")
    n = rows.withColumn("now", now).withColumn("bucket", buckets - 1 - at).filter((F.col("t") < F.col("now")) & F.col("bucket").between(0, buckets - 1)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return grid.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def recent_series(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, n: int = 12) -> DataFrame:
    """The n latest values, oldest first, filled on the left with the first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    kept = rows.withColumn("__n", rank).filter(F.col("__n") <= n)
    series = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("k"), F.col(value).alias("v")))).alias("s"))
    values = F.transform("s", lambda x: x["v"])
    return series.select(*key, F.concat(F.array_repeat(F.get(values, F.lit(0)), n - F.size(values)), values).alias("series"))


def materialised(log: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A table from its change log: each column's last value that is not null (partial upserts)."""
    at = F.struct(*[F.col(o) for o in order])
    return log.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def insert_absent(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows whose key is not there yet; replays change nothing."""
    fresh = first_per(new, key, [c for c in new.columns if c not in key] or list(key)).join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def merge_alerts(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One alert per live key: event_id and first event, the furthest stage reached (sealed only with evidence), all rules in order, the best reason (a model's beats a template), first evidence and latest confidence."""
    at = F.struct(*[F.col(o) for o in order])
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    allowed = F.when((F.col("stage") == "sealed") & F.col("evidence_id").isNull(), 2).otherwise(rank)
    rules = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("rules").alias("rules"))))
    out = events.groupBy(*key).agg(
        F.min_by("event_id", at).alias("event_id"), F.count(F.lit(1)).alias("events"), F.max(allowed).alias("__stage"), rules.alias("__rules"),
        F.max_by("reason", F.struct((F.col("reason_source") != "template").alias("m"), at.alias("at"))).alias("reason"),
        F.min_by("evidence_id", F.when(F.col("evidence_id").isNotNull(), at)).alias("evidence_id"), F.max_by("confidence", at).alias("confidence"),
    )
    merged = F.array_join(F.array_distinct(F.flatten(F.transform("__rules", lambda r: r["rules"]))), " + ")
    return out.withColumn("stage", F.array(*[F.lit(s) for s in STAGES])[F.col("__stage").cast("int") - 1]).withColumn("rule_fired", merged).drop("__stage", "__rules")


def snapshot_plan(snapshot: DataFrame, seen: DataFrame, key: str, skip: DataFrame | None = None) -> DataFrame:
    """Each snapshot row as 'fresh' or, if known already, 'patch'; rows to skip are left out."""
    rows = snapshot if skip is None else snapshot.join(skip.select(key).distinct(), key, "left_anti")
    known = seen.select(key).distinct().withColumn("__k", F.lit(True))
    return rows.join(known, key, "left").withColumn("action", F.when(F.col("__k"), "patch").otherwise("fresh")).drop("__k")


def replay_guard(rows: DataFrame, skew: float = 120.0, nonce: str = r"^[0-9a-f]{16,64}$") -> DataFrame:
    """First use of each well-formed nonce whose clock skew is small (columns nonce, sent, received in seconds)."""
    good = rows.filter((F.abs(F.col("received") - F.col("sent")) <= skew) & F.col("nonce").rlike(nonce))
    return first_per(good, ["nonce"], ["received", "sent"])


def apply_patches(alerts: DataFrame, patches: DataFrame, key: str, order: str, columns: Sequence[str], gone: str = "gone") -> tuple[DataFrame, DataFrame]:
    """Alerts with the last non-null value of each patched column, and the patches that are refused: of unknown alerts (not found) or of gone ones (conflict).

    A row's `changed` lists the columns that a patch really changed, so a patch that comes twice changes nothing more.
    """
    known = patches.join(alerts.select(key, F.col("stage").alias("__stage")), key, "left")
    why = F.when(F.col("__stage").isNull(), "not found").when(F.col("__stage") == gone, "conflict")
    refused = known.filter(why.isNotNull()).select(*patches.columns, why.alias("problem"))
    good = known.filter(F.col("__stage").isNotNull() & (F.col("__stage") != gone))
    last = materialised(good, [key], [order], columns).select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    j = alerts.join(last, key, "left")
    changed = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]))
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in alerts.columns], changed.alias("changed")), refused


def of_sector(rows: DataFrame, sector: str | None, column: str = "sector") -> DataFrame:
    """Rows of a sector; all of them for 'all' or None."""
    return rows if sector is None or sector.lower() == "all" else rows.filter(F.col(column) == sector)


def in_days(rows: DataFrame, first: str | None, last: str | None, day: str = "day") -> DataFrame:
    """Rows whose day (a date or its ISO text) lies between first and last, both included; None leaves an end open."""
    own = F.col(day).cast("string")
    return rows.filter((F.lit(True) if first is None else own >= first) & (F.lit(True) if last is None else own <= last))


def by_policy(rows: DataFrame, policy: str = "rules", rules: str = "n_rules") -> DataFrame:
    """kind: alert where a rule fired (policy 'rules') or for every row (policy 'all'), else observation."""
    if policy not in ("rules", "all"):
        raise ValueError("policy is 'rules' or 'all'")
    return rows.withColumn("kind", F.when((F.col(rules) > 0) | F.lit(policy == "all"), "alert").otherwise("observation"))


def to_wall_clock(rows: DataFrame, stamps: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose t is moved from the event clock to the wall clock by what their event's captured_at is ahead of its timestamp."""
    ahead = stamps.select(*key, (F.col("captured_at") - F.col("timestamp")).alias("__ahead"))
    return rows.join(ahead, list(key)).withColumn("t", F.col("t") + F.col("__ahead")).drop("__ahead")


def reasons_counted(*rejects: DataFrame) -> DataFrame:
    """How many rows each step skipped, by step and reason: nothing goes without being counted."""
    every = rejects[0].select("step", "reason")
    for r in rejects[1:]:
        every = every.unionByName(r.select("step", "reason"))
    return every.groupBy("step", "reason").agg(F.count(F.lit(1)).alias("n"))


def rate_limited(rows: DataFrame, by: Sequence[str], most: int, width: int = 60) -> DataFrame:
    """Rows (t in seconds, seq) with `allowed`: whether they are among the first `most` of their key in their interval."""
    w = Window.partitionBy(*by, F.floor(F.col("t") / width)).orderBy("t", "seq")
    return rows.withColumn("allowed", F.row_number().over(w) <= most)

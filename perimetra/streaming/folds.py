"""The folds of `perimetra.operators.stateful` over streams, and event-time windows with watermarks.

A fold's state is kept in the state store under the names and types that the fold declares: single values, maps and lists.
A map's entries and a list's elements are stored one by one, so that a trigger writes only what it changed, and state
outlives a change of code as long as the names and types stay. Rows of one trigger are taken in (t, seq) order. An
event-time timer drops the state of keys that are silent for `ttl`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta
from functools import partial

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from perimetra.operators.stateful import Fold, RateLimit

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STAMP = "__ms"


class Folding(StatefulProcessor):
    """Runs a fold for each key between the state store and the rows of a trigger."""

    def __init__(self, make: Callable[[], Fold], key: Sequence[str], ttl: timedelta) -> None:
        self.make, self.key, self.ttl = make, list(key), int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fold = self.make()
        self.handle, self.names = handle, [x.split()[0] for x in _columns_of(getattr(fold, "state", ""))]
        self.own = handle.getValueState("own", fold.state) if self.names else None
        self.until = handle.getValueState("until", "ms long")
        self.maps = {name: handle.getMapState(name, *kinds) for name, kinds in getattr(fold, "maps", {}).items()}
        self.lists = {name: handle.getListState(name, kind) for name, kind in getattr(fold, "lists", {}).items()}
        self.columns, self.latest = list(fold.columns), getattr(fold, "latest", False)
        self.row = Row(*self.key, *(x.split()[0] for x in _columns_of(fold.output)))

    def _loaded(self) -> tuple[Fold, dict, dict]:
        fold = self.make()
        if self.own is not None and self.own.exists():
            for name, value in zip(self.names, self.own.get(), strict=True):
                setattr(fold, name, tuple(value) if isinstance(value, tuple) else value)
        maps = {name: {tuple(k): tuple(v) for k, v in state.iterator()} for name, state in self.maps.items()}
        lists = {name: [tuple(v) for v in state.get()] for name, state in self.lists.items()}
        for name, value in (*maps.items(), *lists.items()):
            setattr(fold, name, value.copy())
        return fold, maps, {name: len(value) for name, value in lists.items()}

    def _store(self, fold: Fold, maps: dict, sizes: dict) -> None:
        if self.own is not None:
            self.own.update(tuple(getattr(fold, name) for name in self.names))
        for name, before in maps.items():
            now = getattr(fold, name)
            for k in before.keys() - now.keys():
                self.maps[name].removeKey(k)
            for k, value in now.items():
                if before.get(k) != tuple(value):
                    self.maps[name].updateValue(k, tuple(value))
        for name, size in sizes.items():
            fresh = [tuple(v) for v in getattr(fold, name)[size:]]
            if fresh:
                self.lists[name].appendList(fresh)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        own = sorted(rows, key=lambda r: (r["t"], r["seq"]))
        fold, maps, sizes = self._loaded()
        made = [out for r in own for out in fold.step(tuple(r[c] for c in self.columns))]
        self._store(fold, maps, sizes)
        self._wait(max(r[_STAMP] for r in own) + self.ttl, timerValues.getCurrentWatermarkInMs())
        for out in made[-1:] if self.latest else made:
            yield self.row(*key, *out)

    def _wait(self, ms: int, watermark: int) -> None:
        before = self.until.get()[0] if self.until.exists() else None
        ms = max(ms, watermark + 1, before or 0)
        if ms != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.until.update((ms,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        for state in (self.own, self.until, *self.maps.values(), *self.lists.values()):
            if state is not None:
                state.clear()
        return iter([])


def _columns_of(ddl: str) -> list[str]:
    """The columns of a DDL string; commas within brackets do not part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()] if ddl.strip() else []


def stream(rows: DataFrame, key: Sequence[str], make: Callable[[], Fold], event_time: str = "ts", delay: str | None = "30 seconds", ttl: timedelta = timedelta(hours=24)) -> DataFrame:
    """The stream's rows folded per key; `event_time` is a timestamp column beside t and seq. delay: None where the rows have
    a watermark already."""
    fold, spark = make(), rows.sparkSession
    if not any(getattr(fold, part, None) for part in ("state", "maps", "lists")):
        raise TypeError(f"{type(fold).__name__} declares no state")
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    marked = rows if delay is None else rows.withWatermark(event_time, delay)
    ready = marked.withColumn(_STAMP, F.unix_millis(F.col(event_time).cast("timestamp")))
    ready = ready.select(*dict.fromkeys([*key, "t", "seq", *fold.columns, event_time, _STAMP]))
    return ready.groupBy(*key).transformWithState(Folding(make, key, ttl), f"{kinds}, {fold.output}", "Update" if getattr(fold, "latest", False) else "Append", "EventTime")


def guarded(requests: DataFrame, by: Sequence[str], most: int, width: float = 60.0, skew: float = 120.0, nonce: str = r"^[0-9a-f]{16,64}$", event_time: str = "ts", delay: str = "240 seconds") -> DataFrame:
    """A stream of requests (nonce, sent, received, seq) behind its guards: well-formed nonces of small clock skew, each used
    once, and the first `most` of a sender's interval; with t, seq and allowed."""
    good = requests.filter((F.abs(F.col("received") - F.col("sent")) <= skew) & F.col("nonce").rlike(nonce)).withColumn("t", F.col("received").cast("double"))
    return stream(once(good, ["nonce"], event_time, delay), by, partial(RateLimit, most, width), event_time, None)


def once(rows: DataFrame, key: Sequence[str], event_time: str = "ts", delay: str = "240 seconds") -> DataFrame:
    """First row of each key within the watermark: event ids, nonces, or first firings."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def relearner(store: str, features: str, learn: Callable[[DataFrame], DataFrame], key: str = "camera_id", least: int = 5, most: int = 500, order: str = "t1") -> Callable[[DataFrame, int], None]:
    """A foreachBatch callback: adds a batch of track features to `features`, and learns anew the baselines of the cameras it
    holds from their latest `most` tracks, where there are `least` of them. `learn` may apply dismissals again."""

    def relearn(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch").parquet(features)
        known = batch.sparkSession.read.parquet(features).drop("__batch").join(batch.select(key).distinct(), key, "left_semi")
        newest, every = Window.partitionBy(key).orderBy(F.desc(order)), Window.partitionBy(key)
        chosen = known.withColumn("__n", F.row_number().over(newest)).withColumn("__all", F.count(F.lit(1)).over(every)).filter((F.col("__n") <= most) & (F.col("__all") >= least))
        learn(chosen.drop("__n", "__all")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(store)

    return relearn


def tumbling(rows: DataFrame, width: str, by: Sequence[str] = (), slide: str | None = None, event_time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Counts per window and key; late rows beyond the delay are left out."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return rows.withWatermark(event_time, delay).groupBy(w.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def enriched(events: DataFrame, reasons: DataFrame, within: str = "20 seconds", delay: str = "30 seconds") -> DataFrame:
    """Events with a reason that came in time, else with their template: a stream-stream left join on event_id."""
    e = events.withWatermark("ts", delay).alias("e")
    r = reasons.withWatermark("reason_ts", delay).alias("r")
    near = F.expr(f"e.event_id = r.event_id AND r.reason_ts BETWEEN e.ts AND e.ts + INTERVAL {within}")
    return e.join(r, near, "left_outer").select("e.*", F.coalesce("r.reason", "e.template").alias("reason"), F.when(F.col("r.reason").isNull(), "template").otherwise("model").alias("reason_source"))


def deliver(rows: DataFrame, write: Callable[[DataFrame], None], ledger: str, key: str, checkpoint: str):
    """At-least-once delivery made idempotent: each micro-batch writes only keys that the ledger table lacks, then records them."""
    spark = rows.sparkSession

    def send(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(ledger).select(key), key, "left_anti")
        except Exception as error:  # the ledger's first write
            if "PATH_NOT_FOUND" not in str(error):
                raise
        kept = fresh.persist()
        write(kept)
        kept.select(key).write.mode("append").parquet(ledger)
        kept.unpersist()

    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

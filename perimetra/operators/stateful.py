"""Order-dependent folds, written once per key as small state machines.

Each fold takes rows in (t, seq) order and yields output rows. `batch` runs a fold over sorted, key-partitioned data
without holding a group in memory; `perimetra.streaming` runs the same fold with stored state.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial
from typing import ClassVar, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.operators import ranging
from perimetra.sources.store import settled


class Fold(Protocol):
    """State of one key. `columns` are read, `output` (DDL without the key) is what step yields.

    For streams a fold names its state: `state` (DDL) are attributes that hold one value, `maps` attributes that hold a
    dictionary of tuples to sequences (DDL of key and value), `lists` attributes that only grow (DDL of their tuples).
    With `latest` only a key's last output of a trigger counts.
    """

    columns: Sequence[str]
    output: str
    state: str
    maps: Mapping[str, tuple[str, str]]
    lists: Mapping[str, str]
    latest: bool

    def step(self, row: tuple) -> Iterator[tuple]: ...


def batch(rows: DataFrame, key: Sequence[str], make: Callable[[], Fold], order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """All keys folded in order; rows stream through sorted partitions, so a group of any size needs only its state."""
    fold = make()
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    names = [*key, *(x.strip().split()[0] for x in fold.output.split(","))]
    columns = list(dict.fromkeys([*key, *fold.columns, *order]))
    ready = rows.select(*columns).repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            new = (pdf[list(key)] != pdf[list(key)].shift()).any(axis=1).to_numpy()
            rows = list(pdf[list(fold.columns)].itertuples(index=False, name=None))
            cuts = [*np.flatnonzero(new).tolist(), len(pdf)]
            heads = zip(*[pdf[c].iloc[cuts[:-1]].tolist() for c in key], strict=True)
            for a, b, k in zip(cuts[:-1], cuts[1:], heads, strict=True):
                if k != now:
                    now, state = k, make()
                out += [(*k, *made) for row in rows[a:b] for made in state.step(row)]
            yield pd.DataFrame(out, columns=names)

    return ready.mapInPandas(run, f"{kinds}, {fold.output}")


class Sampler:
    """Keeps a frame when its media time reaches the next slot of 1 / fps; a late frame moves the slots on, not back."""

    columns, output, state = ("t", "seq"), "seq long, t double", "slot double"

    def __init__(self, fps: float) -> None:
        self.gap, self.slot = 1.0 / fps, None

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq = row
        if self.slot is None or t + 1e-9 >= self.slot:
            base = t if self.slot is None else self.slot
            self.slot = max(base + self.gap, t + self.gap / 2)
            yield seq, t


class MinGap:
    """Drops frames that come less than `gap` after the last one kept."""

    columns, output, state = ("t", "seq"), "seq long, t double", "last double"

    def __init__(self, gap: float) -> None:
        self.gap, self.last = gap, None

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq = row
        if self.last is None or t - self.last >= self.gap:
            self.last = t
            yield seq, t


#: Flow inside moving objects and of the background, in pixels, as measured by day and by night; and the gates. Fixed values.
MEASURED_FLOW = {"visible": (5.17, 2.74), "lwir": (2.73, 0.81)}
THRESHOLD, A_MIN, M_MIN, IOU_MIN, OLDEST = 0.55, 0.15, 0.25, 0.2, 2


def modality_weights(motion: Mapping[str, float] | None = None) -> dict[str, tuple[float, float]]:
    """Weights of appearance and motion by modality: motion counts by the share of an object's flow that is not background,
    unless `motion` sets it."""
    shares = {name: round(1 - background / inside, 4) for name, (inside, background) in MEASURED_FLOW.items()} | dict(motion or {})
    return {name: (round(1 - share, 4), share) for name, share in shares.items()}


def judged(rows: DataFrame, frames: DataFrame | None = None, threshold: float = THRESHOLD, a_min: float = A_MIN, m_min: float = M_MIN, iou_min: float = IOU_MIN, oldest: int = OLDEST, weights: Mapping[str, tuple[float, float]] | None = None, by: Sequence[str] = ("camera_id", "track_id")) -> DataFrame:
    """Candidates (appearance, age, motion, iou, modality, t, seq) with fused, fused_day, fused_night, agree and status, and
    what `Fusion` reads beside: the camera's frame number and the time of its frame before.

    frames: the camera's frames (by[0], t) with their status (see `camera_state.judged_frames`); without them the rows'
    own times, and the rows' own status if they have one, else ok. An appearance of more than `oldest` frames counts as 0;
    a null motion means that there was none to measure yet. Rows may have a `threshold` of their own. Two signals agree if
    both reach their floors, the box overlaps the motion, the sum weighted by modality (any but lwir is visible) reaches
    the threshold, and the status is ok.
    """
    weights = weights or modality_weights()
    appearance = F.round(F.when(F.col("age") <= oldest, F.col("appearance")).otherwise(0.0), 4)
    motion, night = F.coalesce(F.round("motion", 4), F.lit(0.0)), F.coalesce(F.col("modality") == "lwir", F.lit(False))
    day_sum, night_sum = (weights[m][0] * appearance + weights[m][1] * motion for m in ("visible", "lwir"))
    camera = Window.partitionBy(by[0]).orderBy("t")
    own = rows if "status" in rows.columns else rows.withColumn("status", F.lit("ok"))
    if frames is None:
        frames = own.select(by[0], "t").distinct()
    else:
        frames = frames.groupBy(by[0], "t").agg(F.coalesce(F.max(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok")).alias("status"))
        own = own.drop("status")
    numbered = frames.withColumn("frame", F.row_number().over(camera)).withColumn("before", F.lag("t").over(camera))
    limit = F.coalesce("threshold", F.lit(threshold)) if "threshold" in rows.columns else F.lit(threshold)
    status = F.when(F.col("motion").isNull() & (F.col("status") == "ok"), "no_motion_yet").otherwise(F.col("status"))
    met = own.withColumns({"fused_day": day_sum, "fused_night": night_sum, "fused": F.when(night, night_sum).otherwise(day_sum)}).join(numbered, [by[0], "t"]).withColumn("status", status)
    agree = (appearance >= a_min) & (motion >= m_min) & (F.col("iou") >= iou_min) & (F.col("fused") >= limit) & (F.col("status") == "ok")
    return met.withColumn("agree", F.coalesce(agree, F.lit(False)))


class Fusion:
    """A track fires once its two signals have agreed on `streak` of the camera's frames in a row.

    It is armed again by a frame on which they disagree `rearm` seconds or more after the first disagreement since it
    fired, if no agreement lies between. A frame without the track ends a streak but is no disagreement; a track that is
    away for more than `rearm` and `away` seconds is forgotten. best_seq is the row of the streak's best fused score so far.
    """

    columns, output = ("t", "seq", "agree", "fused", "frame", "before"), "seq long, t double, streak long, started double, best_seq long, best double"
    state = "frame long, seen double, run long, started double, broken double, fired boolean, best struct<seq:long,fused:double>"

    def __init__(self, streak: int = 3, rearm: float = 10.0, away: float = 30.0) -> None:
        self.need, self.rearm, self.away, self.frame, self.seen = streak, rearm, max(rearm, away), None, None
        self.forget()

    def forget(self) -> None:
        self.run, self.started, self.broken, self.fired, self.best = 0, None, None, False, None

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq, agree, fused, frame, before = row
        if self.frame is not None and frame > self.frame + 1:  # the camera had frames without this track
            self.run, self.best = 0, None
            if before - self.seen > self.away:
                self.forget()
        self.frame, self.seen = frame, t
        if agree:
            self.started = self.started if self.run else t
            self.run, self.broken = self.run + 1, None
            if self.best is None or fused > self.best[1]:
                self.best = seq, fused
            if self.run >= self.need and not self.fired:
                self.fired = True
                yield seq, t, self.run, self.started, *self.best
            return
        self.run, self.best = 0, None
        if self.fired:
            self.broken = t if self.broken is None else self.broken
            if t - self.broken >= self.rearm:
                self.fired, self.broken = False, None


class Hysteresis:
    """Raises after `persist` hits in a row, clears after `clear` misses in a row."""

    columns, output, state = ("t", "seq", "hit"), "seq long, t double, event string", "hits long, misses long, active boolean"

    def __init__(self, persist: int = 3, clear: int = 5) -> None:
        self.persist, self.clear, self.hits, self.misses, self.active = persist, clear, 0, 0, False

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq, hit = row
        self.hits, self.misses = (self.hits + 1, 0) if hit else (0, self.misses + 1)
        if not self.active and self.hits >= self.persist:
            self.active = True
            yield seq, t, "raised"
        elif self.active and self.misses >= self.clear:
            self.active = False
            yield seq, t, "cleared"


class Throttle:
    """Repeats fold into their alert; new alerts are admitted within a budget per camera and day and one per shift over all cameras.

    The shift's budget couples all cameras, so one key holds a whole site.
    """

    columns = ("t", "seq", "camera_id", "track_id", "rule")
    output = "seq long, t double, camera_id long, track_id long, rule string, decision string, repeats long"
    maps: ClassVar = {"alerts": ("camera_id long, track_id long, rule string", "first double, last double, repeats long")}

    def __init__(self, per_camera: int = 5, per_shift: int = 12, day: float = 86400.0, shift: float = 43200.0) -> None:
        self.per_camera, self.per_shift, self.day, self.shift = per_camera, per_shift, day, shift
        self.alerts: dict[tuple, tuple] = {}  # first fired, last fired, repeats

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq, camera, track, rule = row
        key = (camera, track, rule)
        self.alerts = {k: v for k, v in self.alerts.items() if t - v[1] <= self.day}
        if key in self.alerts:
            first, _, repeats = self.alerts[key]
            self.alerts[key] = (first, t, repeats + 1)
            yield seq, t, camera, track, rule, "repeat", repeats + 1
            return
        own = sum(k[0] == camera and t - v[0] <= self.day for k, v in self.alerts.items())
        every = sum(t - v[0] <= self.shift for v in self.alerts.values())
        if own < self.per_camera and every < self.per_shift:
            self.alerts[key] = (t, t, 1)
            yield seq, t, camera, track, rule, "admitted", 1
        else:
            yield seq, t, camera, track, rule, "dropped", 0


class DueSchedule:
    """Runs the detector on every `stride`-th frame, or earlier when `longest` seconds have passed since it last ran."""

    columns, output, state = ("t", "seq"), "seq long, t double", "since long, last double"

    def __init__(self, stride: int = 3, longest: float = 0.125) -> None:
        self.stride, self.longest, self.since, self.last = stride, longest, 0, None

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq = row
        self.since += 1
        if self.last is None or self.since >= self.stride or t - self.last >= self.longest:
            self.since, self.last = 0, t
            yield seq, t


class Leaders:
    """Clusters 64-bit hashes: each joins the first leader within `most` bits, or leads."""

    columns, output = ("seq", "hash"), "seq long, leader long"
    lists: ClassVar = {"leaders": "seq long, hash long"}

    def __init__(self, most: int = 10) -> None:
        self.most, self.leaders, self.hashes, self.filled = most, [], np.zeros(64, np.uint64), 0

    def step(self, row: tuple) -> Iterator[tuple]:
        seq, value = int(row[0]), np.uint64(int(row[1]) & (2**64 - 1))
        n = len(self.leaders)
        if n > len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(n, np.uint64)))
        for k in range(self.filled, n):
            self.hashes[k] = np.uint64(self.leaders[k][1] & (2**64 - 1))
        self.filled = n
        near = np.bitwise_count(self.hashes[:n] ^ value) <= self.most
        if near.any():
            yield seq, self.leaders[int(near.argmax())][0]
            return
        self.leaders.append((seq, int(row[1])))
        yield seq, seq


class RateLimit:
    """The first `most` rows of each interval of `width` seconds are allowed; intervals that are `behind` the newest are forgotten."""

    columns, output = ("t", "seq"), "seq long, t double, allowed boolean"
    maps: ClassVar = {"used": ("slot long", "n long")}

    def __init__(self, most: int, width: float = 60.0, behind: int = 10) -> None:
        self.most, self.width, self.behind = most, width, behind
        self.used: dict[tuple, tuple] = {}

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq = row
        slot = math.floor(t / self.width)
        n = self.used.get((slot,), (0,))[0] + 1
        self.used[(slot,)] = (n,)
        newest = max(k[0] for k in self.used)
        self.used = {k: v for k, v in self.used.items() if k[0] > newest - self.behind}
        yield seq, t, n <= self.most


class LiveAlert:
    """A track's one alert, event by event, as `serving.merge_alerts` makes it of all events at once, whatever their order.

    It yields the alert after each event. What the order of events decides is kept with the place (t, seq) it came from.
    """

    columns = ("t", "seq", "event_id", "stage", "evidence_id", "rules", "reason", "reason_source", "confidence")
    output = "event_id string, events long, stage string, rule_fired string, reason string, evidence_id string, confidence double"
    state = "first struct<t:double,seq:long,value:string>, events long, rank int, best struct<model:boolean,t:double,seq:long,value:string>, proof struct<t:double,seq:long,value:string>, sure struct<t:double,seq:long,value:double>"
    maps: ClassVar = {"fired": ("rule string", "t double, seq long, place int")}
    latest = True

    def __init__(self, stages: Sequence[str] = ("provisional", "confirmed", "sealed", "gone")) -> None:
        self.stages = tuple(stages)
        self.first = self.best = self.proof = self.sure = None
        self.events, self.rank = 0, 0
        self.fired: dict[tuple, tuple] = {}

    def step(self, row: tuple) -> Iterator[tuple]:
        t, seq, event, stage, evidence, rules, reason, source, confidence = row
        at = (t, seq)
        self.events += 1
        if self.first is None or at < tuple(self.first[:2]):
            self.first = (*at, event)
        unproven = stage == "sealed" and evidence is None
        self.rank = max(self.rank or 0, 2 if unproven else self.stages.index(stage) + 1 if stage in self.stages else 0)
        told = (source != "template", *at)
        if reason is not None and (self.best is None or told > tuple(self.best[:3])):
            self.best = (*told, reason)
        if evidence is not None and (self.proof is None or at < tuple(self.proof[:2])):
            self.proof = (*at, evidence)
        if confidence is not None and (self.sure is None or at > tuple(self.sure[:2])):
            self.sure = (*at, float(confidence))
        for place, rule in enumerate(rules or ()):
            if (rule,) not in self.fired or (*at, place) < tuple(self.fired[(rule,)]):
                self.fired[(rule,)] = (*at, place)
        named = [rule for (rule,), _ in sorted(self.fired.items(), key=lambda kv: tuple(kv[1]))]
        last = lambda kept: kept[-1] if kept is not None else None
        yield self.first[2], self.events, self.stages[self.rank - 1] if self.rank else None, " + ".join(named), last(self.best), last(self.proof), last(self.sure)


def match_in_time(truth: DataFrame, found: DataFrame, by: Sequence[str], tolerance: float, reach: float | None = None) -> DataFrame:
    """One-to-one matches of two event lists (id, t, and with `reach` x and y): earliest truth first takes the free
    detection nearest in time within the tolerance, and within `reach` of its place; of equals the smallest id."""
    place = ("x", "y") if reach is not None else ()

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=[*by, "truth_id", "found_id", "gap"])
        b.columns = a.columns
        a, b = a.sort_values(["t", "id"]), b.sort_values(["t", "id"])
        times, rows, out = b["t"].tolist(), list(b[["id", *place]].itertuples(index=False, name=None)), []
        for i, t, *at in a[["id", "t", *place]].itertuples(index=False, name=None):
            low, high = bisect.bisect_left(times, t - tolerance - 1e-9), bisect.bisect_right(times, t + tolerance + 1e-9)
            near = [(abs(times[k] - t), rows[k][0], k) for k in range(low, high) if abs(times[k] - t) <= tolerance and (reach is None or math.dist(at, rows[k][1:]) <= reach)]
            if near:
                gap, j, k = min(near)
                del times[k], rows[k]
                out.append((*key, i, j, gap))
        return pd.DataFrame(out, columns=[*by, "truth_id", "found_id", "gap"])

    kinds = ", ".join(f"{k} {truth.schema[k].dataType.simpleString()}" for k in by)
    columns = [*by, "id", "t", *place]
    other = found.select(*[F.col(c).alias(f"found_{c}") for c in columns])  # both may stem from one frame, so their columns must differ
    return truth.select(*columns).groupBy(*by).cogroup(other.groupBy(*[f"found_{c}" for c in by])).applyInPandas(one, f"{kinds}, truth_id long, found_id long, gap double")


class NearestPairs:
    """Of pairs that come nearest first, those whose two sides are both still free."""

    columns, output = ("truth_id", "found_id", "gap"), "truth_id long, found_id long, gap double"
    lists: ClassVar = {"taken": "truth_id long, found_id long"}

    def __init__(self) -> None:
        self.taken: list[tuple] = []
        self.truth, self.found = set(), set()

    def step(self, row: tuple) -> Iterator[tuple]:
        if len(self.truth) != len(self.taken):
            self.truth, self.found = {t for t, _ in self.taken}, {f for _, f in self.taken}
        truth, found, gap = int(row[0]), int(row[1]), row[2]
        if truth not in self.truth and found not in self.found:
            self.taken.append((truth, found))
            self.truth.add(truth)
            self.found.add(found)
            yield truth, found, gap


#: Parts of the tolerance within which events are matched, one after the other.
SCALES = (1 / 4096, 1 / 512, 1 / 64, 1 / 8, 1)


def match_nearest(truth: DataFrame, found: DataFrame, by: Sequence[str], tolerance: float, reach: float | None = None) -> DataFrame:
    """One-to-one matches of two event lists (id, t, and with `reach` x and y): the pairs nearest in time, and within
    `reach` of each other, are taken first; of equals the earlier truth, then the smaller ids.

    Pairs of small gaps come before all others, so the gaps grow step by step and what is matched takes no part in the next
    step: in a crowd most are, long before their pairs within the whole tolerance would have to be listed.
    """
    place = ("x", "y") if reach is not None else ()
    left = truth.select(*by, F.col("id").cast("long").alias("truth_id"), "t", *place)
    right = found.select(*by, F.col("id").cast("long").alias("found_id"), "t", *[F.col(c).alias(f"{c}_found") for c in place])
    taken = None
    for share in SCALES:
        pairs = ranging.band_join(left, right, list(by), "t", tolerance * share)
        if reach is not None:
            pairs = pairs.filter(F.sqrt((F.col("x") - F.col("x_found")) ** 2 + (F.col("y") - F.col("y_found")) ** 2) <= reach)
        near = pairs.select(*by, "truth_id", "found_id", F.abs(F.col("t_right") - F.col("t")).alias("gap"), F.col("t").alias("truth_t"))
        own = batch(near, by, NearestPairs, ("gap", "truth_t", "truth_id", "found_id"))
        if share < 1:
            own = settled(own)
            left, right = settled(left.join(own, [*by, "truth_id"], "left_anti")), settled(right.join(own, [*by, "found_id"], "left_anti"))
        taken = own if taken is None else taken.unionByName(own)
    return taken


#: Square pixels by which an overlap must pass the threshold, so that rounding decides no tie.
TIE = 1e-9


class Suppress:
    """Greedy non-maximum suppression: a box, best first, stays if it overlaps no kept one by more than `iou`."""

    columns, output = ("id", "x1", "y1", "x2", "y2", "score"), "id long, x1 double, y1 double, x2 double, y2 double, score double"
    lists: ClassVar = {"kept": "x1 double, y1 double, x2 double, y2 double, area double"}

    def __init__(self, iou: float = 0.5, most: int = 300) -> None:
        self.iou, self.most, self.kept = iou, most, []

    def step(self, row: tuple) -> Iterator[tuple]:
        _, x1, y1, x2, y2, _ = row
        area = max(x2 - x1, 0.0) * max(y2 - y1, 0.0)
        if len(self.kept) >= self.most:
            return
        for a1, b1, a2, b2, other in self.kept:
            common = max(min(x2, a2) - max(x1, a1), 0.0) * max(min(y2, b2) - max(y1, b1), 0.0)
            if common > self.iou * max(area + other - common, 1e-12) + TIE:
                return
        self.kept.append((x1, y1, x2, y2, area))
        yield row


class SuppressGrid:
    """`Suppress` for several overlap limits in one pass: each box with those under which it stays.

    A box's bit for a limit is lost to any better box that has the bit and overlaps it by more than the limit. As limits
    ascend, an overlap takes the lowest so many bits.
    """

    columns = ("id", "x1", "y1", "x2", "y2", "score")
    output = "id long, x1 double, y1 double, x2 double, y2 double, score double, limits array<double>"

    def __init__(self, limits: Sequence[float], most: int = 300) -> None:
        self.limits, self.most = sorted(limits), most
        self.kept: list[tuple] = []
        self.count = [0] * len(self.limits)

    def step(self, row: tuple) -> Iterator[tuple]:
        _, x1, y1, x2, y2, _ = row
        area = max(x2 - x1, 0.0) * max(y2 - y1, 0.0)
        bits = sum(1 << k for k, n in enumerate(self.count) if n < self.most)
        for a1, b1, a2, b2, other, own in self.kept:
            common = max(min(x2, a2) - max(x1, a1), 0.0) * max(min(y2, b2) - max(y1, b1), 0.0)
            union = max(area + other - common, 1e-12)
            passed = sum(common > limit * union + TIE for limit in self.limits) if common > 0 else 0
            bits &= ~(own & ((1 << passed) - 1))
            if not bits:
                return
        self.kept.append((x1, y1, x2, y2, area, bits))
        held = [k for k in range(len(self.limits)) if bits >> k & 1]
        for k in held:
            self.count[k] += 1
        if held:
            yield (*row, [self.limits[k] for k in held])


def _over(box: np.ndarray, a: np.ndarray, b: np.ndarray, iou: float) -> np.ndarray:
    """Which boxes numbered in a overlap those in b by more than `iou`. box: x1, y1, x2, y2 and area, a row each."""
    x1, y1, x2, y2, area = box
    common = np.maximum(np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b]), 0.0) * np.maximum(np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]), 0.0)
    return common > iou * np.maximum(area[a] + area[b] - common, 1e-12) + TIE


def kept_boxes(group: np.ndarray, box: np.ndarray, iou: float, most: int, earlier: np.ndarray) -> np.ndarray:
    """The numbers of the boxes that `Suppress` keeps; group: rising numbers from 0, the best box of a group first; earlier:
    the numbers, outside `group`, of boxes that group 0 has kept before.

    The first box that is left in each group stays, and what overlaps it goes, in all groups at once: there are as many
    rounds as a group keeps boxes, whatever it holds.
    """
    left, kept = np.arange(len(group)), []
    for k in earlier:
        mine = left[: np.searchsorted(group[left], 0, "right")]
        left = np.concatenate((mine[~_over(box, mine, np.full(len(mine), k), iou)], left[len(mine) :]))
    for n in range(most):
        if n + len(earlier) >= most:
            left = left[group[left] > 0]
        if not len(left):
            break
        first = np.flatnonzero(np.diff(group[left], prepend=-1))
        kept.append(left[first])
        own = np.repeat(left[first], np.diff(first, append=len(left)))
        left, own = left[left != own], own[left != own]
        left = left[~_over(box, left, own, iou)]
    return np.sort(np.concatenate(kept)) if kept else left[:0]


def _suppressed(boxes: DataFrame, by: Sequence[str], limits: Sequence[float], most: int, carry: Sequence[str]) -> DataFrame:
    """The boxes that stay under some limit, with `limits`, those under which they do; `carry` are further columns.

    Sorted rows stream through, batch by batch; of the group that goes on in the next batch, what it has kept is held."""
    places = ("x1", "y1", "x2", "y2")
    columns = list(dict.fromkeys([*by, "id", *places, "score", *carry]))
    ranked = boxes.withColumns({"id": F.col("id").cast("long"), "__minus": -F.col("score"), **{c: F.col(c).cast("double") for c in (*places, "score")}}).select(*columns, "__minus")
    ready = ranked.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by, "__minus", "id", *places)
    grid = sorted(limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, [np.zeros((5, 0))] * len(grid)  # the last key, and what it has kept under each limit
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for c in by:
                value, before = pdf[c], pdf[c].shift()
                new |= ((value != before) & ~(value.isna() & before.isna())).to_numpy()
            ends = [tuple(None if pd.isna(pdf[c].iloc[at]) else pdf[c].iloc[at] for c in by) for at in (0, -1)]
            if ends[0] != now:
                held = [np.zeros((5, 0))] * len(grid)
            new[0] = False
            group = new.cumsum()
            x1, y1, x2, y2 = (pdf[c].to_numpy(float, na_value=np.nan) for c in places)
            box = np.stack((x1, y1, x2, y2, np.maximum(x2 - x1, 0.0) * np.maximum(y2 - y1, 0.0)))
            bits = np.zeros(len(pdf), np.int64)
            for at, limit in enumerate(grid):
                both = np.concatenate((box, held[at]), axis=1)
                stays = kept_boxes(group, both, limit, most, np.arange(len(group), both.shape[1]))
                bits[stays] |= 1 << at
                mine = box[:, stays[group[stays] == group[-1]]]
                held[at] = np.concatenate((held[at], mine), axis=1) if group[-1] == 0 else mine
            now = ends[1]
            found = pdf[bits > 0].drop(columns="__minus")
            lists = {b: [v for k, v in enumerate(grid) if b >> k & 1] for b in np.unique(bits).tolist()}
            yield found.assign(limits=pd.Series([lists[b] for b in bits[bits > 0].tolist()], found.index, object))

    kinds = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ready.mapInPandas(run, f"{kinds}, limits array<double>")


def nms(boxes: DataFrame, by: Sequence[str], iou: float = 0.5, most: int = 300, carry: Sequence[str] = ()) -> DataFrame:
    """Boxes (id, x1, y1, x2, y2, score, and the columns of `carry`) that are kept in each group, at most `most`; equal scores
    go by id, then by place."""
    return _suppressed(boxes, by, (iou,), most, carry).drop("limits")


def nms_grid(boxes: DataFrame, by: Sequence[str], limits: Sequence[float], most: int = 300) -> DataFrame:
    """Each box (id, x1, y1, x2, y2, score) that is kept under some limit, with `limits`, all those under which `nms` keeps it."""
    return _suppressed(boxes, by, limits, most, ())


class Dismissals:
    """A camera's baseline after each dismissal: wrong-direction ones turn the heading, loitering ones move the dwell, by `rate`."""

    columns, output = ("seq", "rule", "heading", "dwell"), "seq long, majority double, typical_dwell double, dismissals long"
    state = "majority double, dwell double, count long"

    def __init__(self, majority: float | None = None, typical_dwell: float = 0.0, rate: float = 0.15) -> None:
        self.majority, self.dwell, self.rate, self.count = majority, typical_dwell, rate, 0

    def step(self, row: tuple) -> Iterator[tuple]:
        seq, rule, heading, dwell = row
        if rule == "wrong direction" and heading == heading and heading is not None:
            if self.majority is None:
                self.majority = heading
            else:
                a, b = math.radians(self.majority), math.radians(heading)
                y = (1 - self.rate) * math.sin(a) + self.rate * math.sin(b)
                x = (1 - self.rate) * math.cos(a) + self.rate * math.cos(b)
                self.majority = math.degrees(math.atan2(y, x)) % 360.0
        if rule == "loitering":
            self.dwell = (1 - self.rate) * self.dwell + self.rate * dwell
        self.count += 1
        yield seq, self.majority, self.dwell, self.count

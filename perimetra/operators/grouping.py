"""Groups of tracks that stay close together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.operators import tracks


#: Points that are compared with each other at once; more are halved.
FEW = 64


def _near(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether a point of a is within the radius of one of b: boxes too far apart or close as a whole tell at once, others are halved."""
    open_ = [(a, b)]
    while open_:
        a, b = open_.pop()
        low, high = np.maximum(a.min(0), b.min(0)) - np.minimum(a.max(0), b.max(0)), np.maximum(a.max(0), b.max(0)) - np.minimum(a.min(0), b.min(0))
        if np.hypot(*np.maximum(low, 0.0)) > radius * (1 + 1e-9):
            continue
        if np.hypot(*high) < radius * (1 - 1e-9):
            return True
        if len(a) <= FEW and len(b) <= FEW:
            dx, dy = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
            if (np.sqrt(dx * dx + dy * dy) <= radius).any():
                return True
            continue
        swap = len(a) < len(b)
        long, other = (b, a) if swap else (a, b)
        axis = int(np.ptp(long, axis=0).argmax())
        long = long[np.argsort(long[:, axis], kind="stable")]
        open_ += [(half, other) for half in (long[: len(long) // 2], long[len(long) // 2 :])]
    return False


def _clusters(pdf: pd.DataFrame, radius: float, least: int) -> pd.DataFrame:
    """Connected members (member, px, py) of one instant, sets of `least` at least.

    Points of one square are within the radius of each other, so only squares are linked: memory grows with the points,
    not with the pairs that are near.
    """
    place = pdf[["px", "py"]].to_numpy(float)
    side = radius / 1.5
    cells = np.floor(place / side).astype(np.int64)
    found, at = np.unique(cells, axis=0, return_inverse=True)
    at = at.reshape(-1)
    order = np.argsort(at, kind="stable")
    held = np.split(place[order], np.cumsum(np.bincount(at, minlength=len(found)))[:-1])
    number = {(int(i), int(j)): k for k, (i, j) in enumerate(found)}
    top = list(range(len(found)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for (i, j), k in number.items():
        for di, dj in ((0, 1), (0, 2), (1, -2), (1, -1), (1, 0), (1, 1), (1, 2), (2, -2), (2, -1), (2, 0), (2, 1), (2, 2)):
            other = number.get((i + di, j + dj))
            if other is not None and find(k) != find(other) and _near(held[k], held[other], radius):
                top[find(other)] = find(k)
    roots = np.array([find(k) for k in range(len(found))])[at]
    sets = [sorted(own) for _, own in pdf["member"].groupby(roots) if len(own) >= least]
    return pd.DataFrame([(pdf["scope"].iloc[0], pdf["at"].iloc[0], own) for own in sets], columns=["scope", "at", "members"])


def groups(points: DataFrame, radius: float, min_size: int = 4, persist: float = 5.0, step: float = 0.5, key: Sequence[str] = tracks.KEY, scope: Sequence[str] = ("camera_id",)) -> DataFrame:
    """scope, members, first_at, last_at, duration of exact sets of tracks that form a cluster (close to another member by at most `radius`) for `persist` seconds.

    Tracks are sampled every `step` seconds from the scope's first point on; radius and positions are in one unit.
    """
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in scope])
    spans = points.groupBy(*scope).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    ticks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0") + 1e-9) / step))
    grid = spans.select(name.alias("scope"), F.explode(ticks).alias("k"), "t0").select("scope", (F.col("t0") + F.col("k") * step).alias("at"))
    member = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    at = tracks.interpolated(points.withColumn("scope", name).withColumn("member", member), grid, ("scope", "member"), "scope")
    finite = [F.abs(c) < float("inf") for c in ("px", "py")]  # neither null nor NaN
    placed = at.filter(finite[0] & finite[1]).select("scope", "at", "member", "px", "py")
    found = placed.groupBy("scope", "at").applyInPandas(partial(_clusters, radius=radius, least=max(min_size, 2)), "scope string, at double, members array<string>")
    big = found.groupBy("scope", "members").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return big.withColumn("duration", F.col("last_at") - F.col("first_at")).filter(F.col("duration") >= persist)

"""Interval statistics, as column expressions where a closed form exists and as numpy code elsewhere."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null without trials."""
    p, nn = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    middle = (p + z * z / (2 * nn)) / (1 + z * z / nn)
    reach = z / (1 + z * z / nn) * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    return F.greatest(middle - reach, F.lit(0.0)), F.least(middle + reach, F.lit(1.0))


def _poisson_below(k: int, mean: float) -> float:
    """P(X <= k)."""
    if mean <= 0:
        return 1.0
    if k >= MANY:
        return _poisson_below_many(k, mean)
    logs = [-mean + i * math.log(mean) - math.lgamma(i + 1) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


#: Counts from which only the terms that a double can tell from 0 are summed, and how many deviations from the mean these reach.
MANY, REACH = 500, 40


def _poisson_below_many(k: int, mean: float) -> float:
    """P(X <= k) from the largest term that counts, both ways: some multiple of the mean's root of terms."""
    if mean < k / 5:  # what is left out is below e**-400
        return 1.0
    peak = min(k, int(mean))
    x, series = (mean - peak) / peak, 1 / (12 * peak) - 1 / (360 * peak**3)
    log = -peak * (x - math.log1p(x)) - series - 0.5 * math.log(2 * math.pi * peak)
    reach = int(REACH * math.sqrt(mean)) + 100
    down = np.cumsum(np.log(np.arange(peak, max(0, peak - reach), -1) / mean))
    up = np.cumsum(-np.log(np.arange(peak + 1, min(k, peak + reach) + 1) / mean))
    return min(1.0, math.exp(log) * (1.0 + float(np.exp(down).sum()) + float(np.exp(up).sum())))


def _solve(low: float, high: float, falls: bool, goal: float, of) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):  # nothing lies between
            break
        if (of(middle) > goal) == falls:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def poisson_interval(k: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact (Garwood) interval of a Poisson mean, by bisection."""
    top = k + 10 * math.sqrt(k + 1) + 20
    low = 0.0 if k == 0 else _solve(0.0, top, False, alpha / 2, lambda m: 1 - _poisson_below(k - 1, m))
    return low, _solve(0.0, top, True, alpha / 2, lambda m: _poisson_below(k, m))


def poisson_upper(k: int, alpha: float = 0.05) -> float:
    """One-sided upper bound; 3.0 for no event."""
    return 3.0 if k == 0 else _solve(0.0, k + 10 * math.sqrt(k + 1) + 20, True, alpha, lambda m: _poisson_below(k, m))


#: Upper bound of a mean after no event, as a rule of thumb, and the chance beyond a one-sided bound.
RULE_OF_THREE, TAIL = 3.0, 0.05


def frames_needed(budget: float, count: int = 0) -> int:
    """Frames with `count` events that would show a rate within the budget."""
    return math.ceil(poisson_upper(count) / budget)


def poisson_below(k: Column, mean: float) -> Column:
    """P(X <= k) of a Poisson variable."""
    first = F.struct(F.lit(-mean).alias("log"), F.lit(math.exp(-mean)).alias("sum"))
    add = lambda a, i: F.struct((a["log"] + F.log(mean / i)).alias("log"), (a["sum"] + F.exp(a["log"] + F.log(mean / i))).alias("sum"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, first, add)["sum"]


def poisson_uppers(k: Column) -> Column:
    """`poisson_upper` of a column of counts."""
    return F.pandas_udf(lambda values: values.map(lambda v: poisson_upper(int(v))).astype(float), "double")(k)


def poisson_columns(k: Column) -> Column:
    """low and high of the exact interval, as a struct."""

    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([poisson_interval(int(v)) for v in values], columns=["low", "high"])

    return F.pandas_udf(of, "low double, high double")(k)


def ap_of(conf: np.ndarray, hits: np.ndarray, misses: np.ndarray, n_gt: float) -> float:
    """Area under the precision envelope at 101 recalls for weighted counts of right and wrong predictions by confidence."""
    order = np.argsort(-conf, kind="stable")
    tp, fp = np.cumsum(hits[order]), np.cumsum(misses[order])
    recall = np.concatenate(([0.0], tp / n_gt, [1.0]))
    precision = np.concatenate(([1.0], tp / np.maximum(tp + fp, 1e-16), [0.0]))
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    marks = np.linspace(0, 1, 101)
    return float(np.trapezoid(np.interp(marks, recall, envelope), marks))


def _split(counts: pd.DataFrame) -> tuple[np.ndarray, ...]:
    real = (counts["conf"] >= 0).to_numpy()
    return (real, *(counts[c].to_numpy(float) for c in ("conf", "hits", "misses", "n_gt")))


def plain_ap(counts: pd.DataFrame) -> float:
    real, conf, hits, misses, n_gt = _split(counts)
    return ap_of(conf[real], hits[real], misses[real], n_gt.sum()) if n_gt.sum() > 0 else float("nan")


def poisson_bootstrap_ap(counts: pd.DataFrame, replicates: int, seed: str) -> np.ndarray:
    """AP of each replicate of counts (cluster, conf, hits, misses, n_gt; conf -1 counts ground truth), clusters weighted by
    draws that depend on their name, the replicate and the seed; NaN where no ground truth is drawn."""
    real, conf, hits, misses, n_gt = _split(counts)
    names, at = np.unique(counts["cluster"].astype(str).to_numpy(), return_inverse=True)
    start = [int.from_bytes(hashlib.sha256(f"{seed}:{n}".encode()).digest()[:8], "big") for n in names]
    weights = np.stack([np.random.default_rng(s).poisson(1.0, replicates) for s in start])
    out = np.full(replicates, np.nan)
    for r in range(replicates):
        w = weights[at, r].astype(float)
        total = float((w * n_gt).sum())
        if total > 0:
            out[r] = ap_of(conf[real], (w * hits)[real], (w * misses)[real], total)
    return out


def percentile_interval(values: np.ndarray, level: float = 0.95, least: int = 20) -> tuple[float | None, float | None]:
    if len(values) < least:
        return None, None
    tail = (1 - level) / 2 * 100
    return float(np.percentile(values, tail)), float(np.percentile(values, 100 - tail))


def truncated(value: Column, digits: int = 4) -> Column:
    """Cut, not rounded, to some decimal places, as a decimal."""
    return (F.floor(value.cast("decimal(28,12)") * 10**digits) / 10**digits).cast(f"decimal(18,{digits})")


def motion_weight(background: Column, objects: Column) -> Column:
    """Share of trust in motion: 1 - background / objects, to 4 places, halves to even."""
    return F.bround(F.greatest(F.lit(0.0), 1 - background / F.nullif(objects, F.lit(0.0))), 4)

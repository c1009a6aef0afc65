"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree to one feature's bins and adds it, damped, to
that feature's lookup table. Pairs with the strongest remaining interaction are boosted alike on their bin grids. A
score is the sum of one entry of each table, read for whole batches at once.

The tables are learned from at most TRAIN_ROWS labelled texts, those first by a hash of their doc_id; every text is
scored whole. Inputs are counts over the text alone.

Edge cases: null and empty texts have all-zero features and are scored like any; texts without a label, with a null one
or with contradictory ones teach nothing; of several texts under one doc_id the first by hash teaches; with no label or one class only, every score is that class's share (0.5
without labels); rows without a doc_id and repeated rows are scored, held_out being null without a doc_id; ties in a
split go to the lower bin; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import joined, map_texts, span_counts, span_hashes, spans, spare_name

TRAIN_ROWS = 20_000
CUTOFF = 0.3
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAVES = 3

NAMES = (
    "log_bytes", "log_words", "mean_word", "long_words", "upper_words", "mixed_words", "digit_share", "symbol_share", "stop_share", "space_share", "beyond_ascii",
    "repeat_share", "longest_repeat", "distinct_share", "log_lines", "repeated_lines", "marked_words", "log_marked", "log_upper", "log_repeats", "bars", "top_word",
)
_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line, 6 stop, 7 symbol, 8 bar, 9 beyond ASCII
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r", 4), (b"\n", 5), (b".,;:'\"()-?", 6), (b"!#$%&*+/<=>@[\\]^_`{}~", 7), (b"|", 8)):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 9
_GAP = (_KIND == 4) | (_KIND == 5)


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text (cut at the offsets `first`), and how often its commonest one comes."""
    distinct, top = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for i in np.flatnonzero(np.diff(first)):
        own = np.sort(hashes[first[i] : first[i + 1]])
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        distinct[i], top[i] = len(ends), np.diff(ends, prepend=-1).max()
    return distinct, top


def features(texts: list[str | None]) -> np.ndarray:
    """Texts x NAMES, from counts of bytes, words (between white space) and lines.

    Bytes are counted block by block; only starts, ends, hashes and three counts of each word are held for the whole slice.
    """
    buffer, offsets = joined(texts)
    n = len(texts)
    bytes_of = np.diff(offsets) - 1
    size = np.maximum(bytes_of, 1).astype(float)
    full = np.flatnonzero(bytes_of)
    count = np.zeros((10, n))
    for k, found in span_counts(buffer, offsets[full], offsets[full + 1] - 1, _KIND, range(10)).items():
        count[k, full] = found

    start, end = spans(buffer, ~_GAP)
    first = np.searchsorted(start, offsets)
    words = np.diff(first)
    some = np.maximum(words, 1).astype(float)
    owner = np.repeat(np.arange(n, dtype=np.int32), words)
    inside = span_counts(buffer, start, end, _KIND, (1, 2, 7))
    upper = (inside[2] > 1) & (inside[1] == 0)
    mixed = (inside[2] > 1) & (inside[1] > 0)
    marked = inside[7] > 0
    hashes, length = span_hashes(buffer, start, end), end - start
    del inside, start, end
    same = np.zeros(len(hashes), np.bool_)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _repeats(hashes, first)
    run_start = np.flatnonzero(~same)
    longest = np.zeros(n)
    np.maximum.at(longest, owner[run_start], np.diff(run_start, append=len(hashes)))
    del hashes, run_start

    line_start, line_end = spans(buffer, _KIND != 5)
    line_first = np.searchsorted(line_start, offsets)
    lines = np.diff(line_first).astype(float)
    repeated_lines = lines - _repeats(span_hashes(buffer, line_start, line_end), line_first)[0]

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n)

    return np.column_stack((
        np.log1p(bytes_of), np.log1p(words), total(length) / some, total(length > 20) / some, total(upper) / some, total(mixed) / some,
        count[3] / size, count[7] / size, count[6] / size, (count[4] + count[5]) / size, count[9] / size,
        total(same) / some, np.log1p(longest), distinct / some, np.log1p(lines), repeated_lines / np.maximum(lines, 1), total(marked) / some,
        np.log1p(total(marked)), np.log1p(total(upper)), np.log1p(total(same)), np.log1p(count[8]), top / some,
    ))


def _shallow(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A step function over ordered bins that best fits gradient / weight, with at most `leaves` values."""
    out = np.zeros(len(gradient))
    spans = [(0, len(gradient))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for at, (a, b) in enumerate(spans):
            g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
            if b - a < 2:
                continue
            left, right = g[:-1] ** 2 / (w[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
            gain = left + right - g[-1] ** 2 / (w[-1] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], at, a + k + 1)
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


class AdditiveModel:
    """Bin edges and lookup tables, of single features and of pairs."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), np.int64)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for i, j, table in self.pairs:
            total += table[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Learn the tables from features and labels (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return AdditiveModel(float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -10, 10)))
    model = AdditiveModel(float(np.log(share / (1 - share))))
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="higher")))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    logit = model.logit(bins)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = residual()
            step = RATE * _shallow(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), LEAVES)
            table += step
            logit += step[bins[:, j]]
    g, h = residual()
    strength = []
    for i in range(x.shape[1]):
        for j in range(i):
            a, b = bins[:, i] * 4 // len(model.tables[i]), bins[:, j] * 4 // len(model.tables[j])
            cell = a * 4 + b
            sums, weights = np.bincount(cell, g, 16), np.bincount(cell, h, 16)
            strength.append((float((sums**2 / (weights + 1)).sum()), i, j))
    for _, i, j in sorted(strength, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))))
    for _ in range(PAIR_ROUNDS):
        for i, j, grid in model.pairs:
            g, h = residual()
            cell = bins[:, i] * grid.shape[1] + bins[:, j]
            sums, weights = np.bincount(cell, g, grid.size).reshape(grid.shape), np.bincount(cell, h, grid.size).reshape(grid.shape)
            rows = _shallow(sums.sum(1), weights.sum(1), 2)  # one cut across, then one along in each part
            step = np.zeros(grid.shape)
            for value in np.unique(rows):
                part = rows == value
                step[part] = RATE * _shallow(sums[part].sum(0), weights[part].sum(0), 2)[None, :]
            grid += step
            logit += step[bins[:, i], bins[:, j]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learn `label` (0 or 1) of the labelled documents that are not held out."""
    clear = labels.filter(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).filter("label = most")
    chosen = clear.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(F.broadcast(chosen), "doc_id")
    made = map_texts(texts, lambda t: {"x": features(t).tolist()}, "x array<double>", keep=("doc_id", "digest", "label"))
    one = made.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "digest").alias("of"))  # copies go before the driver sees them
    got = one.select("doc_id", "of.label", "of.x").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return fit(x, got["label"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, rows=rows)
    scored = map_texts(docs, lambda t: {"score": model.score(features(t))}, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier accepts, all columns kept."""
    model, name = train(docs, labels, rows=rows), spare_name(docs, "score")
    scored = map_texts(docs, lambda t: {name: model.score(features(t))}, f"{name} double", keep=docs.columns)
    return scored.filter(F.col(name) >= cutoff).select(docs.columns)

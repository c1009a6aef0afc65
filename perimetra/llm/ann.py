"""Approximate nearest neighbours by inner product with shifted space-filling curves.

Vectors, lifted so that the largest inner product is the nearest point, are projected onto a few random directions and
shifted; the Hilbert curve through that space gives each a key. Several projections give several orderings. Each
ordering is range-partitioned at quantiles of its keys into windows of about equal numbers of rows; ties of a key are
broken by a hash of the id, so that many equal vectors still spread. A query meets the rows of its own window and of the
neighbouring ones, in every ordering. A row is moved once for each ordering, whatever the number of queries: a task holds
a window of about WINDOW_ROWS rows while the queries that reach it stream past. The best of each window are merged in
two stages, by groups of MERGED windows and then by query, and ranked by the exact measure.

How many neighbouring windows are needed depends on the data. They are chosen on a sample of bounded size (documented
parameters) as the fewest that find `target` of the sample's true neighbours; every row is indexed.

Edge cases: vectors that are null, zero, of another length than the first usable one by id, or hold null or non-finite
components take no part; rows that repeat a vec_id count once, at their best score; ties go to the smaller vec_id; an
empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import block_visits, mix

ORDERINGS = 8
DIMENSIONS = 4
BITS = 12
TOP = 20
TARGET = 0.95
#: Rows and queries of the sample that windows are chosen on.
SAMPLE_ROWS = 6000
SAMPLE_QUERIES = 300
#: A window holds about so many rows at most; there are MIN_WINDOWS at least.
WINDOW_ROWS = 20_000
MIN_WINDOWS = 32
#: So many queries meet a window at once; a first merge joins the lists of so many neighbouring windows.
QUERIES_AT_ONCE = 256
MERGED = 64


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows x dimensions, `bits` each), by undoing its rotations bit by bit."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fold = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        fold ^= np.where((x[n - 1] >> np.uint64(bit)) & np.uint64(1), np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= fold
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key


class Curves:
    """Random projections, shifts and scales of each ordering; keys of vectors on its curves."""

    def __init__(self, width: int, longest: float, spread: np.ndarray | None = None, orderings: int = ORDERINGS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.axes = [np.linalg.qr(rng.normal(size=(width + 1, min(DIMENSIONS, width + 1))))[0] for _ in range(orderings)]
        self.shifts = [rng.uniform(0, 0.35, a.shape[1]) for a in self.axes]
        self.scales: list[tuple[np.ndarray, np.ndarray]] = []
        sample = self.lifted(spread) if spread is not None and len(spread) else np.zeros((1, width + 1))
        for axes in self.axes:
            at = sample @ axes
            low, high = np.quantile(at, [0.002, 0.998], axis=0)
            self.scales.append((low, np.maximum(high - low, 1e-12)))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """One more component, so that all have the length of the longest."""
        rest = np.sqrt(np.maximum(0, self.longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
        return np.column_stack((vectors, rest))

    def keys(self, vectors: np.ndarray, ids: np.ndarray, as_query: bool = False) -> np.ndarray:
        """Rows x orderings: curve position, then bits of the id's hash. Queries lie where a row of their direction would."""
        points = np.column_stack((vectors, np.zeros(len(vectors)))) if as_query else self.lifted(vectors)
        if as_query:
            points *= self.longest / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
        out = np.zeros((len(vectors), len(self.axes)), np.int64)
        for o, (axes, shift, (low, width)) in enumerate(zip(self.axes, self.shifts, self.scales, strict=True)):
            place = np.clip(((points @ axes - low) / width) * 0.65 + shift, 0, 1)
            key = hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
            tie = mix(ids.astype(np.uint64) + np.uint64(o)) & np.uint64(0x7FFF)
            out[:, o] = ((key << np.uint64(15)) | tie).view(np.int64)
        return out


def _usable(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in double precision, of the rows that take part."""
    good = [v is not None and i == i and len(v) == width for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True)]
    rows = pdf[good]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, width))
    vectors = np.array([np.asarray(v, dtype=np.float64) for v in rows["embedding"]])
    fine = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return rows["vec_id"].to_numpy(dtype=np.int64)[fine], vectors[fine]


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the largest scores of each row, ties to smaller ids; ids ascend."""
    if scores.shape[1] > top:
        least = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        out = []
        for row, limit in zip(scores, least, strict=True):
            at = np.flatnonzero(row >= limit)
            out.append(at[np.argsort(-row[at], kind="stable")][:top])
        return np.array(out)
    return np.argsort(-scores, axis=1, kind="stable")


def _merge(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of a list, an id once at its best score, ties to smaller ids."""
    order = np.lexsort((-scores, ids))
    ids, scores = ids[order], scores[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))[: len(ids)]
    ids, scores = ids[first], scores[first]
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def choose_reach(curves: Curves, ids: np.ndarray, vectors: np.ndarray, windows: int, top: int, target: float) -> int:
    """The fewest neighbouring windows on each side by which the sample's queries find `target` of their true neighbours."""
    if len(ids) < 2:
        return windows
    at = np.arange(min(len(ids), SAMPLE_QUERIES))
    scores = vectors[at] @ vectors.T
    scores[at, at] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, : min(top, len(ids) - 1)]
    rows, asked = curves.keys(vectors, ids), curves.keys(vectors[at], ids[at], True)
    gap = np.full(true.shape, windows)
    for o in range(rows.shape[1]):
        cuts = np.quantile(rows[:, o], np.arange(1, windows) / windows)
        near = np.abs(np.searchsorted(cuts, rows[:, o])[true] - np.searchsorted(cuts, asked[:, o])[:, None])
        gap = np.minimum(gap, near)
    for reach in range(windows):
        if (gap <= reach).mean() >= target:
            return reach
    return windows


def nearest(embeddings: DataFrame, queries: DataFrame, top: int = TOP, target: float = TARGET, orderings: int = ORDERINGS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (vec_id, embedding) the nearest rows of `embeddings` but itself."""
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = rows.select("vec_id", F.size("embedding").alias("width"), squares.alias("squares")).filter("squares > 0 and squares < double('Infinity') and not isnan(squares)")
    about = fine.agg(F.min_by("width", "vec_id").alias("width"), F.max("squares").alias("squares"), F.count(F.lit(1)).alias("n")).first()
    if not about["n"]:
        return spark.createDataFrame([], out)
    width, count = about["width"], about["n"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    ids, vectors = _usable(sample, width)
    curves = Curves(width, float(np.sqrt(about["squares"])), vectors, orderings)
    windows = max(MIN_WINDOWS, -(-count // WINDOW_ROWS))
    reach = choose_reach(curves, ids, vectors, windows, top, target)

    def to_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            i, v = _usable(pdf, width)
            keys = curves.keys(v, i)
            yield pd.DataFrame({"ordering": np.tile(np.arange(orderings), len(i)), "key": keys.ravel()})

    shares = F.array(*[F.lit(k / windows) for k in range(1, windows)])
    found = rows.mapInPandas(to_keys, "ordering int, key long").groupBy("ordering").agg(F.percentile_approx("key", shares, F.lit(20 * windows)).alias("cuts")).collect()
    cuts = [np.zeros(0, np.int64)] * orderings
    for r in found:
        cuts[r["ordering"]] = np.array(r["cuts"], np.int64)

    def placed(batches: Iterator[pd.DataFrame], as_query: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            i, v = _usable(pdf, width)
            keys = curves.keys(v, i, as_query)
            raw = [x.tobytes() for x in v]
            for o in range(orderings):
                at = np.searchsorted(cuts[o], keys[:, o])
                for step in range(-reach, reach + 1) if as_query else (0,):
                    to = at + step
                    inside = np.flatnonzero((to >= 0) & (to < windows))
                    yield pd.DataFrame({"ordering": o, "window": to[inside], "kind": int(as_query), "vec_id": i[inside], "vector": [raw[k] for k in inside]})

    def load(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = table.select(["vec_id", "vector"]).to_pandas().drop_duplicates().sort_values("vec_id", kind="stable")
        return own["vec_id"].to_numpy(), np.frombuffer(b"".join(own["vector"]), np.float64).reshape(len(own), width)

    def rank(held: tuple[np.ndarray, np.ndarray], few: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, block = held
        who = few.column("vec_id").to_numpy()
        scores = np.frombuffer(b"".join(few.column("vector").to_pylist()), np.float64).reshape(len(who), width) @ block.T
        scores[who[:, None] == ids[None, :]] = -np.inf
        best = _best(scores, ids, top)
        values = np.take_along_axis(scores, best, axis=1)
        fine = np.isfinite(values)
        part = few.column("window").to_numpy() // MERGED
        lists = [[ids[b[f]] for b, f in zip(best, fine, strict=True)], [v[f] for v, f in zip(values, fine, strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(part, pa.int32()), pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.float64()))], names=["query_id", "part", "ids", "scores"])

    schema = "ordering int, window int, kind int, vec_id long, vector binary"
    where = ("ordering", "window")
    both = rows.mapInPandas(lambda b: placed(b, False), schema).unionByName(asked.mapInPandas(lambda b: placed(b, True), schema))
    sorted_rows = both.repartition(*where).sortWithinPartitions(*where, "kind")
    met = sorted_rows.mapInArrow(lambda b: block_visits(b, where, load, rank, QUERIES_AT_ONCE), "query_id long, part int, ids array<long>, scores array<double>")

    def merged(lists: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """The best of all lists of a query (and part), as rows query_id, part, ids, scores."""
        joined = lists.groupBy(*by).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                kept = [_merge(np.asarray(i, np.int64), np.asarray(s, float), top) for i, s in zip(pdf["ids"], pdf["scores"], strict=True)]
                yield pd.DataFrame({**{c: pdf[c] for c in by}, "ids": [k[0] for k in kept], "scores": [k[1] for k in kept]})

        return joined.mapInPandas(best, ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in by) + ", ids array<long>, scores array<double>")

    lists = merged(merged(met, ("query_id", "part")), ("query_id",))
    ranked = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))

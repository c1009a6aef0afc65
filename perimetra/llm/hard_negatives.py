"""Hard negatives by a pivot table.

Components become integers, y = floor(256 c). With M the largest length, a row y is lifted to (y, sqrt(M^2 - |y|^2)) and an
anchor q to (q, 0): their squared distance is |q|^2 + M^2 - 2 <q, y>, so a score is a distance. The pivot table stores
each lifted row with its distances to the pivots, and its cell, the nearest pivot. By the triangle inequality the
distances of an anchor and of a row to a pivot bracket the distance between the two, and so the score; the smallest and
largest distances of a cell to each pivot (pivots x pivots numbers) bracket all its rows at once. What the brackets
leave is checked by exact integer inner products.

Three rounds: anchors meet their most promising cell for positives; then every cell that may still hold a better one; then,
for negatives, every cell that may hold a score in the window of some positive. A cell is dealt by hash into blocks of
about BLOCK_NUMBERS components. A round moves each row once: its block is held by a task while the anchors that visit it
stream past in batches, however many they are. Each round keeps the best few of each anchor in Spark, by rank.

Edge cases: rows whose vec_id, label or vector is null, whose vector has another length than the first usable one by
vec_id, holds null or non-finite components, or has a squared length of 2**62 or more after scaling, take no part; zero
vectors do. Of wholly equal rows one takes part; rows that repeat a vec_id with another vector or label are rows of their
own, but never partners of an anchor of that id. Ties go to the smaller vec_id. A negative positive_score has an empty
window. An empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.llm.common import block_visits, bounded_batches, common_width, full_vectors, materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least 80 hundredths of the positive, and at most as much.
SHARE = (80, 100)
PIVOTS = 16
#: Rows that pivots are chosen from.
SAMPLE_ROWS = 4096
#: A block holds about so many components.
BLOCK_NUMBERS = 1 << 19
#: Anchors that a task compares with its block at once.
STEP = 128
LARGEST = 2.0**62
_ROW = "cell int, block int, kind int, vec_id long, label long, anchor long, vector binary, distances binary, least array<long>, most array<long>"


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE)


def _squares(vectors: np.ndarray) -> np.ndarray:
    y = _integers(vectors)
    return np.einsum("ij,ij->i", y, y)


def prepared(rows: DataFrame, width: int) -> DataFrame:
    """vec_id, label, vector (integers of 4 bytes) of the rows that take part."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = full_vectors(batch.column("embedding"), width)
            fine = _squares(vectors) < LARGEST
            at, y = at[fine], _integers(vectors[fine]).astype(np.int32)
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(where), batch.column("label").take(where), pa.array([r.tobytes() for r in y], pa.binary())], names=["vec_id", "label", "vector"])

    return rows.mapInArrow(scale, "vec_id long, label long, vector binary")


def _stacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it; fewer if the sample has fewer different rows."""
    chosen = [0] if len(sample) else []
    far = np.full(len(sample), np.inf)
    while chosen and len(chosen) < count:
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


class Pivots:
    """Lifted pivots; distances of rows and of anchors to them."""

    def __init__(self, sample: np.ndarray, longest: float, count: int = PIVOTS) -> None:
        self.longest = longest  # squared
        self.points = spread_pivots(self.lifted(sample), count)

    def lifted(self, y: np.ndarray, anchors: bool = False) -> np.ndarray:
        y = y.astype(np.float64)
        rest = np.zeros(len(y)) if anchors else np.sqrt(np.maximum(0, self.longest - np.einsum("ij,ij->i", y, y)))
        return np.column_stack((y, rest))

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        return np.column_stack([np.sqrt(((lifted - p) ** 2).sum(axis=1)) for p in self.points]) if len(self.points) else np.zeros((len(lifted), 0))

    def radius(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which an anchor of this squared length has this score (infinite for a score of minus infinity)."""
        return np.sqrt(np.maximum(0, squares + self.longest - 2.0 * scores))

    def slack(self) -> float:
        """More than rounding can move any distance by."""
        return 1e-6 * (1.0 + np.sqrt(self.longest))


def pivot_table(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """cell, vec_id, label, vector, distances (doubles)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.distances(pivots.lifted(_stacked(batch.column("vector"), np.int32, width)))
            cell = far.argmin(axis=1) if len(far) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(c) for c in ("vec_id", "label", "vector")), pa.array([r.tobytes() for r in far], pa.binary())], names=["cell", "vec_id", "label", "vector", "distances"])

    return rows.mapInArrow(place, "cell int, vec_id long, label long, vector binary, distances binary")


class Cells:
    """Rows of each cell, and its smallest and largest distance to each pivot."""

    def __init__(self, table: DataFrame, count: int) -> None:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = np.zeros(count, np.int64), np.full((count, count), np.inf), np.full((count, count), -np.inf)
            for batch in batches:
                cell, far = batch.column("cell").to_numpy(), _stacked(batch.column("distances"), np.float64, count)
                np.add.at(n, cell, 1)
                np.minimum.at(low, cell, far)
                np.maximum.at(high, cell, far)
            c, p = np.divmod(np.arange(count * count), count)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(n[c]), pa.array(low.ravel()), pa.array(high.ravel())], names=["cell", "pivot", "n", "low", "high"])

        found = table.select("cell", "distances").mapInArrow(look, "cell int, pivot int, n long, low double, high double")
        self.n, self.low, self.high = np.zeros(count, np.int64), np.full((count, count), np.inf), np.full((count, count), -np.inf)
        for r in found.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            self.n[r["cell"]], self.low[r["cell"], r["pivot"]], self.high[r["cell"], r["pivot"]] = r["n"], r["low"], r["high"]

    def nearest(self, own: np.ndarray) -> np.ndarray:
        """Anchors x cells: no row of the cell is nearer to the anchor than this (infinite for an empty cell)."""
        gap = np.maximum(own[:, None, :] - self.high[None], self.low[None] - own[:, None, :])
        return np.where(self.n > 0, np.maximum(gap.max(axis=2), 0), np.inf)

    def farthest(self, own: np.ndarray) -> np.ndarray:
        """Anchors x cells: no row of the cell is farther from the anchor than this."""
        return (own[:, None, :] + self.high[None]).min(axis=2)


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _exact(anchors: np.ndarray, rows: np.ndarray, longest: float) -> np.ndarray:
    """Inner products as longs. Below 2**53 doubles hold every partial sum exactly; up to 2**62 longs do."""
    if longest < 2.0**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _visits(table: DataFrame, asks: DataFrame, work: Callable[..., Iterator[dict[str, np.ndarray]]], blocks: np.ndarray, width: int, schema: str) -> DataFrame:
    """work(block, anchors) for each block of the table and, batch by batch, the anchors that visit it.

    asks: cell, and the columns of an anchor. A block's rows come first; then its anchors stream past.
    """
    many = F.array(*[F.lit(int(b)) for b in blocks])
    block = F.pmod(F.xxhash64("vec_id", "vector"), many[F.col("cell")]).cast("int")
    none = F.lit(None)
    rows = table.select("cell", block.alias("block"), F.lit(0).alias("kind"), "vec_id", "label", none.cast("long").alias("anchor"), "vector", "distances", none.cast("array<long>").alias("least"), none.cast("array<long>").alias("most"))
    asking = asks.select("cell", F.explode(F.sequence(F.lit(0), many[F.col("cell")] - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "anchor", "vector", "distances", "least", "most")
    both = rows.unionByName(asking).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")

    def meet(held: dict, few: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for made in work(held, _anchors(few, width)):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))

    return both.mapInArrow(lambda batches: block_visits(batches, ("cell", "block"), lambda t: _block(t, width), meet, STEP), schema)


def _block(table: pa.Table, width: int) -> dict[str, np.ndarray]:
    """A block's rows by vec_id, equal ones once."""
    ids, label, vectors = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), table.column("vector").to_pylist()
    distances = table.column("distances").to_pylist()
    once = sorted({(i, la, v): k for k, (i, la, v) in enumerate(zip(ids.tolist(), label.tolist(), vectors, strict=True))}.values(), key=lambda k: ids[k])
    return {"vec_id": ids[once], "label": label[once], "vector": np.frombuffer(b"".join(vectors[k] for k in once), np.int32).reshape(-1, width), "distances": np.frombuffer(b"".join(distances[k] for k in once), np.float64).reshape(len(once), -1)}


def _anchors(batch: pa.RecordBatch, width: int) -> dict[str, object]:
    vectors = _stacked(batch.column("vector"), np.int32, width)
    out = {c: batch.column(c).to_numpy() for c in ("vec_id", "label", "anchor")}
    return out | {"vector": vectors, "distances": np.frombuffer(b"".join(batch.column("distances").to_pylist()), np.float64).reshape(len(vectors), -1), "squares": (vectors.astype(np.float64) ** 2).sum(axis=1), "least": batch.column("least").to_pylist(), "most": batch.column("most").to_pylist()}


def _survivors(own: np.ndarray, rows: np.ndarray, outer: np.ndarray, inner: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Anchors x rows: pairs of `fine` whose bracket of distances meets [inner, outer] by every pivot."""
    for p in range(own.shape[1]):
        if not fine.any():
            break
        fine &= np.abs(own[:, p, None] - rows[None, :, p]) <= outer[:, None]
        fine &= own[:, p, None] + rows[None, :, p] >= inner[:, None]
    return fine


def _scored(block: dict, anchors: dict, fine: np.ndarray, longest: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Anchor, places of its survivors in the block, and their exact scores."""
    who, what = np.flatnonzero(fine.any(axis=1)), np.flatnonzero(fine.any(axis=0))
    if len(who):
        scores = _exact(anchors["vector"][who], block["vector"][what], longest)
        for k, a in enumerate(who.tolist()):
            alive = fine[a, what]
            yield a, what[alive], scores[k, alive]


_FOUND = "anchor long, slot int, vec_id long, score long"


def _columns(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    if parts:
        size = [len(p[2]) for p in parts]
        yield {"anchor": np.repeat(np.array([p[0] for p in parts], np.int64), size), "slot": np.repeat(np.array([p[1] for p in parts], np.int32), size), "vec_id": np.concatenate([p[2] for p in parts]), "score": np.concatenate([p[3] for p in parts])}


def mine(embeddings: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, label, embedding; anchors: which of its rows (by vec_id) are anchors. An anchor's positives are the
    best-scoring `positives` other rows of its label; each gets the `negatives` best rows of other labels that score between
    share[0]/share[1] of the positive and as much as it.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    part, whole = share
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null")
    width, count, longest = common_width(rows, _squares, LARGEST)
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ready = prepared(rows, width)
    sample = ready.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE_ROWS).toArrow()
    near = Pivots(_stacked(sample.column("vector"), np.int32, width), longest, pivots)
    size, slack = len(near.points), near.slack()
    table = materialize(pivot_table(ready, near, width), "pivot-table")
    cells = Cells(table, size)
    blocks = np.maximum(1, -(-cells.n * width // BLOCK_NUMBERS))

    def as_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = near.distances(near.lifted(_stacked(batch.column("vector"), np.int32, width), True))
            home = cells.nearest(own).argmin(axis=1) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vector")), pa.array([r.tobytes() for r in own], pa.binary()), pa.array(home.astype(np.int32))], names=["vec_id", "label", "vector", "distances", "home"])

    chosen = table.filter(anchors).select("vec_id", "label", "vector").distinct()
    chosen = chosen.mapInArrow(as_anchor, "vec_id long, label long, vector binary, distances binary, home int").withColumn("anchor", F.monotonically_increasing_id())
    asking = materialize(chosen, "anchors")
    own = asking.select("anchor", "vec_id", "label", "vector", "distances", "home")
    limits = "cell int, vec_id long, label long, anchor long, vector binary, distances binary, least array<long>, most array<long>"

    def to_cells(asks: DataFrame, wanted: Callable[[dict], np.ndarray]) -> DataFrame:
        """A row for each anchor and cell that `wanted` (anchors x cells) marks."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, cell = np.nonzero(wanted(_anchors(batch, width) | {"home": batch.column("home").to_numpy()}))
                taken = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(taken.column(c) for c in ("vec_id", "label", "anchor", "vector", "distances", "least", "most"))], names=["cell", "vec_id", "label", "anchor", "vector", "distances", "least", "most"])

        return asks.mapInArrow(go, limits)

    def least_of(asked: dict) -> np.ndarray:
        """Smallest score of interest to each anchor; minus infinity if all are."""
        return np.array([min(v) if v else -np.inf for v in asked["least"]], np.float64)

    def alike(block: dict, asked: dict) -> Iterator[dict[str, np.ndarray]]:
        outer = near.radius(asked["squares"], least_of(asked)) + slack
        fine = (asked["label"][:, None] == block["label"][None]) & (asked["vec_id"][:, None] != block["vec_id"][None])
        parts = []
        for a, at, scores in _scored(block, asked, _survivors(asked["distances"], block["distances"], outer, np.zeros(len(outer)), fine), longest):
            best = np.argsort(-scores, kind="stable")[:positives]
            parts.append((asked["anchor"][a], 0, block["vec_id"][at[best]], scores[best]))
        yield from _columns(parts)

    nothing = F.lit(None).cast("array<long>")
    home = to_cells(own.withColumn("least", nothing).withColumn("most", nothing), lambda asked: np.arange(size)[None] == asked["home"][:, None])
    first = materialize(_best(_visits(table, home, alike, blocks, width, _FOUND), ["anchor"], positives), "home-positives")
    known = first.groupBy("anchor").agg(F.when(F.count(F.lit(1)) == positives, F.array(F.min("score"))).alias("least"))
    second = own.join(known, "anchor", "left").withColumn("most", nothing)

    def others(asked: dict) -> np.ndarray:
        reach = near.radius(asked["squares"], least_of(asked)) + slack
        return (cells.nearest(asked["distances"]) <= reach[:, None]) & (cells.n > 0) & (np.arange(size)[None] != asked["home"][:, None])

    further = _visits(table, to_cells(second, others), alike, blocks, width, _FOUND)
    found = materialize(_best(first.select("anchor", "slot", "vec_id", "score").unionByName(further), ["anchor"], positives), "positives")

    # The least score not below part / whole of the positive's, without a product that could overflow.
    lowest = F.expr(f"score div {whole} * {part} + (score % {whole} * {part} + {whole - 1}) div {whole}")
    windows = found.filter("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", lowest.alias("low"), "score"))).alias("w"))
    third = own.join(windows, "anchor").select(*own.columns, F.col("w.low").alias("least"), F.col("w.score").alias("most"))

    def reach_of(asked: dict) -> tuple[np.ndarray, np.ndarray]:
        highest = np.array([max(v) if v else -np.inf for v in asked["most"]], np.float64)
        return near.radius(asked["squares"], least_of(asked)) + slack, near.radius(asked["squares"], highest) - slack

    def in_window(asked: dict) -> np.ndarray:
        outer, inner = reach_of(asked)
        return (cells.nearest(asked["distances"]) <= outer[:, None]) & (cells.farthest(asked["distances"]) >= inner[:, None]) & (cells.n > 0)

    def unlike(block: dict, asked: dict) -> Iterator[dict[str, np.ndarray]]:
        outer, inner = reach_of(asked)
        fine = (asked["label"][:, None] != block["label"][None]) & (asked["vec_id"][:, None] != block["vec_id"][None])
        parts = []
        for a, at, scores in _scored(block, asked, _survivors(asked["distances"], block["distances"], outer, inner, fine), longest):
            order = np.argsort(-scores, kind="stable")
            falling = -scores[order]
            for slot, (low, high) in enumerate(zip(asked["least"][a], asked["most"][a], strict=True)):
                begin = np.searchsorted(falling, -high)
                end = min(np.searchsorted(falling, -low, "right"), begin + negatives)
                if begin < end:
                    parts.append((asked["anchor"][a], slot + 1, block["vec_id"][at[order[begin:end]]], scores[order[begin:end]]))
        yield from _columns(parts)

    partners = _best(_visits(table, to_cells(third, in_window), unlike, blocks, width, _FOUND), ["anchor", "slot"], negatives)
    named = found.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    mined = partners.select("anchor", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(named, ["anchor", "slot"])
    return mined.join(asking.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

"""Shared helpers: the cluster's shared folder, bounded text chunks, and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step handles; a longer document is a step of its own, worked on block by block.
CHUNK_BYTES = 512_000
#: Bytes of the Arrow batches that go to Python workers, at most (but a longer row is one batch).
BATCH_BYTES = 4_000_000
#: Bytes (or words) of one block: what a step needs beside its text and its results is bounded by it.
BLOCK = 1 << 17

_MULT = 0x9E3779B97F4A7C15
_POLY = np.uint64(0xD6E8FEB86659FD93)
_POLY_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_WORD_COEF = np.array([(_MULT * (2 * i + 1) | 1) & (2**64 - 1) for i in range(64)], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share. Where it is unset, one of our own if all run on
    this machine, as in tests; an error on a cluster, whose hosts would each write to a folder of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="perimetra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/perimetra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
            path = hadoop.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges, in order, that hold at most about `limit` each."""
    if len(sizes):
        part = np.cumsum(sizes + 1) // limit
        cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(sizes)], strict=True)


def bounded_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches at BATCH_BYTES, unless it cuts them shorter; rows of whole texts are too large for a bound by number alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(key, None) or "").lower())
    if not held or int(held[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[held[2]] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_texts(df: DataFrame, work: Callable[[list[str | None]], dict[str, object]], added: str, keep: Sequence[str] = ("doc_id",), text: str = "text", drop_text: bool = True, limit: int = CHUNK_BYTES) -> DataFrame:
    """`keep` columns unchanged and the columns `added` (DDL) that `work` makes of bounded slices of the text column.

    Arrow batches go through without conversion, so nulls and types of kept columns stay as they are. With `drop_text`
    False the text stays too, unless `added` replaces it.
    """
    bounded_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    kept = [c for c in keep if c not in new.names] + ([text] if not drop_text and text not in new.names and text not in keep else [])
    schema = StructType([df.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            column = batch.column(text)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(sizes, limit):
                made = work(column.slice(a, b - a).to_pylist())
                arrays = [batch.column(c).slice(a, b - a) for c in kept]
                for field, kind in zip(new.fields, types, strict=True):
                    values = made[field.name]
                    arrays.append(values if isinstance(values, pa.Array) else pa.array(values, type=kind))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def list_array(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values, cut at the offsets `first`, as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(first, np.int32)), pa.array(values))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that equal steps in x give unrelated values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64) -> np.ndarray:
    steps = np.full(BLOCK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


#: Powers of the hash base and of its inverse, modulo 2**64, for places within one block.
_UP, _DOWN = _powers(_POLY), _powers(_POLY_INV)


def joined(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by a line feed, and the offset at which each begins (one more at the end)."""
    raw = [(t or "").encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    raw.append(b"")
    return np.frombuffer(b"\n".join(raw), np.uint8), offsets


def spans(buffer: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of bytes that `inside` (256 flags) holds."""
    edges, before = [], 0
    for low in range(0, len(buffer), BLOCK):
        flag = inside[buffer[low : low + BLOCK]].view(np.int8)
        edges.append(np.flatnonzero(np.diff(flag, prepend=np.int8(before))) + low)
        before = flag[-1]
    if before:
        edges.append(np.array([len(buffer)]))
    edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    return edge[0::2], edge[1::2]


def _blocks_of(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Block by block: where it begins, the first span it meets and the one after the last, and the cuts that `np.add.reduceat` wants."""
    for low in range(0, len(buffer), BLOCK):
        high = min(low + BLOCK, len(buffer))
        i, j = int(np.searchsorted(end, low, "right")), int(np.searchsorted(start, high, "left"))
        if i < j:
            cuts = np.empty(2 * (j - i), np.int64)
            np.maximum(start[i:j] - low, 0, out=cuts[0::2])
            np.minimum(end[i:j] - low, high - low, out=cuts[1::2])
            yield low, i, j, cuts


def span_counts(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, kinds: Sequence[int]) -> dict[int, np.ndarray]:
    """Bytes of each of `kinds` (by the 256-entry table `kind`) in each span. Spans are not empty, in order, and do not touch.

    Three kinds are counted at once, in 20 bits each, block by block, so that memory beyond the result is a block's.
    """
    out = {k: np.zeros(len(start), np.int32) for k in kinds}
    for few in (kinds[i : i + 3] for i in range(0, len(kinds), 3)):
        packed = np.zeros(256, np.int64)
        for at, k in enumerate(few):
            packed[kind == k] = 1 << (20 * at)
        for low, i, j, cuts in _blocks_of(buffer, start, end):
            sums = np.add.reduceat(np.append(packed[buffer[low : low + BLOCK]], 0), cuts)[0::2]
            for at, k in enumerate(few):
                out[k][i:j] += ((sums >> (20 * at)) & 0xFFFFF).astype(np.int32)
    return out


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, modulo 2**64; equal bytes give equal hashes wherever they stand. Memory beyond the result is a block's."""
    total = np.zeros(len(start), np.uint64)
    for low, i, j, cuts in _blocks_of(buffer, start, end):
        few = buffer[low : low + BLOCK]
        sums = np.add.reduceat(np.append(few * _UP[: len(few)], np.uint64(0)), cuts)[0::2]
        sums *= _DOWN[np.maximum(start[i:j] - low, 0)]
        if start[i] < low:  # the span began in an earlier block
            sums[:1] *= np.uint64(pow(int(_POLY), low - int(start[i]), 1 << 64))
        total[i:j] += sums
    return mix(total + (end - start).astype(np.uint64))


_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the first word of each text (one more at the end).

    Words are runs of ASCII letters, digits and underscores or of any characters beyond ASCII, in lower case.
    """
    buffer, offsets = joined([(t or "").lower() for t in texts])
    start, end = spans(buffer, _WORD)
    return span_hashes(buffer, start, end), np.searchsorted(start, offsets)


def shingles(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and the first shingle of each text (one more at the end).

    A text of fewer words than `size`, but one at least, is one shingle; a text without words has none.
    """
    hashes, first = words(texts)
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(made, out=out_first[1:])
    total = int(out_first[-1])
    combined = np.zeros(total, np.uint64)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    owners = np.flatnonzero(made)
    for low in range(0, total, BLOCK):
        here = np.arange(low, min(low + BLOCK, total))
        doc = owners[np.searchsorted(out_first[owners], here, "right") - 1]
        at = first[doc] + (here - out_first[doc])
        short = count[doc] < size
        for j in range(size):
            piece = padded[at + j] * _WORD_COEF[j]
            combined[low : low + BLOCK] += np.where(short & (j >= count[doc]), np.uint64(j + 1), piece) if short.any() else piece
        combined[low : low + BLOCK] = mix(combined[low : low + BLOCK])
    return combined, out_first


def block_visits(batches: Iterator[pa.RecordBatch], by: Sequence[str], load: Callable[[pa.Table], object], work: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], step: int) -> Iterator[pa.RecordBatch]:
    """Meets each block of rows with its visitors, of sorted batches with the columns `by` and kind (0: a row, 1: a visitor).

    A block's rows come first and are held, as `load` makes them; then its visitors stream past, `step` at a time, however
    many they are. Blocks without rows or without visitors give nothing.
    """
    where: list[int] | None = None
    parts: list[pa.RecordBatch] = []
    held = None
    for batch in batches:
        key = np.column_stack([batch.column(c).to_numpy() for c in (*by, "kind")])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            *block, kind = key[low].tolist()
            if block != where:
                where, parts, held = block, [], None
            if kind == 0:
                parts.append(batch.slice(low, high - low))
                continue
            if held is None and parts:
                held, parts = load(pa.Table.from_batches(parts)), []
            if held is not None:
                for first in range(low, high, step):
                    yield from work(held, batch.slice(first, min(step, high - first)))


def full_vectors(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (doubles) of the lists of `width` entries, none of them null, infinite or not a number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width)
    if not len(at) or not width:
        return np.zeros(0, np.int64), np.zeros((0, width))
    values = column.take(pa.array(at)).flatten()
    vectors = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
    fine = np.isfinite(vectors).all(axis=1)
    return at[fine], vectors[fine]


def common_width(rows: DataFrame, measure: Callable[[np.ndarray], np.ndarray], limit: float) -> tuple[int, int, float]:
    """Length of the usable vectors, how many have it, and the largest measure among them; (0, 0, 0.0) where there are none.

    rows: vec_id, embedding. Usable are vectors without nulls and non-finite entries whose measure is below `limit`. The
    length is that of the usable row with the smallest vec_id (rows without one come last, then the shorter).
    """
    last = np.iinfo(np.int64).max

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("embedding"), pc.fill_null(batch.column("vec_id"), last).to_numpy(zero_copy_only=False)
            out = []
            for width in pc.unique(pc.list_value_length(column)).drop_null().to_pylist():
                at, vectors = full_vectors(column, width)
                size = measure(vectors) if len(at) else np.zeros(0)
                fine = size < limit
                if fine.any():
                    out.append((width, int(ids[at[fine]].min()), int(fine.sum()), float(size[fine].max())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["width", "first", "n", "most"])

    seen = rows.mapInArrow(look, "width int, first long, n long, most double").groupBy("width").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("most").alias("most"))
    found = seen.orderBy("first", "width").first()
    return (found["width"], found["n"], found["most"]) if found else (0, 0, 0.0)

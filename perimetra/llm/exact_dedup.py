"""Exact duplicates against a stored history, by minimal perfect hashes.

The distinct digests of earlier deliveries are dealt by hash into buckets of about BUCKET_KEYS. Each bucket has a minimal
perfect hash: levels of bits, in which a digest takes the first level where no other digest of the bucket falls on its
bit; the number of set bits before it is its slot. A slot holds the whole digest and the locator of the row that stays. A
new delivery is first grouped by digest, so that a hot text is one row; its digests then visit their bucket, and a digest
is a repeat only if all bytes in its slot are its own. Repeats join the stored group; the others are groups of their own.
A bucket's hash and slots (some 500 kB) are what a task holds, together with at most BLOCK_KEYS new digests.

Texts are equal when they are identical without the characters space and U+0009 to U+000D. Of equal texts the row with the
most code points in the original text stays, then the smallest doc_id.

Edge cases: a null text is the empty one and equal to texts of such characters alone; rows without a doc_id come after
those with one, and keep_id is null if no row of a group has one; of repeated rows exactly one can stay; ties are broken
by delivery and place, which no column shows; an empty table or an empty history gives no rows or no repeats; extra
columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import materialize, mix

BUCKET_KEYS = 8192
BLOCK_KEYS = 65_536
BLANK = " \t\n\x0b\x0c\r"
#: Join hint for tables that grow with the data: they are not broadcast, even where they are still small enough.
GROWN = "merge"
_ENTRY = "digest binary, n_rows long, points long, doc_id long, delivery int, place long"
_NAMES = ["digest", "n_rows", "points", "doc_id", "delivery", "place"]
_INDEX = "bucket int, buckets int, levels array<binary>, digests binary, n_rows array<long>, points array<long>, doc_id array<long>, delivery array<int>, place array<long>"


def records(docs: DataFrame, delivery: Column) -> DataFrame:
    """delivery, place, doc_id, points (code points of the original text), digest (32 bytes, of the normalised text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        delivery.cast("int").alias("delivery"),
        F.monotonically_increasing_id().alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("points"),
        F.unhex(F.sha2(F.translate(text, BLANK, ""), 256)).alias("digest"),
    )


def _rank() -> Column:
    """Smaller is better; what it ends with is the locator."""
    return F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("without"), "doc_id", "delivery", "place")


def _entries(best: DataFrame) -> DataFrame:
    return best.select("digest", "n_rows", (-F.col("best.minus")).alias("points"), "best.doc_id", "best.delivery", "best.place")


def groups(rows: DataFrame) -> DataFrame:
    """One entry for each digest: digest, n_rows, and points, doc_id, delivery, place of the row that stays."""
    return _entries(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min(_rank()).alias("best")))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _level_places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key (four 64-bit numbers, all of which count) on a level of `size` bits."""
    odd = mix(np.arange(4 * level + 1, 4 * level + 5, dtype=np.uint64)) | np.uint64(1)
    return (mix((keys * odd).sum(axis=1, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits (packed) that give each of the distinct keys a slot of its own below their number."""
    levels: list[np.ndarray] = []
    left = keys
    while len(left):
        size = -(-len(left) // 8) * 8
        at = _level_places(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone))
        left = left[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, or -1. A key that the hash was not made for may get any slot: compare what the slot holds."""
    out = np.full(len(keys), -1, np.int64)
    left, before = np.arange(len(keys)), 0
    for level, packed in enumerate(levels):
        bits = np.unpackbits(packed)
        rank = before + np.cumsum(bits, dtype=np.int64) - 1
        at = _level_places(keys[left], level, len(bits))
        hit = bits[at] == 1
        out[left[hit]] = rank[at[hit]]
        left, before = left[~hit], before + int(bits.sum())
    return out


def _keys(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def build_index(entries: DataFrame) -> DataFrame:
    """The entries (see `groups`, one for each digest) as a stored index, one row for each bucket."""
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def build(table: pa.Table) -> pa.Table:
        keys = _keys(table.column("digest"))
        levels = perfect_hash(keys)
        table = table.take(pa.array(np.argsort(slots(levels, keys))))
        one = {"bucket": table.column("bucket")[:1], "buckets": pa.array([buckets], pa.int32()), "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())), "digests": pa.array([b"".join(table.column("digest").to_pylist())], pa.binary())}
        for name in _NAMES[1:]:
            values = table.column(name).combine_chunks()
            one[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(one)

    return materialize(entries.select(_bucket(buckets).alias("bucket"), *_NAMES).groupBy("bucket").applyInArrow(build, _INDEX), "digest-index")


def stored_entries(index: DataFrame) -> DataFrame:
    """The entries of an index, slot by slot."""
    slot = F.explode(F.sequence(F.lit(0), F.size("place") - 1)).alias("slot")
    whole = index.filter(F.size("place") > 0).select("digests", *_NAMES[1:], slot)
    return whole.select(F.substring("digests", F.col("slot") * 32 + 1, F.lit(32)).alias("digest"), *[F.col(c)[F.col("slot")].alias(c) for c in _NAMES[1:]])


def lookup(entries: DataFrame, index: DataFrame) -> DataFrame:
    """The entries, each with slot: where the index has its digest, byte for byte, or null."""
    about = index.agg(F.max("buckets").alias("buckets")).first()
    buckets = about["buckets"] or 1
    blocks = max(1, -(-entries.count() // (buckets * BLOCK_KEYS)))
    block = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(blocks)).cast("int")
    asking = entries.select(_bucket(buckets).alias("bucket"), block.alias("block"), *_NAMES)
    asked = index.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "levels", "digests")

    def probe(new: pa.Table, old: pa.Table) -> pa.Table:
        keys = _keys(new.column("digest"))
        at = np.full(len(keys), -1, np.int64)
        if len(keys) and old.num_rows:
            held = np.frombuffer(old.column("digests")[0].as_py(), np.uint64).reshape(-1, 4)
            at = slots([np.frombuffer(x, np.uint8) for x in old.column("levels")[0].as_py()], keys)
            at[at >= 0] = np.where((held[at[at >= 0]] == keys[at >= 0]).all(axis=1), at[at >= 0], -1)
        return new.select(_NAMES).append_column("slot", pa.array(at, mask=at < 0))

    return asking.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInArrow(probe, f"{_ENTRY}, slot long")


def settled(new: DataFrame, index: DataFrame) -> DataFrame:
    """The entries of the index and of a new delivery together, one for each digest: repeats, found by lookup, join the
    stored entry; nonmembers are entries of their own. This is what the next index is built from."""
    found = materialize(lookup(new, index), "looked-up")
    repeats = found.filter("slot is not null").select("digest", F.col("n_rows").alias("more"), _rank().alias("rival"))
    stored = stored_entries(index).select("digest", "n_rows", _rank().alias("best")).join(repeats.hint(GROWN), "digest", "left")
    joined = stored.select("digest", (F.col("n_rows") + F.coalesce("more", F.lit(0))).alias("n_rows"), F.least("best", F.coalesce("rival", "best")).alias("best"))
    return _entries(joined).unionByName(found.filter("slot is null").drop("slot"))


def exact_dedup(docs: DataFrame, earlier: Column) -> DataFrame:
    """One row per document: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    earlier: which rows came with the first delivery. Their digests make the index that the second delivery is held
    against; the results are those of both together.
    """
    rows = materialize(records(docs, F.when(earlier, 0).otherwise(1)), "dedup-records")
    index = build_index(groups(rows.filter("delivery = 0")))
    whole = settled(groups(rows.filter("delivery = 1")), index)
    # Written out, the join's two sides are plain shuffles, and Spark can split the partition of a hot digest.
    whole = materialize(whole.select("digest", F.col("n_rows").alias("group_size"), F.col("doc_id").alias("keep_id"), F.struct("delivery", "place").alias("stays")), "dedup-groups")
    joined = rows.join(whole.hint(GROWN), "digest")
    return joined.select("doc_id", "keep_id", "group_size", (F.struct("delivery", "place") == F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

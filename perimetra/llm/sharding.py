"""Shards by fixed virtual slots, with DataFrame functions only.

Records hash into a fixed number of slots. Bytes are summed per slot, and a versioned slot-to-shard map, largest slot
first onto the lightest shard, deals the slots out. To rebalance or to grow, the map is edited: only slots above a
shard's fair share move, and the result is the next version. The map has as many rows as there are slots, whatever the
data, so it can be broadcast.

Edge cases: a null text counts as empty (16 bytes); empty tables give empty shards; repeated rows and rows without a
doc_id are records of their own (the text's checksum is hashed too, and the place of hot copies, so such rows spread);
ties are broken by slot number; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.llm.common import materialize

SLOTS = 8192
OVERHEAD = 16
#: Records of one doc_id and text that may share a virtual slot.
SPREAD = 1000


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and the record's overhead), text_crc32, vslot (virtual slot).

    A record hashes by its doc_id and text. Where more than SPREAD records have both in common, the place of each, which a
    stored table fixes, is hashed too, so that some SPREAD of them share a slot.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    held = materialize(narrow, "places")
    often = held.groupBy(F.col("doc_id").alias("hot_id"), F.col("text_crc32").alias("hot_crc")).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > SPREAD)
    met = held.join(often, F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("text_crc32") == F.col("hot_crc")), "left")
    salt = F.pmod("place", F.ceil(F.col("copies") / SPREAD))
    hashed = F.when(F.col("copies").isNull(), F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", salt))
    return met.select("doc_id", "size", "text_crc32", F.pmod(hashed, F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """vslot, bytes, rows: sums of each slot that has records."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(free: DataFrame, loads: Column) -> DataFrame:
    """vslot, shard: the slots of `free`, largest first, each onto the shard whose load is least by then."""
    largest_first = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot")))

    def place(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda load, i: F.when(i == shard, load - slot["minus"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["dealt"], F.array(F.struct(slot["vslot"].alias("vslot"), shard.alias("shard")))).alias("dealt"))

    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("dealt"))
    dealt = free.agg(largest_first.alias("slots"), F.max("start").alias("start_loads")).select(
        F.explode(F.aggregate("slots", start, place, lambda state: state["dealt"])).alias("at")
    )
    return dealt.select("at.vslot", "at.shard")


def new_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The first map: version, vslot, shard."""
    free = sizes.withColumn("start", F.lit(0))
    dealt = _deal(free, F.array_repeat(F.lit(0).cast("long"), shards))
    return dealt.select(F.lit(version).alias("version"), "vslot", "shard")


def edited_map(old: DataFrame, sizes: DataFrame, shards: int, version: int) -> DataFrame:
    """The next map for new sizes or another number of shards: slots within their shard's fair share stay, the rest move."""
    known = sizes.join(F.broadcast(old.select("vslot", "shard")), "vslot", "left")
    fair = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / shards
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = known.withColumn("fair", fair).withColumn("filled", filled)
    stays = F.coalesce(F.col("shard") < shards, F.lit(False)) & (F.col("filled") <= F.col("fair"))
    marked = marked.withColumn("stays", stays)
    kept = marked.filter("stays")
    by_shard = kept.groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = by_shard.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("start"))
    free = marked.filter("not stays").select("vslot", "bytes").crossJoin(F.broadcast(loads)).withColumn("start", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("start")[i], F.lit(0).cast("long"))))
    moved = _deal(free, F.col("start_loads"))
    return kept.select("vslot", "shard").unionByName(moved).select(F.lit(version).alias("version"), "vslot", "shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to the table at `path`."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The map of `version`, or the latest."""
    maps = spark.read.schema("vslot int, shard int, version int").parquet(path)
    last = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.filter(F.col("version") == last).select(F.col("version").cast("int").alias("version"), "vslot", "shard")


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record with its shard and its place there: doc_id, size, text_crc32, shard, slot, vslot, version.

    slot counts from 0 without gaps within a shard: the rows of the shard's earlier virtual slots, then the place among
    the virtual slot's own rows.
    """
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = sizes.join(F.broadcast(slot_map), "vslot").select("vslot", "shard", "version", before.alias("start"))
    own = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("own", own)
        .join(F.broadcast(starts), "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own")).alias("slot"), "vslot", "version")
    )


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """The documents placed by `slot_map`, or by a first map of their own."""
    rows = materialize(records(docs, slots), "records")
    sizes = materialize(slot_sizes(rows), "slot-sizes")
    return placed(rows, sizes, materialize(slot_map if slot_map is not None else new_map(sizes, shards), "slot-map"))


def sharded_with_next(docs: DataFrame, maps: str, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """The documents placed by version 1 of a map stored at `maps`, with next_shard: where version 2, edited for one more shard, has them."""
    rows = materialize(records(docs, slots), "records")
    sizes = materialize(slot_sizes(rows), "slot-sizes")
    save_map(new_map(sizes, shards), maps)
    spark = docs.sparkSession
    save_map(edited_map(load_map(spark, maps, 1), sizes, shards + 1, 2), maps)
    following = load_map(spark, maps, 2).select("vslot", F.col("shard").alias("next_shard"))
    return placed(rows, sizes, load_map(spark, maps, 1)).join(F.broadcast(following), "vslot")

"""WARC records and a Merkle fixity audit of replicas.

Records of a WARC file lie at ordered offsets. Each has a leaf hash of its bytes; leaves of ordered offset ranges make
nodes, ranges of ranges make further nodes, and each file has a root. Two replicas are compared from the roots down, and
only branches that differ are opened, until the ranges of leaves that differ are left; their records are then matched.

Edge cases: null urls and pages count as empty; records of one file and offset do not occur, since offsets are sums of
lengths in (record_id, digest) order; repeated rows are records of their own; a file that one replica lacks is a branch
that differs; empty tables give no rows; extra columns are not carried; long pages are hashed whole.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.llm.common import materialize

#: Leaves or nodes below one node, and levels of ranges between leaves and a file's root.
FAN_OUT = 16
LEVELS = 2
#: About so many records make a file.
FILE_RECORDS = 256


def record_bytes(record_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record, headers and body."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "utf-8")


def leaves(pages: DataFrame, files: int) -> DataFrame:
    """file, offset, place (number within the file), length, record_id, digest of the records that pages make."""
    raw = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").alias("record_id"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    rows = rows.withColumn("file", F.pmod(F.coalesce("record_id", F.crc32("digest")), F.lit(files)).cast("int"))
    order = Window.partitionBy("file").orderBy("record_id", "digest")
    return rows.select(
        "file",
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("offset"),
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        "length",
        "record_id",
        "digest",
    )


def tree(leaf: DataFrame) -> DataFrame:
    """file, level, place, hash: level 0 are leaves, LEVELS the highest ranges, LEVELS + 1 the file's root.

    A leaf hashes its offset, length and digest; a node its children's hashes in order.
    """
    level = leaf.select("file", F.lit(0).alias("level"), "place", F.sha2(F.concat_ws(":", F.lit("leaf"), "offset", "length", "digest"), 256).alias("hash"))
    made = level
    for k in range(1, LEVELS + 2):
        above = F.floor(F.col("place") / FAN_OUT) if k <= LEVELS else F.lit(0).cast("long")
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), ",")
        level = level.groupBy("file", above.alias("place")).agg(F.sha2(F.concat(F.lit("node:"), children), 256).alias("hash")).select("file", F.lit(k).alias("level"), "place", "hash")
        made = made.unionByName(level)
    return made


def differing_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """file, place of the leaves below differing branches of two trees; branches that agree are not opened."""
    opened = None
    for k in range(LEVELS + 1, -1, -1):
        a = one.filter(F.col("level") == k).select("file", "place", F.col("hash").alias("a"))
        b = other.filter(F.col("level") == k).select("file", "place", F.col("hash").alias("b"))
        if opened is not None:
            parent = F.floor(F.col("place") / FAN_OUT) if k < LEVELS else F.lit(0).cast("long")
            up = opened.select("file", F.col("place").alias("parent"))
            a = a.withColumn("parent", parent).join(up, ["file", "parent"], "left_semi").drop("parent")
            b = b.withColumn("parent", parent).join(up, ["file", "parent"], "left_semi").drop("parent")
        opened = materialize(a.join(b, ["file", "place"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "place"), f"opened-{k}")
    return opened


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Status of each record of two replicas' leaves: file, record_id, offset, length, digest, status, other_digest.

    same: equal at its place; moved: equal bytes elsewhere in the file; corrupt: other bytes under its id; missing: only
    in the first; extra: only in the second replica.
    """
    one, other = materialize(one, "replica-a"), materialize(other, "replica-b")
    bad = differing_leaves(materialize(tree(one), "tree-a"), materialize(tree(other), "tree-b"))
    count = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("offset"))
    a = one.join(bad, ["file", "place"], "left_semi").withColumn("copy", count)
    b = other.join(bad, ["file", "place"], "left_semi").withColumn("copy", count)
    same_record = (F.col("a.file") == F.col("b.file")) & F.col("a.record_id").eqNullSafe(F.col("b.record_id")) & (F.col("a.copy") == F.col("b.copy"))
    status = (
        F.when(F.col("b.digest").isNull(), "missing")
        .when(F.col("a.digest").isNull(), "extra")
        .when(F.col("a.digest") != F.col("b.digest"), "corrupt")
        .when((F.col("a.offset") != F.col("b.offset")) | (F.col("a.place") != F.col("b.place")), "moved")
        .otherwise("same")
    )
    both = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    differ = a.alias("a").join(b.alias("b"), same_record, "full").select(both("file"), both("record_id"), both("offset"), both("length"), both("digest"), status.alias("status"), F.col("b.digest").alias("other_digest"))
    agree = one.join(bad, ["file", "place"], "left_anti").select("file", "record_id", "offset", "length", "digest", F.lit("same").alias("status"), F.col("digest").alias("other_digest"))
    return agree.unionByName(differ)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers (lower-case names) and body of the records in a WARC file's bytes, gzipped or not. Offsets are those of the plain bytes; a torn last record is left out."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while head := _HEAD.match(data, at):
        pairs = (line.split(b":", 1) for line in head[1].split(b"\r\n") if b":" in line)
        headers = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in pairs}
        size = int(headers.get("content-length", "0"))
        end = head.end() + size + 4
        if end > len(data):
            return
        yield at, end - at, headers, data[head.end() : head.end() + size]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below `path`: file, offset, length, record_id, type, url, body."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                found = [(file, at, n, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), body) for at, n, h, body in parse(bytes(content))]
                yield pd.DataFrame(found, columns=["file", "offset", "length", "record_id", "type", "url", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, offset long, length long, record_id string, type string, url string, body binary")

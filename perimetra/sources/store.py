"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Rows of a shuffled table that one task sorts, about.
ROWS_AT_ONCE = 500_000


def settled(df: DataFrame) -> DataFrame:
    """df, written once to the folder in spark.checkpoint.dir that all executors share, and read back: what is used more
    than once is computed once. Where no folder is set, one of our own if all run on this machine; an error elsewhere."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="perimetra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(*frames: DataFrame) -> int:
    """Tasks over which the rows of the largest frame are dealt, so that what a task sorts does not grow with the input."""
    return -(-max(df.count() for df in frames) // ROWS_AT_ONCE)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df, dealt by its keys to `tasks` tasks where these are more than the session's own number."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > usual else df

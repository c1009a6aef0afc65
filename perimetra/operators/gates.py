"""The gates that a built image dataset must pass, counted in few passes over records and boxes.

records: image, split, sequence, modality (visible or lwir), negative, tile (null for whole frames), width, height, hash (64 bits), channels_equal (of thermal frames).
boxes: image, class_id, x, y, w, h (shares of the frame), height_px, untiled (from a whole frame).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.operators.datasets import gate_row, split_copies


@dataclass(frozen=True)
class Limits:
    """Thresholds of the gates."""

    near: int = 4
    within_share: float = 0.005
    classes: Sequence[int] = (0, 1, 2, 3)
    visible: tuple[float, float] = (0.4, 0.7)
    negatives: tuple[float, float] = (0.08, 0.12)
    class_share: float = 0.01
    documented: Sequence[int] = ()
    small_px: float = 19.0
    small_share: float = 0.05
    tiles: int = 2000
    tile_size: tuple[int, int] = (640, 640)
    splits: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "val": 0.15, "test": 0.15})
    tolerance: float = 0.02
    hard: int = 280


def _bad(condition: Column) -> Column:
    """How many rows meet the condition, or leave it open."""
    return F.count_if(F.coalesce(condition, F.lit(True)))


def observations(records: DataFrame, boxes: DataFrame, hard: DataFrame, digest: str | None, limits: Limits) -> DataFrame:
    """One row with what each gate observes, g1 to g16, and beside them wrong (tiles of another size) and others (hard images outside val).

    Records and boxes are each counted in one pass; only what needs its own grouping or join is apart.
    """
    m = limits
    known = F.array(*[F.lit(c) for c in m.classes])
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in ("x", "y", "w", "h")])
    of_class = [F.count_if(F.col("class_id") == c) for c in m.classes if c not in m.documented]
    starved = reduce(lambda a, b: a + b, [(n < m.class_share * F.count(F.lit(1))).cast("int") for n in of_class], F.lit(0))
    tile = F.col("tile").isNotNull() & ~F.col("negative")
    frame = records.filter("tile is null")
    hashes = records.filter("hash is not null")
    named = records.select("image", "negative").dropDuplicates(["image"])
    strays = boxes.select("image").join(named, "image", "left_anti").unionByName(named.filter("not negative").select("image").join(boxes, "image", "left_anti"))
    per_split = records.groupBy("split").agg(F.avg((F.col("modality") == "visible").cast("double")).alias("visible"), F.count_if(F.col("tile").isNull()).alias("n"))
    want = F.create_map(*[F.lit(x) for pair in m.splits.items() for x in pair])
    held = per_split.agg(_bad((F.col("visible") < m.visible[0]) | (F.col("visible") > m.visible[1])).alias("g8"), F.collect_list(F.struct("split", "n")).alias("parts"), F.sum("n").alias("frames"))
    off = F.array_max(F.transform(F.filter("parts", lambda p: p["n"] > 0), lambda p: F.abs(p["n"] / F.col("frames") - F.coalesce(want[p["split"]], F.lit(0.0)))))
    clean = hard.dropDuplicates(["image"]).join(frame.select("image", "split").dropDuplicates(["image"]), "image", "left")
    in_val = F.coalesce(F.col("split") == "val", F.lit(False))
    rows = [
        split_copies(hashes.select("image", "split", "hash"), m.near).agg(F.count(F.lit(1)).alias("g1")),
        hashes.groupBy("split", "hash").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(1 - F.count(F.lit(1)) / F.sum("n"), F.lit(0.0)).alias("g2")),
        records.groupBy("sequence").agg(F.count_distinct("split").alias("splits")).agg(F.count_if(F.col("splits") > 1).alias("g3")),
        boxes.agg(
            _bad(~inside).alias("g4"), _bad((F.col("w") <= 0) | (F.col("h") <= 0)).alias("g5"), _bad(~F.array_contains(known, F.col("class_id"))).alias("g6"), starved.alias("g11"),
            F.coalesce(F.avg((F.col("height_px") < m.small_px).cast("double")), F.lit(0.0)).alias("g12"),
        ),
        strays.agg(F.count(F.lit(1)).alias("g7")),
        held.select("g8", off.alias("g14")),
        records.agg(
            F.coalesce(F.avg(F.when(F.col("split") == "train", F.col("negative").cast("double"))), F.lit(0.0)).alias("g9"),
            F.count_if((F.col("modality") == "lwir") & F.coalesce(~F.col("channels_equal"), F.lit(True))).alias("g10"),
            F.count_if(tile).alias("g13"), F.count_if(tile & ((F.col("width") != m.tile_size[0]) | (F.col("height") != m.tile_size[1]))).alias("wrong"),
        ),
        clean.agg(F.count_if(in_val).alias("g15"), F.count_if(~in_val).alias("others")),
        split_digest(frame).select((F.col("digest") == F.lit(digest)).alias("g16")),
    ]
    rows = [r.select(*[F.col(c).cast("double").alias(c) for c in r.columns]) for r in rows]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def all_gates(records: DataFrame, boxes: DataFrame, hard: DataFrame, digest: str | None, limits: Limits | None = None, skipped: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """gate, name, threshold, observed, result (PASS, FAIL or SKIP, which is no pass), G1 to G16 and the `skipped` ones (gate, name, threshold).

    hard: images of the hard set; digest: what the split's digest was when it was recorded, None if it never was.
    """
    m = limits or Limits()
    seen = lambda k: F.col(f"g{k}")
    made = [
        (1, "no copies across splits", "= 0", seen(1) == 0), (2, "copies within a split", f"< {m.within_share}", seen(2) < m.within_share), (3, "no sequence in two splits", "= 0", seen(3) == 0),
        (4, "label values in [0, 1]", "= 0", seen(4) == 0), (5, "no box without area", "= 0", seen(5) == 0), (6, "known classes", "= 0", seen(6) == 0),
        (7, "labels of known images, images labelled or negative", "= 0", seen(7) == 0), (8, "visible share of each split", f"{m.visible[0]}-{m.visible[1]}", seen(8) == 0),
        (9, "negatives in train", f"{m.negatives[0]}-{m.negatives[1]}", seen(9).between(*m.negatives)), (10, "thermal frames with equal channels", "= 0", seen(10) == 0),
        (11, "no starved class", f">= {m.class_share} or documented", seen(11) == 0), (12, "small objects", f">= {m.small_share}", seen(12) >= m.small_share),
        (13, "tiles with objects, of one size", f">= {m.tiles}", (seen(13) >= m.tiles) & (F.col("wrong") == 0)), (14, "split proportions of whole frames", f"+/- {m.tolerance}", seen(14) <= m.tolerance),
        (15, "hard set from val only", f"= {m.hard}", (seen(15) == m.hard) & (F.col("others") == 0)), (16, "split as recorded", "digest equal", seen(16) == 1),
    ]
    rows = [gate_row(f"G{k}", name, threshold, seen(k), passed, F.lit(k == 16 and digest is None)) for k, name, threshold, passed in made]
    rows += [gate_row(ident, name, threshold, F.lit(None), F.lit(False), F.lit(True)) for ident, name, threshold in skipped]
    return observations(records, boxes, hard, digest, m).select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def split_digest(frames: DataFrame) -> DataFrame:
    """One digest of all (image, split) pairs, whatever their order: of the ordered digests of 256 parts by hash."""
    line = F.concat_ws("\t", "image", "split")
    parts = frames.select(line.alias("line"), F.substring(F.sha2(line, 256), 1, 2).alias("part")).distinct()
    parts = parts.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))

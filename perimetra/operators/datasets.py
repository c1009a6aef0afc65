"""Dataset preparation: unions, splits without leakage, balance, negatives, tiles, gates and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.operators import stateful
from perimetra.operators.search import cells


#: Leading hexadecimal digits of an order's hash that make its buckets.
ORDER_DIGITS = 4


def shuffle_key(seed: str, key: Column) -> Column:
    """A fixed pseudo-random order: the same for any input order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def union_sources(sources: dict[str, DataFrame], enabled: Sequence[str]) -> DataFrame:
    """One index of the enabled sources; a missing one is an error."""
    missing = [s for s in enabled if s not in sources]
    if missing:
        raise ValueError(f"sources without an index: {missing}")
    out = None
    for name in enabled:
        rows = sources[name].withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def leaks(rows: DataFrame, key: str = "sequence_key", split: str = "split") -> DataFrame:
    """Sequences in more than one split."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def carve(sequences: DataFrame, share: float | Column, seed: str, key: str = "sequence_key", size: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Whole sequences, in shuffled order, until they hold at least `share` of all frames: adds `carved`.

    Sizes are summed by the leading digits of the order's hash, so that only sequences of one bucket are put in order by a task.
    """
    marked = sequences.withColumn("__order", shuffle_key(seed, F.col(key))).withColumn("__bucket", F.substring("__order", 1, ORDER_DIGITS))
    groups = [*by, "__bucket"]
    sums = marked.groupBy(*groups).agg(F.sum(size).alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(groups)], F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__sum").over(Window.partitionBy(*by)).alias("__total"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate(groups)])
    within = Window.partitionBy(*groups).orderBy("__order", key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum(size).over(within), F.lit(0))
    share = share if isinstance(share, Column) else F.lit(share)
    return marked.join(known, same).withColumn("carved", before < share * F.col("__total")).select(*sequences.columns, "carved")


@dataclass(frozen=True)
class SplitPolicy:
    """How a source's sequences become splits.

    official: each goes where official_to sends its official split; with `carve` = (official split, share) that share of
    the frames of that official split goes to val first. resplit: official splits do not count; the shares val and test
    are carved one after the other, and the rest is train.
    """

    policy: str
    official_to: Mapping[str, str] = field(default_factory=dict)
    carve: tuple[str, float] | None = None
    val: float = 0.0
    test: float = 0.0


def pseudo_sequences(rows: DataFrame, most: int = 6) -> DataFrame:
    """Rows (image, seq, source, sequence_key, hash) whose sequence_key, where it lacks, names the leader of their near hashes
    in their source: source/pseudo/<the leader's seq>, or source/orphan/<image> without a hash."""
    bare = rows.filter("sequence_key is null and hash is not null").select("source", "seq", "hash").withColumn("t", F.lit(0.0))
    leader = stateful.batch(bare, ["source"], partial(stateful.Leaders, most), ("seq",)).select("source", "seq", "leader")
    met = rows.join(leader, ["source", "seq"], "left")
    made = F.when(F.col("leader").isNotNull(), F.concat_ws("/", "source", F.lit("pseudo"), "leader")).otherwise(F.concat_ws("/", "source", F.lit("orphan"), "image"))
    return met.withColumn("sequence_key", F.coalesce("sequence_key", made)).select(rows.columns)


def split_by_policy(rows: DataFrame, policies: Mapping[str, SplitPolicy], seed: str) -> DataFrame:
    """source, sequence_key, n, split, problem: the split of each sequence of rows (source, sequence_key, official).

    problem: `no policy` for its source, `spans official splits`, or `unrouted` (its official split has no place); such
    sequences have no split. `assigned` makes the first two errors. A source's own seed orders what is carved from it.
    """
    unknown = [p.policy for p in policies.values() if p.policy not in ("official", "resplit")]
    if unknown:
        raise ValueError(f"policy is 'official' or 'resplit', not {unknown}")
    table = [(name, p.policy, dict(p.official_to), p.carve[0] if p.carve else None, float(p.carve[1]) if p.carve else p.val, p.test) for name, p in policies.items()]
    known = rows.sparkSession.createDataFrame(table, "source string, policy string, route map<string,string>, carved_from string, val double, test double")
    own = rows.groupBy("source", "sequence_key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.coalesce("official", F.lit("unknown")))).alias("officials"))
    own = own.join(F.broadcast(known), "source", "left")  # a row for each source that was given
    resplit, single = F.col("policy") == "resplit", F.size("officials") == 1
    pool = resplit | (single & (F.element_at("officials", 1) == F.col("carved_from")))

    def carved(sequences: DataFrame, among: Column, share: Column, name: str) -> DataFrame:
        """The sequences with `name`: whether they are of the share carved from those `among`."""
        marked = sequences.withColumn("__in", F.coalesce(among, F.lit(False))).withColumn("__order", F.concat_ws(":", "source", "sequence_key"))
        return carve(marked, share, f"{seed}-{name}", "__order", "n", ["source", "__in"]).withColumn(name, F.col("__in") & F.coalesce("carved", F.lit(False))).drop("__in", "__order", "carved")

    own = carved(own, pool, F.col("val"), "to_val")
    own = carved(own, resplit & ~F.col("to_val"), F.col("test") / F.greatest(1 - F.col("val"), F.lit(1e-9)), "to_test")
    route = F.element_at("route", F.element_at("officials", 1))
    problem = F.when(F.col("policy").isNull(), "no policy").when(~resplit & ~single, "spans official splits").when(~resplit & ~F.col("to_val") & route.isNull(), "unrouted")
    split = F.when(F.col("to_val"), "val").when(F.col("to_test"), "test").when(resplit, "train").otherwise(route)
    return own.withColumn("problem", problem).select("source", "sequence_key", "n", F.when(F.col("problem").isNull(), split).alias("split"), "problem")


def assigned(splits: DataFrame) -> DataFrame:
    """The splits; an error at the first sequence that spans official splits or has no policy."""
    bad = F.col("problem").isin("no policy", "spans official splits")
    checked = F.when(bad, F.raise_error(F.concat(F.col("source"), F.lit(" "), F.col("sequence_key"), F.lit(": "), F.col("problem"))).cast("string")).otherwise(F.col("split"))
    return splits.withColumn("split", checked)


def decimate(rows: DataFrame, step: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every step-th row of each group, from the first on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("__n", n).filter(F.col("__n") % step == 0).drop("__n")


def balance(rows: DataFrame, label: Column, target: float, seed: str, key: str) -> DataFrame:
    """Drop rows with `label`, in shuffled order, until their share is at most `target`; all others stay."""
    n = rows.agg(F.count_if(label).alias("__with"), F.count_if(~label).alias("__without"))
    rank = F.row_number().over(Window.partitionBy("__label").orderBy(shuffle_key(seed, F.col(key)), key))
    keep = F.floor(F.lit(target) * F.col("__without") / (1 - target))
    marked = rows.withColumn("__label", label).withColumn("__rank", rank).join(F.broadcast(n))
    return marked.filter(~F.col("__label") | (F.col("__rank") <= keep)).drop("__label", "__rank", "__with", "__without")


def quota(rows: DataFrame, category: str, wants: dict[str, int], seed: str, key: str) -> DataFrame:
    """Up to the wanted number of each category, then, from what is left, as many more as categories fell short: adds `round` (1 or 2)."""
    table = F.create_map(*[x for k, v in wants.items() for x in (F.lit(k), F.lit(v))])
    order = Window.partitionBy(category).orderBy(shuffle_key(seed, F.col(key)), key)
    ranked = rows.withColumn("__want", F.coalesce(table[F.col(category)], F.lit(0))).withColumn("__rank", F.row_number().over(order))
    have = rows.groupBy(category).agg(F.count(F.lit(1)).alias("have"))
    wanted = rows.sparkSession.createDataFrame(list(wants.items()), f"{category} string, want long")
    short = wanted.join(have, category, "left").agg(F.sum(F.greatest(F.col("want") - F.coalesce("have", F.lit(0)), F.lit(0))).alias("__short"))
    rest = ranked.filter((F.col("__rank") > F.col("__want")) & (F.col("__want") > 0))
    spare = rest.withColumn("__hash", shuffle_key(seed, F.col(key))).join(F.broadcast(short))
    second = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__hash", key))
    most = sum(wants.values())
    extra = spare.orderBy("__hash", key).limit(most).withColumn("__second", second).filter(F.col("__second") <= F.col("__short"))
    one = ranked.filter(F.col("__rank") <= F.col("__want")).withColumn("round", F.lit(1))
    return one.select(*rows.columns, "round").unionByName(extra.withColumn("round", F.lit(2)).select(*rows.columns, "round"))


def negatives_needed(positives: int, ratio: float) -> int:
    """How many negatives make up `ratio` of the whole."""
    return int(ratio * positives / (1 - ratio))


def negative_kind(objects: Column, source: Column, worthy: Column, animal: Column, hotspot: Column, lighting: Column, never: Sequence[str] = ()) -> Column:
    """What an empty frame is good for, or null."""
    return F.when(objects > 0, None).when(source.isin(*never) if never else F.lit(False), None).when(~worthy, None).when(animal, "animal").when(hotspot, "ir_hotspot").when(lighting == "night", "night_glare").otherwise("empty_road")


def round_robin(rows: DataFrame, by: Sequence[str], source: str, seed: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum, taking the sources in turn."""
    turn = F.row_number().over(Window.partitionBy(*by, source).orderBy(shuffle_key(seed, F.col(key)), key))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__turn", source))
    return rows.withColumn("__turn", turn).filter(F.col("__turn") <= n).withColumn("__place", place).filter(F.col("__place") <= n).drop("__turn", "__place")


def tiles(width: int, height: int, size: int, overlap: float) -> list[tuple[int, int, int, int]]:
    """Overlapping windows that cover a frame; the last of a row or column ends at the edge."""
    step = max(1, int(size * (1 - overlap)))

    def starts(length: int) -> list[int]:
        return sorted({*range(0, max(length - size, 0) + 1, step), max(length - size, 0)})

    return [(x, y, min(x + size, width), min(y + size, height)) for y in starts(height) for x in starts(width)]


def clip_to_tiles(boxes: DataFrame, windows: Sequence[tuple[int, int, int, int]], min_kept: float = 0.5) -> DataFrame:
    """Boxes (x1, y1, x2, y2) cut to each window, in its coordinates, where at least `min_kept` of their area stays: adds tile, kept."""
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("tile"), *[F.lit(float(v)).alias(n) for n, v in zip(("wx1", "wy1", "wx2", "wy2"), w, strict=True)]) for i, w in enumerate(windows)]))
    met = boxes.withColumn("w", spread)
    cut = {"x1": F.greatest("x1", "w.wx1") - F.col("w.wx1"), "y1": F.greatest("y1", "w.wy1") - F.col("w.wy1"), "x2": F.least("x2", "w.wx2") - F.col("w.wx1"), "y2": F.least("y2", "w.wy2") - F.col("w.wy1")}
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    inside = F.greatest(cut["x2"] - cut["x1"], F.lit(0.0)) * F.greatest(cut["y2"] - cut["y1"], F.lit(0.0))
    return met.withColumn("kept", F.when(area > 0, inside / area).otherwise(0.0)).filter(F.col("kept") >= min_kept).select(*[cut.get(c, F.col(c)).alias(c) for c in boxes.columns], F.col("w.tile").alias("tile"), "kept")


def far_windows(frames: DataFrame, boxes: DataFrame, windows: Sequence[tuple[int, int, int, int]], key: str = "image") -> DataFrame:
    """Windows of each frame that no box touches."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("tile"), *[F.lit(float(v)).alias(n) for n, v in zip(("wx1", "wy1", "wx2", "wy2"), w, strict=True)]) for i, w in enumerate(windows)])).alias("w")
    grid = frames.select(key, cells).select(key, "w.*")
    b = boxes.select(key, *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    touches = (grid[key] == b[key]) & (F.col("bx1") < F.col("wx2")) & (F.col("bx2") > F.col("wx1")) & (F.col("by1") < F.col("wy2")) & (F.col("by2") > F.col("wy1"))
    return grid.join(b, touches, "left_anti")


def remap(rows: DataFrame, table: dict[str, str], native: str = "class_name") -> tuple[DataFrame, DataFrame]:
    """Rows with their mapped class, and rows of classes that the table does not know."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    mapped = rows.withColumn("mapped", known[F.col(native)])
    return mapped.filter("mapped is not null"), mapped.filter("mapped is null").drop("mapped")


def majority(rows: DataFrame, key: str, value: str, priority: Sequence[str]) -> DataFrame:
    """The most frequent value of each key; of equals the one listed first."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(value))
    return n.groupBy(key).agg(F.max_by(value, F.struct("votes", -rank)).alias(value))


def modality_of(stem: Column) -> Column:
    """visible or lwir, by the ending of a file's stem; null where it has neither."""
    return F.nullif(F.regexp_extract(stem, r"_(visible|lwir)$", 1), F.lit(""))


def with_tiles(frames: DataFrame, excluded: DataFrame, tiles: DataFrame, key: str = "image") -> DataFrame:
    """Frames that are not excluded, and the tiles cut from frames."""
    return frames.join(excluded.select(key), key, "left_anti").unionByName(tiles.select(frames.columns))


def blocked(rows: DataFrame, natives: str, blocking: Sequence[str]) -> DataFrame:
    """Rows with the native classes that block them, sorted; only those that have any."""
    found = F.array_sort(F.array_intersect(F.col(natives), F.array(*[F.lit(b) for b in blocking])))
    return rows.withColumn("blocked_by", found).filter(F.size("blocked_by") > 0)


def ranked_candidates(rows: DataFrame, small: str, key: str, n: int) -> DataFrame:
    """The n candidates with most small objects, ties by key."""
    return rows.orderBy(F.desc(small), key).limit(n)


def class_gate(sheet: DataFrame, cls: str, least: int, verdict: str = "verdict") -> DataFrame:
    """One row on a class that people reviewed: candidates, verified, rejected, unreviewed, and whether it is shipped (`least` verified)."""
    own = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    counts = sheet.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(own == cls).alias("verified"), F.count_if(own.isin(f"not_{cls}", f"not{cls}", "no")).alias("rejected"))
    counts = counts.withColumn("unreviewed", F.col("candidates") - F.col("verified") - F.col("rejected"))
    return counts.withColumn("decision", F.when(F.col("verified") >= least, "ship").otherwise("withdraw"))


def placement(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """What it takes to make a listing (path, bytes) what is wanted: place, replace (another size), keep, or remove (stale)."""
    both = wanted.select("path", F.col("bytes").alias("want")).join(listing.select("path", F.col("bytes").alias("have")), "path", "full")
    action = F.when(F.col("want").isNull(), "remove").when(F.col("have").isNull(), "place").when(F.col("want") != F.col("have"), "replace").otherwise("keep")
    return both.select("path", action.alias("action"), F.col("want").alias("bytes"))


def split_copies(rows: DataFrame, most: int = 10) -> DataFrame:
    """Pairs of rows (image, split, hash) of different splits whose hashes agree in the 16 highest bits and differ in `most` bits at most.

    Rows of one hash and split stand as one, with their number, so that copies do not multiply; a hot bucket is compared
    in cells of bounded size.
    """
    one = rows.groupBy("split", "hash", F.shiftrightunsigned("hash", 48).alias("bucket")).agg(F.min("image").alias("image"), F.count(F.lit(1)).alias("n"))
    placed = cells(one, ["bucket"], "hash")
    a, b = (placed.select("bucket", "low", "high", *[F.col(c).alias(f"{c}_{side}") for c in ("split", "hash", "image", "n", "own")]) for side in ("a", "b"))
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    place = (F.least("own_a", "own_b") == F.col("low")) & (F.greatest("own_a", "own_b") == F.col("high"))
    met = a.join(b, ["bucket", "low", "high"]).filter(place & (F.col("split_a") < F.col("split_b")) & (distance <= most))
    return met.select("split_a", "split_b", "image_a", "image_b", "n_a", "n_b", distance.cast("int").alias("distance"))


def gate_row(ident: str, name: str, threshold: str, observed: Column, passed: Column, skip: Column | None = None) -> Column:
    """One gate's row, as a struct; a skipped gate has not passed."""
    result = F.when(passed, "PASS").otherwise("FAIL")
    result = result if skip is None else F.when(skip, "SKIP").otherwise(result)
    return F.struct(F.lit(ident).alias("gate"), F.lit(name).alias("name"), F.lit(threshold).alias("threshold"), observed.cast("double").alias("observed"), result.alias("result"))


def gate(ident: str, name: str, threshold: str, observed: DataFrame, passed: Column, skip: Column | None = None) -> DataFrame:
    """One gate's row from an aggregate with a column `observed`."""
    return observed.select(gate_row(ident, name, threshold, F.col("observed"), passed, skip).alias("g")).select("g.*")


def hard_set(rows: DataFrame, buckets: Sequence[tuple[str, Column, int, Sequence[str], float | None]], total: int, key: str) -> DataFrame:
    """A set of `total` hard rows, those of each bucket in turn: adds `bucket`.

    A bucket (name, condition, number, order, share) takes the first `number` of the rows that meet its condition and that
    no bucket before took; with a share, only of that share of all rows that meet it (one at least), first in its order.
    Rows that a full bucket leaves may go to a later one. Others then fill up by `key`. Numbers bound what is taken, so
    taken keys are few.
    """
    taken, parts = None, []
    for place, (name, condition, number, order, share) in enumerate([*buckets, ("filler", F.lit(True), total, (key,), None)]):
        fit = rows.filter(condition)
        if share is not None:
            so_far = sum(n for _, _, n, _, _ in buckets[:place])
            fit = fit.orderBy(*order).limit(min(max(1, int(fit.count() * share)), so_far + number))
        fit = fit if taken is None else fit.join(taken, key, "left_anti")
        part = fit.orderBy(*order).limit(number).withColumn("bucket", F.lit(name)).withColumn("__place", F.lit(place))
        parts.append(part.withColumn("__rank", F.row_number().over(Window.partitionBy("__place").orderBy(*order))))
        taken = part.select(key) if taken is None else taken.unionByName(part.select(key))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy("__place", "__rank").limit(total).drop("__place", "__rank")


def reconcile(manifest: DataFrame, listing: DataFrame, stem: Column) -> DataFrame:
    """Manifest entries (entry) against files (path) by derived stem: found, missing, or ambiguous."""
    files = listing.select(stem.alias("entry"), "path").groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return manifest.join(files, "entry", "left").select(*manifest.columns, status.alias("status"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def ranked_reasons(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n reasons that matter most: blocking first, then priority, impact and key."""
    return rows.orderBy(F.desc("blocking"), "priority", F.desc("impact"), "key").limit(n)


def first_of(rows: DataFrame, wants: DataFrame, by: Sequence[str], seed: str, key: Column, ahead: Column | None = None) -> DataFrame:
    """The first `want` rows of each group in shuffled order, those `ahead` before the others, exactly and without a task
    that sorts a group.

    wants: by, want. Rows are counted by the leading digits of their hash; whole buckets below the cut are taken, and only
    the rows of the bucket that holds the cut are ranked.
    """
    order = shuffle_key(seed, key)
    late = F.lit(0) if ahead is None else F.when(F.coalesce(ahead, F.lit(False)), 0).otherwise(1)
    marked = rows.withColumn("__order", order).withColumn("__bucket", F.concat(late.cast("string"), F.substring("__order", 1, ORDER_DIGITS)))
    counts = marked.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    past = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("__before", past).join(wants, list(by)).filter(F.col("__before") < F.col("want"))
    near = marked.join(cut, [*by, "__bucket"])
    whole = near.filter(F.col("__before") + F.col("__n") <= F.col("want"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__order", key))
    partly = near.filter(F.col("__before") + F.col("__n") > F.col("want")).withColumn("__place", place).filter(F.col("__place") <= F.col("want")).drop("__place")
    return whole.unionByName(partly).select(rows.columns)


def _origins(extent: Column, tile: int, overlap: float) -> Column:
    step = max(1, round(tile * (1 - overlap)))
    last = extent - tile
    return F.when(last >= 0, F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(F.greatest(last, F.lit(0))))))


def strip_windows(frames: DataFrame, tile: int = 640, overlap: float = 0.2, top: float = 0.0, bottom: float = 0.4) -> DataFrame:
    """The frames (width, height) with each place (ox, oy) of a tile over the strip between top and bottom, shares of the
    height. A strip thinner than a tile has one row of them, from its top; a frame smaller than a tile, or that has no room
    below the strip's top, has none."""
    y1, y2 = F.floor(F.col("height") * top).cast("int"), F.floor(F.col("height") * bottom).cast("int")
    deep = F.when(y2 - y1 < tile, F.least(F.col("height"), y1 + tile) - y1).otherwise(y2 - y1).cast("int")
    fits = (F.col("width") >= tile) & (F.col("height") >= tile) & (deep >= tile)
    rows = frames.filter(fits).withColumn("__oy", F.explode(_origins(deep, tile, overlap)))
    return rows.withColumn("oy", y1 + F.col("__oy")).withColumn("ox", F.explode(_origins(F.col("width").cast("int"), tile, overlap))).drop("__oy")


def tile_candidates(frames: DataFrame, boxes: DataFrame, tile: int = 640, overlap: float = 0.2, top: float = 0.0, bottom: float = 0.4, least_kept: float = 0.3, small_px: float = 27.0) -> DataFrame:
    """image, modality, ox, oy, n_boxes, small: tiles over the far strip of frames (image, modality, width, height) in which
    `least_kept` of some box (image, x1, y1, x2, y2) stays, and whether one of those is at most `small_px` high."""
    places = strip_windows(frames, tile, overlap, top, bottom).select("image", "modality", "ox", "oy")
    inside = F.greatest(F.least("x2", F.col("ox") + tile) - F.greatest("x1", "ox"), F.lit(0.0)) * F.greatest(F.least("y2", F.col("oy") + tile) - F.greatest("y1", "oy"), F.lit(0.0))
    area = F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1e-9))
    met = places.join(boxes.select("image", "x1", "y1", "x2", "y2"), "image").filter((inside > 0) & (inside / area >= least_kept))
    return met.groupBy("image", "modality", "ox", "oy").agg(F.count(F.lit(1)).alias("n_boxes"), F.bool_or(F.col("y2") - F.col("y1") <= small_px).alias("small"))


def tile_plan(candidates: DataFrame, budget: int = 6000, share: float = 0.35, seed: str = "tiles", modality: str = "lwir") -> DataFrame:
    """Of the tile candidates `budget` at most: `share` of them of `modality` and the rest of the others, each side filled up
    by the other where it is short; tiles with small objects come first on both sides."""
    own = F.coalesce(F.col("modality") == modality, F.lit(False))
    marked = candidates.withColumn("__own", own)
    have = marked.agg(F.count_if("__own").alias("own"), F.count_if(~F.col("__own")).alias("others")).first()
    first = min(have["own"], round(budget * share))
    others = min(have["others"], budget - first)
    first = min(have["own"], budget - others)
    wants = candidates.sparkSession.createDataFrame([(True, first), (False, others)], "__own boolean, want long")
    place = F.concat_ws(":", "image", "oy", "ox")
    return first_of(marked, wants, ["__own"], seed, place, F.col("small")).drop("__own")


def negatives_wanted(positives: int, ratio: float) -> int:
    """Negatives that make `ratio` of all, given the positives."""
    return round(ratio * positives / max(1e-9, 1 - ratio))


def filled_negatives(candidates: DataFrame, empty: DataFrame, target: int, shares: Mapping[str, float], seed: str, key: str = "image", per_frame: int = 1) -> DataFrame:
    """`target` negatives: key, category, origin. Each category of the candidates (key, category) gets its share of the
    target (origin quota); what some lack the others fill (redistributed); what is still missing, empty tiles do
    (key, ox, oy; origin tile, `per_frame` of a frame at most)."""
    spark = candidates.sparkSession
    quotas = spark.createDataFrame([(name, round(target * share)) for name, share in sorted(shares.items())], "category string, want long")
    chosen = first_of(candidates.select(key, "category"), quotas, ["category"], seed, F.col(key)).withColumn("origin", F.lit("quota"))
    left = candidates.select(key, "category").join(chosen.select(key), key, "left_anti").withColumn("__all", F.lit(0))
    missing = max(0, target - chosen.count())
    more = first_of(left, spark.createDataFrame([(0, missing)], "__all int, want long"), ["__all"], f"{seed}-spare", F.col(key)).drop("__all").withColumn("origin", F.lit("redistributed"))
    missing = max(0, missing - more.count())
    place = F.concat_ws(":", key, "oy", "ox")
    turn = F.row_number().over(Window.partitionBy(key).orderBy(shuffle_key(f"{seed}-frame", place), place))
    pool = empty.select(key, "ox", "oy").withColumn("__turn", turn).filter(F.col("__turn") <= per_frame).drop("__turn").withColumn("__all", F.lit(0))
    tiles_taken = first_of(pool, spark.createDataFrame([(0, missing)], "__all int, want long"), ["__all"], f"{seed}-tiles", place).select(place.alias(key), F.lit(None).cast("string").alias("category"), F.lit("tile").alias("origin"))
    return chosen.withColumn(key, F.col(key).cast("string")).unionByName(more.withColumn(key, F.col(key).cast("string"))).unionByName(tiles_taken)

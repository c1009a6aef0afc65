"""N-gram Jaccard join by a MinHash LSH forest.

Every text becomes the set of its five-word shingles; texts of one set are one class and take part once. Each tree of
the forest holds a string of minhash values for each class, the most significant byte first, so that the order of the
strings is the order of the trie's leaves and a prefix of the string is a node. Classes below one node of the current
depth are candidates. The depth begins at the longest prefix by which a pair at the threshold meets in some tree with a
chance of FLOOR. What is found is verified exactly, on whole shingle sets. Each verified link of similarity s had the
chance 1 - (1 - s**depth)**trees of being found, so one over that chance, summed over the links, estimates how many there
are; while the links found are fewer than `target_recall` of them, all prefixes are shortened by a value and the join is
taken again.

Nodes are not verified one by one, since near copies share a node in most trees. All nodes that have the same head (the
first class below them, in one order of the classes for all trees) are one group, and a class joins the groups of its
distinct heads. Two classes that share a node share its head; the pair counts in the group of its first common head
only. Groups are not closed transitively: all members share a node with the head. Groups are compared block against
block; a task returns counts of links and the edges of a spanning star, never pairs.

Work of a group grows with the square of its distinct texts, as every link counts, divided by BLOCK_ROWS in rows moved.

Edge cases: null and empty texts, and texts without words, have no shingles; those with the same (null as empty) text
are one class and link to each other only. A text of one to four words is one shingle. Repeated rows are copies, as are
texts of one shingle set under any doc_ids; several texts under one doc_id, and rows without a doc_id, are told apart by
their texts and all take part (so a doc_id that names texts of two classes may be the class_id of both). class_id and
copy_id are null where no row of the class has a doc_id. Extra columns are not carried by `ngram_join`.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import bounded_batches, discard, map_texts, materialize, mix, shingles, spare_name

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
TARGET_RECALL = 0.9995
#: Chance with which a pair just at the threshold must meet, at least.
FLOOR = 0.999
#: A block holds at most so many classes and about so many shingles.
BLOCK_ROWS = 160
BLOCK_SHINGLES = 60_000
#: Join hint for tables that grow with the data: they are not broadcast, even where they are still small enough.
GROWN = "merge"


def chance(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """That a pair shares a prefix of `depth` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def first_depth(threshold: float, trees: int, max_depth: int, floor: float = FLOOR) -> int:
    """The longest prefix by which a pair at the threshold meets with the chance `floor`."""
    return next((d for d in range(max_depth, 1, -1) if chance(threshold, d, trees) >= floor), 1)


def _signatures(hashes: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Minhash values, 32 bits each, of the texts with shingles: texts x trees x depth."""
    seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
    begin = first[:-1][np.diff(first) > 0]
    values = np.zeros((len(begin), trees * depth), np.uint32)
    if len(begin):
        for k in range(trees * depth):
            least = np.minimum.reduceat((hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), begin)
            values[:, k] = mix(least) >> np.uint64(32)
    return values.reshape(len(begin), trees, depth)


def _set_digest(own: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(mix(own))), int(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D))))


def _sets(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingles of each text, and a 128-bit digest of that set (without shingles: of the text) as two numbers."""
    hashes, first = shingles(texts, SHINGLE)
    sets = [np.unique(hashes[a:b]) for a, b in itertools.pairwise(first.tolist())]
    digest = np.zeros((len(sets), 2), np.uint64)
    for i, own in enumerate(sets):
        if len(own):
            digest[i] = _set_digest(own)
        else:
            raw = (texts[i] or "").encode()
            digest[i] = len(raw), int.from_bytes(hashlib.sha256(raw).digest()[:8], "big")
    return sets, digest.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and row_key, by which a class finds the row that stands for it."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def signatures(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, row_key, set_hi, set_lo (digest of the shingle set), n_shingles, strings (of minhash values, one for each tree)."""

    def work(texts: list[str | None]) -> dict[str, object]:
        sets, digest = _sets(texts)
        size = np.array([len(s) for s in sets], np.int64)
        made = _signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))), trees, depth)
        strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), made.size // depth, [None, pa.py_buffer(made.astype(">u4").tobytes())])
        first = pa.array(np.concatenate(([0], np.cumsum((size > 0) * trees))).astype(np.int32))
        return {"set_hi": digest[:, 0], "set_lo": digest[:, 1], "n_shingles": size, "strings": pa.ListArray.from_arrays(first, strings.cast(pa.binary()))}

    return map_texts(_rows(docs), work, "set_hi long, set_lo long, n_shingles long, strings array<binary>", keep=("doc_id", "row_key"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label (its component's smallest node) of the undirected edges (a, b): labels spread to neighbours and then
    jump to the label's label. Every round but the last makes some label smaller, so the rounds end."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-0")
    for step in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label")).hint(GROWN), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near.hint(GROWN), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialize(spread.join(jump.hint(GROWN), "label").select("node", "old", F.least("label", "further").alias("label")), f"{name}-{step}")
        discard(labels)
        if after.filter("old <> label").isEmpty():
            discard(both)
            return after.select("node", "label")
        labels = after.select("node", "label")


def _groups(classes: DataFrame, depth: int) -> DataFrame:
    """node, heads: the classes that share a node of `depth` with another, and the distinct heads of their nodes (one for each tree at most)."""
    prefix = F.transform("strings", lambda s, tree: F.xxhash64(tree, F.substring(s, 1, 4 * depth)))
    nodes = classes.filter("n_shingles > 0").select("node", F.explode(prefix).alias("prefix"))
    heads = nodes.groupBy("prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("prefix", "head")
    return nodes.join(heads.hint(GROWN), "prefix").groupBy("node").agg(F.sort_array(F.collect_set("head")).alias("heads"))


def _compare(nodes: np.ndarray, copies: np.ndarray, earlier: list[np.ndarray], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float, chance_of) -> pd.DataFrame:
    """Links of left x right that have no earlier head in common, exactly, from the sizes of set intersections; as counts
    for each class and a star for each clump. seen, due: number of links and the sum of one over their chances."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    values, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[inverse] > 1
    renumber = np.cumsum(seen > 1) - 1
    column, row = renumber[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    place_right = np.full(len(sets), -1)
    place_right[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(seen[seen > 1].size), width):
        a, b = np.searchsorted(column, [low, low + width])
        c, r = column[a:b] - low, row[a:b]
        one = np.zeros((len(left), width), np.float32)
        is_left = place[r] >= 0
        one[place[r[is_left]], c[is_left]] = 1
        if same:
            two = one
        else:
            two = np.zeros((len(right), width), np.float32)
            is_right = place_right[r] >= 0
            two[place_right[r[is_right]], c[is_right]] = 1
        common += one @ two.T
    either = size[left][:, None] + size[right][None, :] - common
    linked = common >= threshold * either - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    fresh = ~_share(earlier, a, b)
    a, b, i, j = a[fresh], b[fresh], i[fresh], j[fresh]
    if not len(a):
        return _NO_LINKS
    found_by = chance_of(common[i, j] / np.maximum(either[i, j], 1))
    found_by = np.where(a < b, 1 / found_by, 0.0) if same else 1 / found_by  # each pair once
    links = np.zeros(len(sets), np.int64)
    np.add.at(links, a, copies[b])
    if not same:
        np.add.at(links, b, copies[a])
    top = np.arange(len(sets))
    while True:  # smallest number in each clump
        new = top.copy()
        np.minimum.at(new, a, top[b])
        np.minimum.at(new, b, top[a])
        new = new[new]
        if (new == top).all():
            break
        top = new
    found = np.flatnonzero(links)
    out = pd.DataFrame({"a": nodes[found], "b": nodes[top[found]], "links": links[found], "seen": 0, "due": 0.0})
    out.loc[0, ["seen", "due"]] = float(np.count_nonzero(found_by)), found_by.sum()
    return out.astype(_LINKS)


_LINKS = {"a": "int64", "b": "int64", "links": "int64", "seen": "float64", "due": "float64"}
_NO_LINKS = pd.DataFrame({k: [] for k in _LINKS}).astype(_LINKS)


def _share(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows have an entry of their lists in common."""
    width = max(map(len, lists), default=0)
    out = np.zeros(len(a), np.bool_)
    if not width:
        return out
    table = np.full((len(lists), width), -1, np.int64)
    for row, own in zip(table, lists, strict=True):
        row[: len(own)] = own
    for low in range(0, len(a), 4096):
        x, y = table[a[low : low + 4096]], table[b[low : low + 4096]]
        hit = np.zeros(len(x), np.bool_)
        for k in range(width):
            hit |= ((x[:, k : k + 1] == y) & (y >= 0)).any(axis=1)
        out[low : low + 4096] = hit
    return out


def _verified(docs: DataFrame, classes: DataFrame, depth: int, trees: int, threshold: float) -> DataFrame:
    """a, b, links, seen, due: counts of links (a's own) and edges (a, b) of spanning stars, from all groups of `depth`."""
    about = classes.select("node", "set_hi", "set_lo", "row_key", "copies", F.col("n_shingles").alias("weight"))
    members = materialize(_groups(classes, depth).join(about.hint(GROWN), "node"), "members")
    sizes = members.select(F.explode("heads").alias("head"), "weight").groupBy("head").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total"))
    blocks = F.least(F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)), "rows").cast("int")
    by_head = members.select("node", F.explode("heads").alias("head")).join(sizes.select("head", blocks.alias("blocks")).hint(GROWN), "head")
    placed = by_head.groupBy("node").agg(F.collect_list(F.struct("head", "blocks")).alias("places"))  # TREES at most
    wanted = members.join(placed.hint(GROWN), "node").select("row_key", "node", "set_hi", "set_lo", "copies", "heads", "places")
    texts = _rows(docs).join(wanted.hint(GROWN), "row_key")

    def to_sets(texts: list[str | None]) -> dict[str, object]:
        sets, digest = _sets(texts)
        return {"shingles": [s.tobytes() for s in sets], "own_hi": digest[:, 0], "own_lo": digest[:, 1]}

    sets = map_texts(texts, to_sets, "shingles binary, own_hi long, own_lo long", ("node", "set_hi", "set_lo", "copies", "heads", "places"))
    sets = sets.filter("own_hi = set_hi and own_lo = set_lo")  # a row_key may name another row too
    met = sets.select("node", "copies", "heads", "shingles", F.explode("places").alias("place"))
    met = met.select("node", "copies", "heads", "shingles", F.col("place.head").alias("head"), F.col("place.blocks").alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node", "head"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "copies", "heads", "shingles", "head", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        head, low, high = key
        block = pdf["block"].to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(left) or not len(right) or len(pdf) < 2:
            return _NO_LINKS
        own = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        earlier = [np.asarray(h)[np.asarray(h) < head] for h in pdf["heads"]]
        return _compare(pdf["node"].to_numpy(), pdf["copies"].to_numpy(), earlier, own, left, right, low == high, threshold, lambda s: chance(s, depth, trees))

    found = materialize(met.groupBy("head", "low", "high").applyInPandas(verify, "a long, b long, links long, seen double, due double"), "links")
    discard(members)
    return found


def _joined(docs: DataFrame, threshold: float, trees: int, max_depth: int, target_recall: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc_id, row_key, set_hi, set_lo, n_shingles), classes (set_hi, set_lo, row_key, copy_id, copies, links, label), and the tables that both read."""
    bounded_batches(docs.sparkSession)
    depth = first_depth(threshold, trees, max_depth)
    known = materialize(signatures(docs, trees, depth), "signatures")
    alike = [F.first(c).alias(c) for c in ("n_shingles", "strings")]  # the same for all texts of a set
    same_set = known.groupBy("set_hi", "set_lo").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), *alike)
    classes = materialize(same_set.withColumn("node", F.monotonically_increasing_id()), "classes")
    while True:
        found = _verified(docs, classes, depth, trees, threshold)
        seen = found.agg(F.sum("seen").alias("seen"), F.sum("due").alias("due")).first()
        if depth == 1 or not seen["due"] or seen["seen"] >= target_recall * seen["due"]:
            break
        discard(found)
        depth -= 1
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    label = components(found.filter("a <> b"), "links")
    own = classes.drop("strings").join(links.hint(GROWN), "node", "left").join(label.hint(GROWN), "node", "left")
    own = own.select("set_hi", "set_lo", "row_key", "copy_id", "copies", "links", F.coalesce("label", "node").alias("label"))
    return known.drop("strings"), own, [known, classes, found, label]


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_shingles.

    class_id is the smallest doc_id of the documents it hangs together with by links of similarity >= threshold; copy_id
    the smallest doc_id with the same shingle set; n_links the number of other documents at >= threshold, copies
    included.
    """
    known, classes, _ = _joined(docs, threshold, trees, max_depth, target_recall)
    named = classes.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    done = classes.join(named.hint(GROWN), "label").select("set_hi", "set_lo", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return known.drop("row_key").join(done.hint(GROWN), ["set_hi", "set_lo"]).select("doc_id", "class_id", "copy_id", "n_links", "n_shingles")


def one_of_each(docs: DataFrame, **options: object) -> DataFrame:
    """One document of each class, all columns kept: the row with the smallest doc_id (rows without one come last)."""
    settings = {"threshold": THRESHOLD, "trees": TREES, "max_depth": MAX_DEPTH, "target_recall": TARGET_RECALL} | options
    known, classes, held = _joined(docs, **settings)
    label = known.join(classes.select("set_hi", "set_lo", "label").hint(GROWN), ["set_hi", "set_lo"])
    first = label.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias("row_key"))
    kept = materialize(label.select("row_key").join(first.hint(GROWN), "row_key", "left_semi").groupBy("row_key").count(), "kept")
    name = spare_name(docs, "row_key")
    discard(*held)
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    once, often = (kept.filter(f"count {sign} 1").select(F.col("row_key").alias(name)).hint(GROWN) for sign in ("=", ">"))
    repeated = keyed.join(often, name, "left_semi").dropDuplicates([name])
    return keyed.join(once, name, "left_semi").unionByName(repeated).select(docs.columns)

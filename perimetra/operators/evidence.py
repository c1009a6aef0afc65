"""Tamper-evident ledgers: canonical bytes, hash chains, Merkle trees, gaps and their verification."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.sources.store import settled

GENESIS = "0" * 64
FIELDS = ("n", "clip_id", "camera_id", "started_at", "ended_at", "sealed_at", "clip_sha256", "frame_count", "byte_length", "prev_block_hash")


def canonical(domain: str, fields: Sequence[tuple[str, Column]]) -> Column:
    """The text that is hashed: the domain, then name=value lines, each ended by a line feed."""
    lines = [F.lit(domain), *[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit(""))) for n, c in fields]]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def block_hash(fields: Sequence[str] = FIELDS, domain: str = "block/1") -> Column:
    return F.sha2(canonical(domain, [(n, F.col(n)) for n in fields]), 256)


def chained(blocks: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str], domain: str = "block/1", heads: DataFrame | None = None) -> DataFrame:
    """Adds n, prev_block_hash and block_hash: each chain is a fold over its blocks in order, streamed through in sorted partitions.

    heads: by, head_n, head_hash: where chains that exist go on.
    """
    body = canonical(domain, [(n, F.col(n)) for n in fields])
    own = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    if heads is not None:
        blocks = blocks.join(heads.select(*by, F.col("head_n").alias("__n0"), F.col("head_hash").alias("__h0")), list(by), "left")
    else:
        blocks = blocks.withColumn("__n0", F.lit(None).cast("long")).withColumn("__h0", F.lit(None).cast("string"))
    rows = blocks.withColumn("__own", own).withColumn("n", F.coalesce("__n0", F.lit(0).cast("long")) + F.col("__own")).withColumn("__head", F.coalesce("__h0", F.lit(GENESIS))).drop("__n0", "__h0")
    rows = rows.withColumn("__body", body).repartition(*[F.col(b) for b in by]).sortWithinPartitions(*by, "n")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = GENESIS
        for pdf in batches:
            before, own = [], []
            for own_n, head, text in zip(pdf["__own"], pdf["__head"], pdf["__body"], strict=True):
                prev = head if own_n == 1 else prev
                before.append(prev)
                prev = hashlib.sha256(f"{text}prev={prev}\n".encode()).hexdigest()
                own.append(prev)
            yield pdf.drop(columns=["__body", "__own", "__head"]).assign(prev_block_hash=before, block_hash=own)

    out = rows.drop("__body", "__own", "__head").schema.add("prev_block_hash", "string").add("block_hash", "string")
    return rows.mapInPandas(fold, out)


def chain_hash(fields: Sequence[str], domain: str = "block/1") -> Column:
    """The hash a block of `chained` should have, from its own fields and stored predecessor."""
    body = canonical(domain, [(n, F.col(n)) for n in fields])
    return F.sha2(F.concat(body, F.lit("prev="), F.col("prev_block_hash"), F.lit("\n")), 256)


def verify(blocks: DataFrame, own_hash: Column, by: Sequence[str] = (), clip_ok: Column | None = None) -> DataFrame:
    """Each block with `reasons` of its own and `ok`.

    A hash that does not recompute, a broken link or a bad clip taints all later blocks of the chain; a gap in the
    numbers or a step back of sealed_at fails its own block only.
    """
    order = Window.partitionBy(*by).orderBy("n")
    checks = [
        ("hash", F.col("block_hash") != own_hash, True),
        ("link", F.coalesce(F.col("prev_block_hash") != F.lag("block_hash").over(order), F.col("prev_block_hash") != GENESIS), True),
        ("clip", ~clip_ok if clip_ok is not None else F.lit(False), True),
        ("sequence", F.coalesce(F.col("n") != F.lag("n").over(order) + 1, F.col("n") != 1), False),
        ("sealed_at", F.coalesce(F.col("sealed_at") < F.lag("sealed_at").over(order), F.lit(False)), False),
    ]
    rows = blocks.select("*", *[F.coalesce(bad, F.lit(True)).alias(f"__{name}") for name, bad, _ in checks])
    taints = F.greatest(*[F.col(f"__{name}").cast("int") for name, _, t in checks if t])
    tainted = F.max(taints).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    reasons = F.array_compact(F.array(*[F.when(F.col(f"__{name}"), F.lit(name)) for name, _, _ in checks]))
    return rows.select(*blocks.columns, reasons.alias("reasons"), (~tainted & (F.size(reasons) == 0)).alias("ok"))


#: Ids of an audit log that are looked at together; a stretch's first row is linked to the last row of the stretch before.
STRETCH = 1 << 16


def first_bad(blocks: DataFrame, own_hash: Column, order: str = "id") -> DataFrame:
    """Hash and link checks of an audit log with numeric ids; the first bad id, null if none.

    Rows are linked within stretches of ids; only the stretches' last hashes are ordered as a whole.
    """
    rows = blocks.withColumn("__own", own_hash).withColumn("__stretch", F.floor(F.col(order) / STRETCH))
    ends = rows.groupBy("__stretch").agg(F.max_by("hash", order).alias("__last"))
    before = ends.select("__stretch", F.lag("__last").over(Window.partitionBy(F.lit(1)).orderBy("__stretch")).alias("__before"))
    own = F.lag("hash").over(Window.partitionBy("__stretch").orderBy(order))
    linked = rows.withColumn("__link", own).join(before, "__stretch")
    bad = (F.col("hash") != F.col("__own")) | (F.col("prev_hash") != F.coalesce("__link", "__before", F.lit(GENESIS)))
    return linked.filter(bad).agg(F.min(order).alias("first_bad"))


#: Halvings of one round of `merkle_root`.
HALVINGS = 10


def _levels(hashes: Sequence[bytes]) -> list[list[bytes]]:
    """All levels of the tree over the hashes (promote), from the hashes up to its one node."""
    levels = [list(hashes)]
    while len(level := levels[-1]) > 1:
        levels.append([_parent(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    return levels


def _subtree(hashes: Sequence[bytes], variant: str, alone: bool, halvings: int) -> bytes:
    """The node that so many levels make of the hashes; an only block of a tree ends at its root."""
    if variant == "promote":
        return _levels(hashes)[-1][0]
    level = list(hashes)
    for _ in range(halvings):
        if len(level) == 1 and alone:
            break
        pairs = [(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        level = [hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in pairs]
    return level[0]


@lru_cache(64)
def _siblings(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n nodes of a block, where on each level (all levels one after another) their siblings are, and which have one."""
    where, has, width, before = [], [], n, 0
    while width > 1:
        other = (np.arange(n) >> len(where)) ^ 1
        where.append(other + before)
        has.append(other < width)
        before, width = before + width, (width + 1) // 2
    return np.array(where, np.int64).reshape(-1, n).T, np.array(has, np.bool_).reshape(-1, n).T


def _numbered(leaves: DataFrame, by: Sequence[str]) -> tuple[DataFrame, int]:
    """by, place (from 0, in order), leaves, hash of each leaf, and the rounds that the largest group takes."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    most = leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    level = leaves.select(*by, "hash", (F.row_number().over(whole.orderBy("place")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(whole).alias("leaves"))
    return level, max(1, -(-(most - 1).bit_length() // HALVINGS))


def _leaf(variant: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex("hash")), 256)) if variant == "promote" else F.unhex("hash")


def _whole(batches: Iterator[pa.RecordBatch], begins: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The sorted rows, cut where blocks begin, and the rows that begin one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(begins(batch.column("place").to_numpy()))
        if len(starts) and rest:
            yield _joined([*rest, batch.slice(0, starts[-1])], begins) if starts[-1] else _joined(rest, begins)
        elif len(starts) and starts[-1]:
            yield _joined([batch.slice(0, starts[-1])], begins)
        rest = [batch.slice(starts[-1])] if len(starts) else [*rest, batch]
    if rest:
        yield _joined(rest, begins)


def _joined(parts: list[pa.RecordBatch], begins: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.RecordBatch, np.ndarray]:
    rows = pa.concat_batches(parts)
    return rows, np.flatnonzero(begins(rows.column("place").to_numpy()))


def _blocks(level: DataFrame, by: Sequence[str], variant: str, k: int, deal: bool = True) -> DataFrame:
    """by, leaves, place, h: the nodes that round k makes of a level's neighbouring nodes, 2**HALVINGS at most; a task holds a few
    blocks of its sorted rows at once. Blocks are dealt to the tasks, unless each group is one and stays where it was numbered."""
    halvings = HALVINGS
    size = 1 << halvings

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole(batches, lambda place: place % size == 0):
            nodes, ends = rows.column("h").to_pylist(), [*starts[1:].tolist(), len(rows)]
            alone = rows.column("leaves").to_numpy()[starts] <= 1 << (halvings * (k + 1))
            made = [_subtree(nodes[a:b], variant, bool(only), halvings) for a, b, only in zip(starts.tolist(), ends, alone, strict=True)]
            first = rows.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(first.column(c) for c in (*by, "leaves")), pa.array(first.column("place").to_numpy() >> halvings), pa.array(made, pa.binary())], [*by, "leaves", "place", "h"])

    rows = level.select(*by, "leaves", "place", "h")
    dealt = rows.repartition(*by, F.shiftright("place", HALVINGS)) if deal else rows
    return dealt.sortWithinPartitions(*by, "place").mapInArrow(fold, rows.schema)


def merkle_root(leaves: DataFrame, by: Sequence[str], variant: str = "promote") -> DataFrame:
    """by, root, leaves: the Merkle root of each group's leaf hashes (columns place, hash).

    promote: leaf H(00 || h), node H(01 || l || r), an odd last node moves up; duplicate: node H(hex l || hex r), an odd
    last node is paired with itself. Blocks of 2**HALVINGS neighbouring nodes become one node a round, wherever they are,
    so that one group's tree is built by many tasks; rounds go on until the largest group is one node.
    """
    level, rounds = _numbered(leaves, by)
    level = level.withColumn("h", _leaf(variant))
    for k in range(rounds):
        level = _blocks(level, by, variant, k, rounds > 1)
    return level.select(*by, F.lower(F.hex("h")).alias("root"), "leaves")


def _proved(level: DataFrame, above: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """The level's columns but h, with proof (hashes as hex, from the node up) and root of each node (by, place, h).

    above: the same of the level that HALVINGS levels make of this one, a row for each block; none at the top. Such a row
    comes before its block's rows, so that a path is moved once for all nodes below it.
    """
    size, kept = 1 << HALVINGS, [c for c in level.columns if c != "h"]
    rows = level.withColumns({"__block": F.shiftright("place", HALVINGS), "proof": F.lit(None).cast("array<string>"), "root": F.lit(None).cast("string")})
    if above is not None:
        heads = above.select(*by, F.col("place").alias("__block"), F.lit(-1).cast("long").alias("place"), "proof", "root")
        rows = rows.unionByName(heads, allowMissingColumns=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole(batches, (lambda place: place % size == 0) if above_none else (lambda place: place < 0)):
            nodes, words, where, counts, roots, base = rows.column("h"), [], [], [], [], 0
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                first = a if above_none else a + 1
                levels = _levels(nodes.slice(first, b - first).to_pylist())
                path = [] if above_none else rows.column("proof")[a].as_py()
                siblings, has = _siblings(b - first)
                up = np.arange(len(path)) + sum(map(len, levels))
                at = np.concatenate((siblings, np.broadcast_to(up, (b - first, len(path)))), axis=1) + base
                has = np.concatenate((has, np.ones((b - first, len(path)), np.bool_)), axis=1)
                where.append(at[has])
                counts.append(has.sum(axis=1))
                words += [h.hex() for level in levels for h in level] + path
                roots += [levels[-1][0].hex() if above_none else rows.column("root")[a].as_py()] * (b - first)
                base = len(words)
            own = rows if above_none else rows.filter(pc.greater_equal(rows.column("place"), 0))
            ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
            proofs = pa.ListArray.from_arrays(pa.array(ends), pa.array(words, pa.string()).take(pa.array(np.concatenate(where))))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), proofs, pa.array(roots, pa.string())], [*kept, "proof", "root"])

    above_none = above is None
    out = rows.select(*kept, "proof", "root").schema
    return rows.repartition(*by, "__block").sortWithinPartitions(*by, "__block", "place").mapInArrow(fold, out)


def inclusion_proofs(leaves: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, index, hash, leaves, proof, root: for every leaf (columns place, hash) of every group, the sibling hashes from the
    leaf up in its group's tree (`promote`), all at once.

    Nodes of blocks of 2**HALVINGS nodes are made round by round up to the roots; then, from the top down, each node's path
    is its siblings within its block and the path of the block's own node. Rows stream through sorted by block, and proofs
    are made in the last step only.
    """
    level, rounds = _numbered(leaves, by)
    levels = [(settled(level) if rounds > 1 else level).withColumn("h", _leaf("promote"))]
    for k in range(rounds - 1):
        levels.append(settled(_blocks(levels[-1], by, "promote", k)))
    proofs = None
    for level in reversed(levels):
        proofs = _proved(level, proofs, by)
    return proofs.select(*by, F.col("place").alias("index"), "hash", "leaves", "proof", "root")


#: Nodes that a check of proofs remembers: neighbouring leaves share most of what is above them.
REMEMBERED = 4096


def proven(proofs: DataFrame) -> Column:
    """Whether each row's proof (see `inclusion_proofs`) leads from its hash to its root."""

    def check(hashes: pa.Array, proof: pa.Array, index: pa.Array, leaves: pa.Array, root: pa.Array) -> pa.Array:
        parent, words = lru_cache(REMEMBERED)(_parent), proof.flatten()
        whole = pc.all(pc.equal(pc.binary_length(words), 64)).as_py() is not False and not proof.null_count and not words.null_count
        if not whole:  # some are no hashes
            return pa.array([verify_inclusion(*row) for row in zip(*(x.to_pylist() for x in (hashes, proof, index, leaves, root)), strict=True)], pa.bool_())
        path, ends = bytes.fromhex(_text(words)), np.concatenate(([0], np.cumsum(pc.list_value_length(proof)))) * 32
        rows = zip(*(x.to_pylist() for x in (hashes, index, leaves, root)), ends.tolist(), ends[1:].tolist(), strict=False)
        return pa.array([_leads(bytes.fromhex(h), path[a:b], at, count, r, parent) for h, at, count, r, a, b in rows], pa.bool_())

    return F.arrow_udf(check, "boolean")(*[proofs[c] for c in ("hash", "proof", "index", "leaves", "root")])


def _text(words: pa.Array) -> str:
    """All strings of an array as one."""
    if not len(words):
        return ""
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][int(start[0]) : int(start[-1])].to_pybytes().decode()


def _leads(leaf: bytes, path: bytes, index: int, count: int, root: str, parent: Callable[[bytes, bytes], bytes]) -> bool:
    """`verify_inclusion` of a path whose hashes are one after another."""
    if not 0 <= index < count:
        return False
    node, at, width, done = hashlib.sha256(b"\x00" + leaf).digest(), index, count, 0
    while width > 1:
        if at ^ 1 < width:
            other = path[done : done + 32]
            if not other:
                return False
            node, done = parent(other, node) if at & 1 else parent(node, other), done + 32
        at, width = at >> 1, (width + 1) >> 1
    return done == len(path) and node.hex() == root


def _parent(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def inclusion_proof(hashes: Sequence[str], index: int) -> list[str]:
    """Sibling hashes from the leaf up; levels where the node is promoted have none."""
    level = [hashlib.sha256(b"\x00" + bytes.fromhex(h)).digest() for h in hashes]
    proof, at = [], index
    while len(level) > 1:
        if at ^ 1 < len(level):
            proof.append(level[at ^ 1].hex())
        level = [_parent(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        at //= 2
    return proof


def verify_inclusion(leaf: str, proof: Sequence[str], index: int, count: int, root: str) -> bool:
    """Whether the leaf's proof leads to the root of `count` leaves; sides follow from the index."""
    if not 0 <= index < count:
        return False
    node, at, width, rest = hashlib.sha256(b"\x00" + bytes.fromhex(leaf)).digest(), index, count, list(proof)
    while width > 1:
        if at ^ 1 < width:
            if not rest:
                return False
            other = bytes.fromhex(rest.pop(0))
            node = _parent(other, node) if at & 1 else _parent(node, other)
        at, width = at // 2, (width + 1) // 2
    return not rest and node.hex() == root


def daily_roots(blocks: DataFrame, day: Column, variant: str = "promote") -> DataFrame:
    return merkle_root(blocks.select(day.alias("day"), F.col("n").alias("place"), F.col("block_hash").alias("hash")), ["day"], variant)


def compare_roots(local: DataFrame, mirror: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Three-way comparison by day: ok, or which copy is missing or differs."""
    j = local.select("day", F.col("root").alias("a")).join(mirror.select("day", F.col("root").alias("b")), "day", "full").join(recomputed.select("day", F.col("root").alias("c")), "day", "full")
    status = F.when(F.col("a").isNull(), "no local root").when(F.col("b").isNull(), "no mirror root").when(F.col("c").isNull(), "no blocks").when(F.col("a") != F.col("b"), "mirror differs").when(F.col("a") != F.col("c"), "blocks differ").otherwise("ok")
    return j.select("day", status.alias("status"))


def certificate(blocks: DataFrame, own_hash: Column, by: Sequence[str], day: Column, first: str | None = None, last: str | None = None) -> DataFrame:
    """What is certified of each chain's blocks of the days first to last (ISO, both included, None for open ends): how many
    there are, how many stand, the first that does not, its reasons, and the days' first and last. Chains are verified
    whole, so that damage before the first day tells."""
    checked = verify(blocks, own_hash, by).withColumn("__day", day.cast("string"))
    within = checked.filter((F.lit(True) if first is None else F.col("__day") >= first) & (F.lit(True) if last is None else F.col("__day") <= last))
    broken = F.when(~F.col("ok"), F.col("n"))
    return within.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("ok").alias("standing"), F.min(broken).alias("first_broken"), F.array_join(F.min_by("reasons", broken), ",").alias("reasons"), F.min("__day").alias("from_day"), F.max("__day").alias("to_day")
    )


#: Fields of a gap that its hash covers.
GAP_FIELDS = ("boot", "kind", "start", "end", "after_n", "reason")


def recovered(boots: DataFrame, markers: DataFrame, heads: DataFrame, pending: DataFrame, torn: DataFrame) -> DataFrame:
    """device, boot, kind, start, end, after_n, reason: the gap that each start of a device has to log.

    boots: device, boot, at. markers: device, state (running, stopped or unreadable), last_alive, stopped_at, as the run
    before left them. heads: device, last_n, last_sealed of its ledger. pending: device, clip, clips that were never sealed.
    torn: device, log (ledger or gaps), bytes of a last line without its end. A clean stop with nothing left over is a
    restart, from when it stopped; anything else a power loss, from the last sign of life. A device of which nothing is
    known starts for the first time and has no gap. A clock that went back makes a gap of no length.
    """
    left = torn.groupBy("device").agg(F.sum(F.when(F.col("log") == "ledger", F.col("bytes"))).alias("ledger"), F.sum(F.when(F.col("log") == "gaps", F.col("bytes"))).alias("gaps"))
    clips = pending.groupBy("device").agg(F.count(F.lit(1)).alias("clips"))
    j = boots.join(markers, "device", "left").join(heads, "device", "left").join(left, "device", "left").join(clips, "device", "left")
    notes = F.array_compact(F.array(
        F.when(F.col("ledger") > 0, F.concat(F.lit("ledger tail of "), F.col("ledger").cast("string"), F.lit(" bytes set aside"))),
        F.when(F.col("gaps") > 0, F.concat(F.lit("gap log tail of "), F.col("gaps").cast("string"), F.lit(" bytes set aside"))),
        F.when(F.col("clips") > 0, F.concat(F.col("clips").cast("string"), F.lit(" unsealed clips set aside"))),
    ))
    j = j.withColumn("__notes", notes)
    clean = F.coalesce(F.col("state") == "stopped", F.lit(False)) & (F.size("__notes") == 0)
    lead = F.when(F.col("state").isNull(), "no run marker").otherwise("no clean shutdown")
    start = F.when(clean, F.coalesce("stopped_at", "last_sealed", "at")).otherwise(F.coalesce(F.greatest("last_alive", "last_sealed"), "at"))
    reason = F.when(clean, "restart after a clean shutdown").otherwise(F.array_join(F.concat(F.array(lead), F.col("__notes")), "; "))
    known = F.col("state").isNotNull() | (F.coalesce("last_n", F.lit(0)) > 0) | (F.size("__notes") > 0)
    return j.filter(known).select("device", "boot", F.when(clean, "restart").otherwise("power loss").alias("kind"), F.least(start, "at").alias("start"), F.col("at").alias("end"), F.coalesce("last_n", F.lit(0)).cast("long").alias("after_n"), reason.alias("reason"))


def log_gaps(log: DataFrame, new: DataFrame) -> DataFrame:
    """The rows (device, GAP_FIELDS, n, prev_block_hash, block_hash) that the gap log lacks: those of boots it does not have
    yet, chained on to each device's last gap. So a recovery that is run again, wherever it was stopped, adds nothing twice."""
    fresh = new.join(log.select("device", "boot"), ["device", "boot"], "left_anti")
    heads = log.groupBy("device").agg(F.max("n").alias("head_n"), F.max_by("block_hash", "n").alias("head_hash"))
    return chained(fresh, ["device"], ["end", "boot"], GAP_FIELDS, "gap/1", heads)


def publish_roots(roots: DataFrame, path: str, most: int = 10_000) -> DataFrame:
    """day, root, status: each day's root (day, root) written once to its own file below `path`, a store or its mirror.

    sealed: written now. held: the file has the same root. conflict: it has another one, which stays. A file appears whole,
    by a rename that does not overwrite, so of two writers one finds the other's. A call takes `most` days at most.
    """
    spark = roots.sparkSession
    rows = roots.select(F.col("day").cast("string").alias("day"), "root").orderBy("day").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{most} days at most")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    context = files.FileContext.getFileContext(fs.getUri(), conf)
    none = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    none[0] = files.Options.Rename.NONE
    out = []
    for r in rows:
        place, draft = files.Path(folder, r["day"]), files.Path(folder, f".{r['day']}-{uuid.uuid4().hex}")
        if not fs.exists(place):
            stream = fs.create(draft, False)
            stream.write(bytearray(r["root"].encode()))
            stream.close()
            try:
                context.rename(draft, place, none)
                out.append((r["day"], r["root"], "sealed"))
                continue
            except Py4JJavaError as error:  # another writer was first
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise
                fs.delete(draft, False)
        held = spark.read.text(str(place.toString())).first()
        out.append((r["day"], r["root"], "held" if held is not None and held[0] == r["root"] else "conflict"))
    return spark.createDataFrame(out, "day string, root string, status string")


def seal_days(sealed: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots of days that are not sealed yet: a day is sealed once."""
    return roots.join(sealed.select("day"), "day", "left_anti")


def classify_gaps(marks: DataFrame, by: Sequence[str], allowed: float) -> DataFrame:
    """Silences longer than allowed between marks (t, state): a restart after a clean stop, else power loss."""
    order = Window.partitionBy(*by).orderBy("t")
    rows = marks.withColumn("start", F.lag("t").over(order)).withColumn("was", F.lag("state").over(order))
    return rows.filter(F.col("t") - F.col("start") > allowed).select(*by, "start", F.col("t").alias("end"), F.when(F.col("was") == "stopped", "restart").otherwise("power loss").alias("kind"))

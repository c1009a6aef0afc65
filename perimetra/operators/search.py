"""Exact vector search over keyframes, and complete Hamming joins of hashes by bands."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.functions import timeutil
from perimetra.sources.store import settled


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def checked(keyframes: DataFrame, dim: int) -> DataFrame:
    """Fails on a vector of another length."""
    return keyframes.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding has another length")).cast("array<float>")))


def add_keyframes(index: DataFrame, new: DataFrame) -> DataFrame:
    """Adds keyframes whose id is not there; adding again changes nothing."""
    fresh = new.dropDuplicates(["keyframe_id"]).join(index.select("keyframe_id"), "keyframe_id", "left_anti")
    return index.unionByName(fresh.select(index.columns))


def search(keyframes: DataFrame, query: Column, k: int = 6) -> DataFrame:
    """The k best clips for one query vector (an array literal), each with its best keyframe; ties to the smaller id."""
    scored = keyframes.withColumn("score", dot(F.col("embedding"), query))
    best = scored.groupBy("clip_id").agg(F.max_by(F.struct("keyframe_id", "score"), F.struct("score", -F.col("keyframe_id"))).alias("b"))
    return best.select("clip_id", "b.keyframe_id", "b.score").orderBy(F.desc("score"), "keyframe_id").limit(k)


def percent(score: Column, scale: float, bias: float) -> Column:
    """Sigmoid of a scaled cosine, as a whole percentage."""
    return F.bround(100.0 / (1.0 + F.exp(-(score * scale + bias)))).cast("int")


def search_batch(keyframes: DataFrame, queries: DataFrame, k: int = 6, block: int = 1000) -> DataFrame:
    """The k best clips of each query (query_id, vector): query_id, rank, clip_id, keyframe_id, score.

    Queries are taken in blocks of about `block`, which a stored table holds; every block meets all keyframes, batch by
    batch. A batch of keyframes keeps the k best clips of each query by their best keyframe in it, which no clip of the
    overall best can miss.
    """
    blocks = max(1, -(-queries.count() // block))
    numbered = settled(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for frame, c in ((queries, "query_id"), (keyframes, "clip_id"), (keyframes, "keyframe_id")))
    met = None
    for number in range(blocks):
        asked = numbered.filter(F.col("__block") == number).toPandas()  # one block
        names, matrix = asked["query_id"].to_numpy(), np.array(asked["vector"].tolist(), float).reshape(len(asked), -1)

        def best(batches: Iterator[pd.DataFrame], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                pdf = pdf.sort_values("keyframe_id")
                ids, clips = pdf["keyframe_id"].to_numpy(), pdf["clip_id"].to_numpy()
                for name, scores in zip(names, matrix @ np.array(pdf["embedding"].tolist(), float).T, strict=True):
                    order = np.argsort(-scores, kind="stable")
                    firsts = order[np.sort(np.unique(clips[order], return_index=True)[1])[:k]]
                    yield pd.DataFrame({"query_id": name, "clip_id": clips[firsts], "keyframe_id": ids[firsts], "score": scores[firsts]})

        made = keyframes.select("clip_id", "keyframe_id", "embedding").mapInPandas(best, f"{kinds}, score double")
        own = made.groupBy("query_id", "clip_id").agg(F.max_by(F.struct("keyframe_id", "score"), F.struct("score", -F.col("keyframe_id"))).alias("b"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("b.score"), "b.keyframe_id"))
        kept = own.select("query_id", rank.alias("rank"), "clip_id", "b.keyframe_id", "b.score").filter(F.col("rank") <= k)
        kept = kept if blocks == 1 else settled(kept)
        met = kept if met is None else met.unionByName(kept)
    return met


def response(best: DataFrame, cameras: DataFrame, clips: DataFrame) -> DataFrame:
    """What a search answers: position (from 0), clip_id, keyframe_id, percent, the camera's name (its id where it is not known), at and chips, best first.

    best: clip_id, keyframe_id, score; clips: clip_id, camera_id, at, chips; cameras: id, name.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "keyframe_id")) - 1  # the few best only
    rows = best.withColumn("position", place).join(clips, "clip_id", "left").join(cameras.select(F.col("id").alias("camera_id"), "name"), "camera_id", "left")
    return rows.select("position", "clip_id", "keyframe_id", percent(F.col("score"), 10.0, -2.0).alias("percent"), F.coalesce("name", F.col("camera_id").cast("string")).alias("camera"), "at", "chips")


def window_scanned(rows: DataFrame, at: str) -> DataFrame:
    """Span of the index in days, or in weeks from 14 days on; timestamps that do not parse are left out."""
    ts = F.try_to_timestamp(F.col(at))
    days = F.datediff(F.max(ts), F.min(ts)) + 1
    span = rows.agg(days.alias("days"))
    return span.select("days", F.when(F.col("days") >= 14, F.concat((F.col("days") / 7).cast("int").cast("string"), F.lit(" weeks"))).otherwise(F.concat(F.col("days").cast("string"), F.lit(" days"))).alias("label"))


def chips(class_name: Column, ir: Column, rules: Column, plate: Column) -> Column:
    """Labels of a keyframe: class, IR, fired rules, plate; what is unknown is left out."""
    return F.array_compact(F.concat(F.array(class_name, F.when(ir, "IR")), F.coalesce(rules, F.array().cast("array<string>")), F.array(plate)))


def even_positions(frames: Column, k: int) -> Column:
    """Positions of k keyframes spread evenly over a clip's frames."""
    n = F.least(F.lit(k), frames)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(n > 1, F.floor(i * (frames - 1) / (n - 1))).otherwise(0).cast("int")))


def clip_label(ts: Column) -> Column:
    return timeutil.clip_label(ts)


# --- near-duplicates of 64-bit hashes

#: Words of a shingle of `simhash`, and words that are hashed and summed at once.
SHINGLE_WORDS, WORDS_AT_ONCE = 3, 65_536
#: A band value of more hashes than this is split by bands of the other bits; a bucket that is still larger is compared
#: in cells of two blocks of BLOCK_HASHES.
HOT_BAND, BLOCK_HASHES = 1000, 500
#: Hashes to a band value at which one more band is kept apart, so that band values are longer.
CROWDED = 256


def majorities(items: Iterable[Iterable[str]]) -> np.ndarray:
    """For each list of strings, the bits in which more than half of the first eight bytes of their SHA-256 are set, as an
    unsigned number. Lists are made and summed a few at a time, a long one part by part; a string is hashed once for those
    that are summed together. An empty list gives 0."""
    out: list[np.ndarray] = []
    number: dict[str, int] = {}
    at: list[int] = []  # numbers of the strings that are not summed yet
    sizes, ones = [0], np.zeros((1, 64), np.int64)  # of the lists begun; the last one goes on
    own = [0]  # strings of each of them in `at`

    def summed() -> np.ndarray:
        digests = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[:8] for w in number), np.uint8).reshape(-1, 8)
        new = np.zeros((len(own), 64), np.int64)
        new[:1] = ones
        some = np.flatnonzero(own)
        if len(some):
            first = np.cumsum([0, *own])[some]
            new[some] += np.add.reduceat(np.unpackbits(digests[np.array(at)], axis=1), first, axis=0, dtype=np.int64)
        return new

    for item in items:
        for w in item:
            at.append(number.setdefault(w, len(number)))
            own[-1] += 1
            sizes[-1] += 1
            if len(at) >= WORDS_AT_ONCE:
                new = summed()
                out.append(np.packbits(2 * new[:-1] > np.array(sizes[:-1], np.int64)[:, None], axis=1))
                ones, sizes, own = new[-1:], sizes[-1:], [0]
                number.clear()
                at.clear()
        own.append(0)
        sizes.append(0)
    out.append(np.packbits(2 * summed()[:-1] > np.array(sizes[:-1], np.int64)[:, None], axis=1))
    return np.concatenate(out).reshape(-1, 8).view(">u8").ravel().astype(np.uint64)


def _shingled(text: str | None) -> Iterator[str]:
    words = re.findall(r"\w+", (text or "").lower())
    return (" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))) if words else iter([text or ""])


def simhashes(text: Column) -> Column:
    """64-bit simhash (signed) over all word shingles of the whole text, each counted as often as it comes: the majority of each bit of their SHA-256.

    A text with fewer words than a shingle is one shingle; one without words is hashed as it is, null as the empty text.
    """
    return F.pandas_udf(lambda t: pd.Series(majorities(_shingled(x) for x in t).view(np.int64)), "long")(text)


def word_simhash(text: Column) -> Column:
    """60-bit simhash over a text's distinct words, cut at blanks: the majority of each bit of their SHA-256; 0 without words."""
    return F.pandas_udf(lambda t: pd.Series((majorities({w for w in (x or "").lower().split(" ") if w} for x in t) >> np.uint64(4)).view(np.int64)), "long")(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(bits: Sequence[int], parts: int) -> list[int]:
    """Masks of `parts` runs of the bits, of about equal lengths."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[low:high]) for low, high in itertools.pairwise(cuts)]


def band_masks(most: int, kept: int) -> list[int]:
    """Masks of which two 64-bit values that differ in `most` bits at most agree under one: of `most` + `kept` bands, `kept`
    are always the same."""
    bands = _parts(range(64), most + kept)
    return [sum(chosen) for chosen in itertools.combinations(bands, kept)]


def cells(rows: DataFrame, by: Sequence[str], value: str, most: int = BLOCK_HASHES) -> DataFrame:
    """The rows with own, low, high: a group of up to `most` rows is one cell (0, 0), a larger one is dealt into blocks and
    each row stands in the cells of its block with every block, so that each two rows meet in one cell of bounded size."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    blocks = F.ceil(F.col("__n") / most).cast("int")
    dealt = rows.join(sizes.select(*by, blocks.alias("__blocks")), list(by)).withColumn("own", F.pmod(F.xxhash64(value), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumns({"low": F.least("own", "__other"), "high": F.greatest("own", "__other")}).drop("__blocks", "__other")


def near_hashes(rows: DataFrame, most: int = 4) -> DataFrame:
    """All pairs of hashes (64 bits, column `hash`) that differ in at most `most` bits: ha <= hb, distance; each hash with itself at 0.

    Of most + 1 bands two such hashes share one whole, so equal bands meet; where band values are crowded, one more band is
    kept apart and two must agree, and so on. Band values of one hash go at once. A hot band value is split by the bands of
    the bits outside it, of which one must agree too, and what is still large is compared block against block. A pair
    counts under the first mask that it agrees under, so it comes once.
    """
    hashes = rows.select("hash").filter("hash is not null").distinct()
    count = hashes.count()
    kept = next((k for k in range(1, 5) if count / 2 ** (64 * k / (most + k)) <= CROWDED), 5)
    masks = band_masks(most, kept)
    inner = [_parts([b for b in range(64) if not m >> b & 1], most + 1) for m in masks]
    mask = F.array(*[F.lit(_signed(m)) for m in masks])
    inside = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in inner])
    keyed = hashes.select("hash", F.posexplode(mask).alias("k", "__mask")).select("hash", "k", F.col("hash").bitwiseAND(F.col("__mask")).alias("bits"))
    crowd = keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = settled(keyed.join(crowd, ["k", "bits"]))
    usual = met.filter(F.col("n") <= HOT_BAND).select("hash", "k", "bits", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("inner"))
    hot = met.filter(F.col("n") > HOT_BAND).select("hash", "k", "bits", F.posexplode(inside[F.col("k")]).alias("j", "__mask")).withColumn("inner", F.col("hash").bitwiseAND(F.col("__mask")))
    placed = settled(cells(usual.unionByName(hot.drop("__mask")), ["k", "bits", "j", "inner"], "hash"))
    cell = ["k", "bits", "j", "inner", "low", "high"]
    a, b = placed.select(*cell, F.col("hash").alias("ha"), F.col("own").alias("oa")), placed.select(*cell, F.col("hash").alias("hb"), F.col("own").alias("ob"))
    differing = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(_signed(m))) == 0, i) for i, m in enumerate(masks)])
    first_inner = F.array_position(F.transform(inside[F.col("k")], lambda m: differing.bitwiseAND(m) == 0), True) - 1
    once = (first == F.col("k")) & ((F.col("j") < 0) | (first_inner == F.col("j")))
    # Two rows of one block meet in each of its cells; they count in the block's own.
    place = ((F.col("oa") == F.col("low")) & (F.col("ob") == F.col("high"))) | ((F.col("oa") == F.col("high")) & (F.col("ob") == F.col("low")))
    pairs = a.join(b, cell).filter((F.col("ha") < F.col("hb")) & (F.bit_count(differing) <= most) & place & once)
    found = pairs.select("ha", "hb", F.bit_count(differing).cast("int").alias("distance"))
    return found.unionByName(hashes.select(F.col("hash").alias("ha"), F.col("hash").alias("hb"), F.lit(0).alias("distance")))


def dedupe(rows: DataFrame, drop_at: int = 4, report_at: int = 2) -> DataFrame:
    """Each row (seq, sequence, modality, hash) with `dropped`: an earlier row of another sequence is within drop_at bits; and `within`: whether one of its own sequence and modality is within report_at.

    Per hash and sequence only the earliest rows matter, so a hot hash does not multiply.
    """
    near = settled(near_hashes(rows, drop_at))
    both = near.select("ha", "hb", "distance").union(near.filter("ha <> hb").select("hb", "ha", "distance"))
    firsts = rows.groupBy("hash", "sequence").agg(F.min("seq").alias("first"))
    two = F.row_number().over(Window.partitionBy("hash").orderBy("first"))
    earliest = firsts.withColumn("n", two).filter("n <= 2")  # the earliest, and the earliest of another sequence
    around = both.join(earliest.select(F.col("hash").alias("hb"), "sequence", "first"), "hb").groupBy(F.col("ha").alias("hash")).agg(F.collect_set(F.struct("first", "sequence")).alias("others"))
    own = both.filter(F.col("distance") <= report_at).join(rows.groupBy(F.col("hash").alias("hb"), "sequence", "modality").agg(F.min("seq").alias("first")), "hb")
    own = own.groupBy(F.col("ha").alias("hash"), "sequence", "modality").agg(F.min("first").alias("own_first"))
    joined = rows.join(around, "hash", "left").join(own, ["hash", "sequence", "modality"], "left")
    dropped = F.exists("others", lambda o: (o["first"] < F.col("seq")) & (o["sequence"] != F.col("sequence")))
    return joined.select(*rows.columns, F.coalesce(dropped, F.lit(False)).alias("dropped"), F.coalesce(F.col("own_first") < F.col("seq"), F.lit(False)).alias("within"))

"""Queries of dataset preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perimetra.functions import geometry as g
from perimetra.operators import datasets, gates, windows
from perimetra.plans.bind import settled, table
from perimetra.plans.registry import query
from perimetra.sources.store import dealt, tasks_for

#: Boxes in a frame of 200 x 200 from order lines.
BOXES_SQL = "bx AS (SELECT l_orderkey AS image, l_linenumber AS box, l_quantity * 3.0 AS x1, (l_partkey % 150)::DOUBLE AS y1, l_quantity * 3.0 + 10.0 + l_discount * 200.0 AS x2, (l_partkey % 150) + 12.0 + l_tax * 300.0 AS y2, l_returnflag AS class_name, l_suppkey FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str, *more: F.Column) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_quantity") * 3.0, (F.col("l_partkey") % 150).cast("double")
    return l.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box"), x.alias("x1"), y.alias("y1"), (x + 10.0 + F.col("l_discount") * 200.0).alias("x2"), (y + 12.0 + F.col("l_tax") * 300.0).alias("y2"), F.col("l_returnflag").alias("class_name"), *more)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", (F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1)).alias("nibble"))


@query("WITH d AS (SELECT source AS sequence_key, CASE WHEN doc_id % 97 = 0 THEN 'val' WHEN substr(sha256(source), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split FROM documents), g AS (SELECT sequence_key, list_sort(list(DISTINCT split)) AS splits FROM d GROUP BY 1) SELECT sequence_key, array_to_string(splits, ',') AS splits FROM g WHERE len(splits) > 1")
def sequence_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that leak over splits."""
    d = _documents(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 97 == 0, "val").when(F.substring(F.sha2("source", 256), 1, 1) < "8", "train").otherwise("test"))
    return datasets.leaks(d.withColumnRenamed("source", "sequence_key")).select("sequence_key", F.array_join("splits", ",").alias("splits"))


@query("""WITH s AS (SELECT source AS sequence_key, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sha256('carve:' || sequence_key), sequence_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM s)
SELECT sequence_key, n, before < 0.2 * total AS carved FROM o""")
def carve_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _documents(spark, sf_dir).groupBy(F.col("source").alias("sequence_key")).agg(F.count(F.lit(1)).alias("n"))
    return datasets.carve(s, 0.2, "carve")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, source FROM r WHERE k % 5 = 0")
def decimate_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.decimate(_documents(spark, sf_dir).select("doc_id", "source"), 5, ["source"], ["doc_id"])


@query("""WITH r AS (SELECT doc_id, lang = 'en' AS hit, row_number() OVER (PARTITION BY lang = 'en' ORDER BY sha256('balance:' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) FILTER (lang <> 'en') OVER () AS rest FROM documents)
SELECT doc_id FROM r WHERE NOT hit OR k <= floor(0.4::DOUBLE * rest / 0.6::DOUBLE)""")
def balance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.balance(_documents(spark, sf_dir), F.col("lang") == "en", 0.4, "balance", "doc_id").select("doc_id")


@query("""WITH w AS (SELECT * FROM (VALUES ('en', 40), ('de', 500000), ('fr', 30)) t(lang, want)), r AS (SELECT d.doc_id, d.lang, want, sha256('quota:' || CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('quota:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents d JOIN w USING (lang)),
short AS (SELECT sum(greatest(want - coalesce(have, 0), 0)) AS n FROM w LEFT JOIN (SELECT lang, count(*) AS have FROM documents GROUP BY 1) USING (lang)), extra AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS k2 FROM r WHERE k > want)
SELECT doc_id, lang, 1 AS round FROM r WHERE k <= want UNION ALL SELECT doc_id, lang, 2 FROM extra, short WHERE k2 <= n""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by language; what one language lacks the others fill."""
    return datasets.quota(_documents(spark, sf_dir).select("doc_id", "lang"), "lang", {"en": 40, "de": 500000, "fr": 30}, "quota", "doc_id")


@query("""WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('rr:' || CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM t) SELECT doc_id, lang, source FROM p WHERE place <= 30""")
def round_robin_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.round_robin(_documents(spark, sf_dir).select("doc_id", "lang", "source"), ["lang"], "source", "rr", "doc_id", 30)


@query("""SELECT doc_id, CASE WHEN n_chars > 2000 THEN NULL WHEN lang = 'es' THEN NULL WHEN NOT n_chars > 100 THEN NULL WHEN lang = 'fr' THEN 'animal' WHEN source = 'src1' THEN 'ir_hotspot' WHEN lang = 'de' THEN 'night_glare' ELSE 'empty_road' END AS kind FROM documents""")
def negative_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    kind = datasets.negative_kind(F.when(F.col("n_chars") > 2000, 1).otherwise(0), F.col("lang"), F.col("n_chars") > 100, F.col("lang") == "fr", F.col("source") == "src1", F.when(F.col("lang") == "de", "night").otherwise("day"), ("es",))
    return d.select("doc_id", kind.alias("kind"))


_TILES = [(0, 0, 120, 120), (80, 0, 200, 120), (0, 80, 120, 200), (80, 80, 200, 200)]
_TILES_SQL = "tl AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 120.0, 120.0), (1, 80.0, 0.0, 200.0, 120.0), (2, 0.0, 80.0, 120.0, 200.0), (3, 80.0, 80.0, 200.0, 200.0)) t(tile, wx1, wy1, wx2, wy2))"


@query(f"""WITH {BOXES_SQL}, {_TILES_SQL}, m AS (SELECT *, greatest(least(x2, wx2) - greatest(x1, wx1), 0) * greatest(least(y2, wy2) - greatest(y1, wy1), 0) / ((x2 - x1) * (y2 - y1)) AS kept FROM bx, tl)
SELECT image, box, tile, round(greatest(x1, wx1) - wx1, 6) AS x1, round(least(x2, wx2) - wx1, 6) AS x2, round(kept, 6) AS kept FROM m WHERE kept >= 0.5""")
def tile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut to overlapping tiles that keep half of them at least."""
    found = datasets.clip_to_tiles(boxes(spark, sf_dir), datasets.tiles(200, 200, 120, 1 / 3))
    return found.select("image", "box", "tile", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"), F.round("kept", 6).alias("kept"))


@query(f"WITH {BOXES_SQL}, {_TILES_SQL}, f AS (SELECT DISTINCT image FROM bx) SELECT f.image, tile FROM f, tl WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.image = f.image AND x1 < wx2 AND x2 > wx1 AND y1 < wy2 AND y2 > wy1)")
def empty_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that no box touches."""
    b = boxes(spark, sf_dir)
    return datasets.far_windows(b.select("image").distinct(), b, _TILES).select("image", "tile")


@query(f"""WITH {BOXES_SQL}, c AS (SELECT image, box, greatest(0, least(x1, 200)) AS a1, greatest(0, least(y1, 200)) AS b1, greatest(0, least(x2, 200)) AS a2, greatest(0, least(y2, 200)) AS b2 FROM bx)
SELECT image, box, round((a1 + a2) / 2 / 200, 6) AS cx, round((b1 + b2) / 2 / 200, 6) AS cy, round((a2 - a1) / 200, 6) AS w, round((b2 - b1) / 200, 6) AS h, ((a2 - a1) / 200 > 0.0005 AND (b2 - b1) / 200 > 0.0005 AND (a2 - a1) * (b2 - b1) >= 16) AS usable FROM c""")
def box_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    cx, cy, w, h, fine = g.to_normalised(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(200.0), F.lit(200.0))
    return b.select("image", "box", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(w, 6).alias("w"), F.round(h, 6).alias("h"), fine.alias("usable"))


_IOU = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(f"""WITH {BOXES_SQL}, n AS (SELECT a.image, a.box, max(CASE WHEN {_IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU}) > 0.3 THEN 1 ELSE 0 END) AS hit FROM bx a LEFT JOIN bx b ON a.image = b.image AND (a.box <> b.box OR a.l_suppkey <> b.l_suppkey) GROUP BY 1, 2)
SELECT count(*) AS boxes, sum(hit)::BIGINT AS occluded FROM n""")
def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that overlap another of their image by more than 0.3."""
    b = boxes(spark, sf_dir, F.col("l_suppkey"))
    tasks = tasks_for(b)
    own, other = dealt(b.drop("class_name"), tasks, "image"), dealt(b.select("image", *[F.col(c).alias(f"o{c}") for c in ("box", "l_suppkey", "x1", "y1", "x2", "y2")]), tasks, "image")
    over = g.iou(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"o{c}") for c in ("x1", "y1", "x2", "y2")))
    hit = own.join(other, "image").filter(((F.col("box") != F.col("obox")) | (F.col("l_suppkey") != F.col("ol_suppkey"))) & (over > 0.3)).select("image", "box").distinct()
    every = dealt(b.select("image", "box"), tasks, "image").distinct()
    return every.agg(F.count(F.lit(1)).alias("boxes")).join(hit.agg(F.count(F.lit(1)).alias("occluded")))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(size_bin, 'all') AS size_bin, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars < 200 THEN 'small' WHEN n_chars < 2000 THEN 'medium' ELSE 'large' END AS size_bin FROM documents) GROUP BY CUBE (lang, size_bin)")
def histogram_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language and size, with all totals."""
    d = _documents(spark, sf_dir).select("lang", F.when(F.col("n_chars") < 200, "small").when(F.col("n_chars") < 2000, "medium").otherwise("large").alias("size_bin"))
    return d.cube("lang", "size_bin").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("size_bin", F.lit("all")).alias("size_bin"), "n")


@query("SELECT source, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'no label' ELSE 'no document' END AS problem FROM documents d FULL JOIN (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN doc_id + 100000000 ELSE doc_id END AS doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels and labels without documents."""
    d = _documents(spark, sf_dir).select("doc_id").withColumn("d", F.lit(1))
    l = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") + 100000000).otherwise(F.col("doc_id")).alias("doc_id")).distinct().withColumn("l", F.lit(1))  # noqa: E741
    return d.join(l, "doc_id", "full").filter("d is null or l is null").select("doc_id", F.when(F.col("l").isNull(), "no label").otherwise("no document").alias("problem"))


@query("WITH v AS (SELECT source, lang, count(*) AS votes FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, list_position(['es', 'fr', 'de', 'en'], lang)) AS k FROM v) SELECT source, lang FROM r WHERE k = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.majority(_documents(spark, sf_dir), "source", "lang", ["es", "fr", "de", "en"])


@query("SELECT event_type, CASE event_type WHEN 'view' THEN 'person' WHEN 'click' THEN 'person' WHEN 'purchase' THEN 'car' WHEN 'error' THEN 'animal' ELSE 'unknown' END AS mapped, count(*) AS n FROM events GROUP BY ALL")
def class_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native classes mapped; unknown ones counted, never dropped."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("class_name"))
    known, unknown = datasets.remap(e, {"view": "person", "click": "person", "purchase": "car", "error": "animal"})
    both = known.unionByName(unknown.withColumn("mapped", F.lit("unknown")))
    return both.groupBy(F.col("class_name").alias("event_type"), "mapped").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT event_id AS seq, user_id AS k, event_type AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM m) SELECT k, v, seq FROM r WHERE n = 1""")
def keyed_merge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"))
    n = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq")))
    return e.withColumn("n", n).filter("n = 1").drop("n")


_GATES_SQL = """rec AS (SELECT 'i' || CAST(o_orderkey AS VARCHAR) AS image, CASE WHEN o_custkey % 20 < 14 THEN 'train' WHEN o_custkey % 20 < 17 THEN 'val' ELSE 'test' END AS split, o_custkey AS sequence, CASE WHEN o_orderkey % 9 < 5 THEN 'visible' ELSE 'lwir' END AS modality,
  o_orderkey % 10 = 0 AS negative, CASE WHEN o_orderkey % 3 = 0 THEN 0 END AS tile, CASE WHEN o_orderkey % 3 = 0 THEN 640 ELSE 1920 END AS width, CASE WHEN o_orderkey % 3 = 0 THEN 640 ELSE 1080 END AS height,
  ('0x' || substr(sha256(CAST(o_orderkey // 2 AS VARCHAR)), 1, 15))::BIGINT AS hash FROM orders),
box AS (SELECT 'i' || CAST(l_orderkey AS VARCHAR) AS image, CAST(l_linenumber % 5 AS INTEGER) AS class_id, l_quantity / 49.0::DOUBLE AS x, l_discount::DOUBLE AS y, l_tax::DOUBLE AS w, 0.1::DOUBLE AS h, l_quantity * 1.0::DOUBLE AS height_px FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_orderkey % 101 <> 1),
cp AS (SELECT split, hash, hash >> 48 AS b, count(*) AS n FROM rec GROUP BY 1, 2, 3), parts AS (SELECT split, count(*) AS n FROM rec WHERE tile IS NULL GROUP BY 1), cls AS (SELECT k AS class_id, (SELECT count(*) FROM box WHERE class_id = k) AS n FROM range(4) r(k)),
hard AS (SELECT image FROM rec WHERE tile IS NULL AND split = 'val' ORDER BY image LIMIT 280),
obs AS (SELECT 'G1' AS gate, (SELECT count(*) FROM cp a JOIN cp b ON a.b = b.b AND a.split < b.split AND bit_count(xor(a.hash, b.hash)) <= 4)::DOUBLE AS observed
UNION ALL SELECT 'G2', (SELECT 1 - count(*) / sum(n) FROM cp)::DOUBLE
UNION ALL SELECT 'G3', (SELECT count(*) FROM (SELECT sequence FROM rec GROUP BY 1 HAVING count(DISTINCT split) > 1))::DOUBLE
UNION ALL SELECT 'G4', (SELECT count(*) FROM box WHERE NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1))::DOUBLE
UNION ALL SELECT 'G5', (SELECT count(*) FROM box WHERE w <= 0 OR h <= 0)::DOUBLE UNION ALL SELECT 'G6', (SELECT count(*) FROM box WHERE class_id > 3)::DOUBLE
UNION ALL SELECT 'G7', ((SELECT count(*) FROM box b ANTI JOIN rec r USING (image)) + (SELECT count(*) FROM rec r ANTI JOIN box b USING (image) WHERE NOT negative))::DOUBLE
UNION ALL SELECT 'G8', (SELECT count(*) FROM (SELECT avg((modality = 'visible')::INTEGER) AS v FROM rec GROUP BY split) WHERE v < 0.4 OR v > 0.7)::DOUBLE
UNION ALL SELECT 'G9', (SELECT avg(negative::INTEGER) FROM rec WHERE split = 'train')::DOUBLE UNION ALL SELECT 'G10', (SELECT count(*) FROM orders WHERE o_orderkey % 9 >= 5 AND o_orderkey % 500 = 7)::DOUBLE
UNION ALL SELECT 'G11', (SELECT count(*) FROM cls WHERE n < 0.01 * (SELECT count(*) FROM box))::DOUBLE UNION ALL SELECT 'G12', (SELECT avg((height_px < 19)::INTEGER) FROM box)::DOUBLE
UNION ALL SELECT 'G13', (SELECT count(*) FROM rec WHERE tile IS NOT NULL AND NOT negative)::DOUBLE
UNION ALL SELECT 'G14', (SELECT max(abs(n / (SELECT sum(n) FROM parts) - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END)) FROM parts)::DOUBLE
UNION ALL SELECT 'G15', (SELECT count(*) FROM hard)::DOUBLE UNION ALL SELECT 'G16', 0.0::DOUBLE UNION ALL SELECT 'G17', NULL::DOUBLE)"""


@query(f"""WITH {_GATES_SQL} SELECT gate, round(observed, 6) AS observed, CASE WHEN gate = 'G17' THEN 'SKIP' WHEN CASE gate WHEN 'G2' THEN observed < 0.005 WHEN 'G9' THEN observed BETWEEN 0.08 AND 0.12 WHEN 'G12' THEN observed >= 0.05 WHEN 'G13' THEN observed >= 2000 WHEN 'G14' THEN observed <= 0.02
  WHEN 'G15' THEN observed = 280 WHEN 'G16' THEN observed = 1 ELSE observed = 0 END THEN 'PASS' ELSE 'FAIL' END AS result FROM obs""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates of a dataset built from orders (images of customers' sequences) and their lines (boxes)."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    k, image = F.col("o_orderkey"), lambda c: F.concat(F.lit("i"), F.col(c).cast("string")).alias("image")
    fold, tile = F.col("o_custkey") % 20, F.col("o_orderkey") % 3 == 0
    records = o.select(
        image("o_orderkey"), F.when(fold < 14, "train").when(fold < 17, "val").otherwise("test").alias("split"), F.col("o_custkey").alias("sequence"), F.when(k % 9 < 5, "visible").otherwise("lwir").alias("modality"),
        (k % 10 == 0).alias("negative"), F.when(tile, 0).alias("tile"), F.when(tile, 640).otherwise(1920).alias("width"), F.when(tile, 640).otherwise(1080).alias("height"),
        F.conv(F.substring(F.sha2(F.floor(k / 2).cast("string"), 256), 1, 15), 16, 10).cast("long").alias("hash"), (k % 500 != 7).alias("channels_equal"),
    )
    boxes = l.filter("l_orderkey % 10 <> 0 and l_orderkey % 101 <> 1").select(
        image("l_orderkey"), (F.col("l_linenumber") % 5).cast("int").alias("class_id"), (F.col("l_quantity") / 49.0).alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_tax").cast("double").alias("w"), F.lit(0.1).alias("h"), F.col("l_quantity").cast("double").alias("height_px")
    )
    hard = records.filter("tile is null and split = 'val'").orderBy("image").limit(280).select("image")
    found = gates.all_gates(records, boxes, hard, "another digest", skipped=[("G17", "plates", "out of scope")])
    return found.select("gate", F.round("observed", 6).alias("observed"), "result")


_PASSES_SQL = f"""{BOXES_SQL.replace("bx AS (SELECT", "bx AS (SELECT DISTINCT (l_partkey * 10000 + l_suppkey) * 10 + l_linenumber AS key,")}, win AS (SELECT * FROM (VALUES (1, 0.0, 0.0, 120.0, 120.0), (2, 80.0, 0.0, 200.0, 120.0), (3, 0.0, 80.0, 120.0, 200.0), (4, 80.0, 80.0, 200.0, 200.0)) v(w, wx1, wy1, wx2, wy2)),
det AS (SELECT image, key * 10 AS id, class_name AS cls, ((image * 31 + box * 17) % 1000) / 1000.0::DOUBLE AS score, x1, y1, x2, y2, false AS windowed, false AS cut FROM bx
  UNION ALL SELECT image, key * 10 + w, class_name, ((image * 13 + box * 29 + w * 7) % 1000) / 1000.0::DOUBLE, greatest(x1, wx1), greatest(y1, wy1), least(x2, wx2), least(y2, wy2), true,
    (wx1 > 0 AND greatest(x1, wx1) <= wx1 + 4) OR (wx2 < 200 AND least(x2, wx2) >= wx2 - 4) OR (wy1 > 0 AND greatest(y1, wy1) <= wy1 + 4) OR (wy2 < 200 AND least(y2, wy2) >= wy2 - 4) FROM bx, win WHERE least(x2, wx2) > greatest(x1, wx1) AND least(y2, wy2) > greatest(y1, wy1)),
fine AS (SELECT * FROM det WHERE score >= CASE WHEN windowed THEN 0.4 ELSE 0.25 END AND x2 - x1 >= 2 AND y2 - y1 >= 2),
alive AS (SELECT * FROM fine t WHERE NOT (cut AND EXISTS (SELECT 1 FROM fine o WHERE o.image = t.image AND o.cls = t.cls AND NOT o.cut AND greatest(least(t.x2, o.x2) - greatest(t.x1, o.x1), 0) * greatest(least(t.y2, o.y2) - greatest(t.y1, o.y1), 0) >= 0.5 * ((t.x2 - t.x1) * (t.y2 - t.y1))))),
r AS (SELECT *, row_number() OVER (PARTITION BY image, cls ORDER BY score DESC, id, x1, y1, x2, y2) AS rn FROM alive),
s AS (SELECT image, cls, rn, id, windowed, score, true AS stays, [struct_pack(a := x1, b := y1, c := x2, d := y2)] AS kept FROM r WHERE rn = 1
  UNION ALL SELECT image, cls, rn, id, windowed, score, stays, CASE WHEN stays THEN list_append(kept, struct_pack(a := x1, b := y1, c := x2, d := y2)) ELSE kept END FROM (
    SELECT r.*, s.kept, len(list_filter(s.kept, lambda k: greatest(least(r.x2, k.c) - greatest(r.x1, k.a), 0) * greatest(least(r.y2, k.d) - greatest(r.y1, k.b), 0)
      > 0.5 * greatest((r.x2 - r.x1) * (r.y2 - r.y1) + (k.c - k.a) * (k.d - k.b) - greatest(least(r.x2, k.c) - greatest(r.x1, k.a), 0) * greatest(least(r.y2, k.d) - greatest(r.y1, k.b), 0), 1e-12) + 1e-9)) = 0 AS stays
    FROM s JOIN r ON r.image = s.image AND r.cls = s.cls AND r.rn = s.rn + 1))"""


@query(f"WITH RECURSIVE {_PASSES_SQL} SELECT image, CAST(id AS BIGINT) AS id, cls, score, windowed FROM s WHERE stays QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, id) <= 300")
def window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections over a frame and over four overlapping windows of it, which cut some of them, as one set."""
    key = ((F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("key")
    b = boxes(spark, sf_dir, key).distinct()
    whole = b.select("image", (F.col("key") * 10).alias("id"), F.col("class_name").alias("cls"), (F.col("image") * 31 + F.col("box") * 17).alias("n"), "x1", "y1", "x2", "y2", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("window"))
    parts = [F.struct(F.lit(k + 1).alias("w"), F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), w, strict=True)]).alias("at")) for k, w in enumerate(windows.cover(200, 200, 120, 0.2))]
    seen = b.withColumn("p", F.explode(F.array(*parts))).select(
        "image", (F.col("key") * 10 + F.col("p.w")).alias("id"), F.col("class_name").alias("cls"), (F.col("image") * 13 + F.col("box") * 29 + F.col("p.w") * 7).alias("n"),
        F.greatest("x1", "p.at.x1").alias("x1"), F.greatest("y1", "p.at.y1").alias("y1"), F.least("x2", "p.at.x2").alias("x2"), F.least("y2", "p.at.y2").alias("y2"), F.col("p.at").alias("window"),
    ).filter("x2 > x1 and y2 > y1")
    detections = whole.unionByName(seen).withColumn("score", F.col("n") % 1000 / 1000.0)
    return windows.merged(detections, 200, 200, 0.25, 0.4).select("image", "id", "cls", "score", "windowed")


@query("""WITH d AS (SELECT 's' || CAST(doc_id % 4 AS VARCHAR) AS source, 's' || CAST(doc_id % 4 AS VARCHAR) || '/' || CAST((doc_id // 4) % 37 AS VARCHAR) AS sequence_key, CASE (doc_id // 4) % 37 % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS official, doc_id FROM documents),
q AS (SELECT source, sequence_key, count(*) AS n, list_sort(list(DISTINCT CASE WHEN doc_id % 400 = 2 THEN 'other' ELSE official END)) AS officials FROM d GROUP BY 1, 2),
a AS (SELECT *, source || ':' || sequence_key AS k, CASE source WHEN 's0' THEN officials = ['train'] WHEN 's1' THEN true ELSE false END AS pool, CASE source WHEN 's0' THEN 0.25::DOUBLE WHEN 's1' THEN 0.2::DOUBLE END AS share FROM q),
b AS (SELECT *, pool AND coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < share * sum(n) OVER (PARTITION BY source, pool) AS to_val FROM a WINDOW w AS (PARTITION BY source, pool ORDER BY sha256('policies-to_val:' || k), k)),
c AS (SELECT *, source = 's1' AND NOT to_val AS pool2 FROM b),
e AS (SELECT *, pool2 AND coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.3::DOUBLE / (1 - 0.2::DOUBLE) * sum(n) OVER (PARTITION BY source, pool2) AS to_test FROM c WINDOW w AS (PARTITION BY source, pool2 ORDER BY sha256('policies-to_test:' || k), k)),
f AS (SELECT *, CASE WHEN source = 's3' THEN 'no policy' WHEN source <> 's1' AND len(officials) <> 1 THEN 'spans official splits' WHEN source = 's2' AND officials[1] = 'test' THEN 'unrouted' END AS problem FROM e)
SELECT source, sequence_key, n, problem, CASE WHEN problem IS NOT NULL THEN NULL WHEN to_val THEN 'val' WHEN to_test THEN 'test' WHEN source = 's1' THEN 'train' ELSE officials[1] END AS split FROM f""")
def split_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources: official with a share carved for val, carved anew, official without a place for its test, and one
    without a policy; some sequences span official splits."""
    group = F.floor(F.col("doc_id") / 4) % 37
    source = F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))
    official = F.when(F.col("doc_id") % 400 == 2, "other").when(group % 3 == 0, "train").when(group % 3 == 1, "val").otherwise("test")
    rows = table(spark, sf_dir, "documents").select(source.alias("source"), F.concat_ws("/", source, group.cast("string")).alias("sequence_key"), official.alias("official"))
    same = {name: name for name in ("train", "val", "test")}
    policies = {"s0": datasets.SplitPolicy("official", same, ("train", 0.25)), "s1": datasets.SplitPolicy("resplit", val=0.2, test=0.3), "s2": datasets.SplitPolicy("official", {"train": "train", "val": "val"})}
    return datasets.split_by_policy(rows, policies, "policies")


_STRIP_SQL = f"""{BOXES_SQL}, fr AS (SELECT o_orderkey AS image, CASE WHEN o_orderkey % 3 = 0 THEN 'lwir' ELSE 'visible' END AS modality, 200 + 60 * (o_orderkey % 2) AS w FROM orders),
ox AS (SELECT w, unnest(list_distinct(list_append(range(0, w - 119, 96), w - 120))) AS ox FROM (SELECT DISTINCT w FROM fr)), oy AS (SELECT unnest([0, 40]) AS oy),
cand AS (SELECT fr.image, modality, ox, oy, count(*) AS n_boxes, bool_or(y2 - y1 <= 16) AS small FROM fr JOIN ox USING (w) JOIN oy ON true JOIN bx ON bx.image = fr.image
  WHERE greatest(least(x2, ox + 120) - greatest(x1, ox), 0) * greatest(least(y2, oy + 120) - greatest(y1, oy), 0) / ((x2 - x1) * (y2 - y1)) >= 0.3 AND least(x2, ox + 120) > greatest(x1, ox) AND least(y2, oy + 120) > greatest(y1, oy) GROUP BY 1, 2, 3, 4)"""


def _strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderkey") % 3 == 0, "lwir").otherwise("visible").alias("modality"), (200 + 60 * (F.col("o_orderkey") % 2)).cast("int").alias("width"), F.lit(200).alias("height"))


@query(f"""WITH {_STRIP_SQL}, n AS (SELECT count(*) FILTER (modality = 'lwir') AS ir, count(*) FILTER (modality <> 'lwir') AS vis FROM cand), t AS (SELECT least(vis, 24000 - least(ir, 8400)) AS v, ir FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY CASE WHEN small THEN 0 ELSE 1 END, sha256('tiles:' || image || ':' || oy || ':' || ox), image || ':' || oy || ':' || ox) AS k FROM cand)
SELECT image, modality, ox, oy, n_boxes, small FROM r, t WHERE k <= CASE modality WHEN 'lwir' THEN least(ir, 24000 - v) ELSE v END""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24,000 tiles over the far strip, a third of them and a little more infrared, small objects first."""
    found = datasets.tile_candidates(_strip(spark, sf_dir), boxes(spark, sf_dir), 120, 0.2, 0.0, 0.8, 0.3, 16.0)
    return datasets.tile_plan(settled(found), 24_000, 0.35)


@query(f"""WITH {_STRIP_SQL.split("cand AS")[0].rstrip().rstrip(",")}, free AS (SELECT fr.image, ox, oy FROM fr JOIN ox USING (w) JOIN oy ON true WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.image = fr.image AND x1 < ox + 120 AND x2 > ox AND y1 < oy + 120 AND y2 > oy)),
cd AS (SELECT image, CASE WHEN image % 7 = 0 THEN 'animal' ELSE 'empty_road' END AS category FROM fr WHERE image % 40 = 0), want AS (SELECT * FROM (VALUES ('animal', 240), ('empty_road', 360)) t(category, want)),
a AS (SELECT image, category, row_number() OVER (PARTITION BY category ORDER BY sha256('neg:' || image), image) AS k FROM cd), one AS (SELECT image, category FROM a JOIN want USING (category) WHERE k <= want),
b AS (SELECT image, category, row_number() OVER (ORDER BY sha256('neg-spare:' || image), image) AS k FROM cd WHERE image NOT IN (SELECT image FROM one)), two AS (SELECT image, category FROM b WHERE k <= 600 - (SELECT count(*) FROM one)),
p AS (SELECT image || ':' || oy || ':' || ox AS place, row_number() OVER (PARTITION BY image ORDER BY sha256('neg-frame:' || image || ':' || oy || ':' || ox), image || ':' || oy || ':' || ox) AS turn FROM free),
c AS (SELECT place, row_number() OVER (ORDER BY sha256('neg-tiles:' || place), place) AS k FROM p WHERE turn <= 1)
SELECT CAST(image AS VARCHAR) AS image, category, 'quota' AS origin FROM one UNION ALL SELECT CAST(image AS VARCHAR), category, 'redistributed' FROM two
UNION ALL SELECT place, NULL, 'tile' FROM c WHERE k <= 600 - (SELECT count(*) FROM one) - (SELECT count(*) FROM two)""")
def negative_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 negatives of two categories, one of which is short; empty tiles fill what frames lack."""
    frames = _strip(spark, sf_dir)
    places = datasets.strip_windows(frames, 120, 0.2, 0.0, 0.8)
    b = boxes(spark, sf_dir).select(F.col("image").alias("own"), "x1", "y1", "x2", "y2")
    touches = (F.col("image") == F.col("own")) & (F.col("x1") < F.col("ox") + 120) & (F.col("x2") > F.col("ox")) & (F.col("y1") < F.col("oy") + 120) & (F.col("y2") > F.col("oy"))
    empty = settled(places.join(b, touches, "left_anti").select("image", "ox", "oy"))
    candidates = frames.filter("image % 40 = 0").select("image", F.when(F.col("image") % 7 == 0, "animal").otherwise("empty_road").alias("category"))
    return datasets.filled_negatives(candidates, empty, 600, {"animal": 0.4, "empty_road": 0.6}, "neg")


@query(f"""WITH {BOXES_SQL}, f AS (SELECT *, 200.0 + 460 * (image % 3) AS w, 220.0 + 310 * (image % 2) AS h FROM bx), g AS (SELECT *, least(640 / h, 640 / w) AS s FROM f),
p AS (SELECT *, round_even((640 - round_even(w * s, 0)) / 2.0 - 0.1, 0) AS l, round_even((640 - round_even(h * s, 0)) / 2.0 - 0.1, 0) AS t, CASE WHEN w <= 640 THEN w ELSE 640 END AS ww, CASE WHEN w <= 640 THEN h ELSE greatest(8, round_even(h * 640 / w, 0)) END AS wh FROM g)
SELECT image, box, l_suppkey, round(x1 * s + l, 6) AS left_in, round(y2 * s + t, 6) AS bottom_in, round(least(greatest((x1 * s + l + 3 - l) / s, 0), w), 6) AS left_back, round(x2 / (w / ww), 6) AS right_working, round(y2 / (h / wh), 6) AS bottom_working FROM p""")
def letterboxed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in the detector's square, three pixels on and back, and at the size at which motion is measured."""
    b = boxes(spark, sf_dir, F.col("l_suppkey"))
    w, h = 200.0 + 460 * (F.col("image") % 3), 220.0 + 310 * (F.col("image") % 2)
    own = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    square, small = g.into_letterbox(own, w, h), g.at_working_scale(own, w, h)
    back = g.out_of_letterbox((square[0] + 3, *square[1:]), w, h)
    made = {"left_in": square[0], "bottom_in": square[3], "left_back": back[0], "right_working": small[2], "bottom_working": small[3]}
    return b.select("image", "box", "l_suppkey", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(f"WITH {BOXES_SQL} SELECT image, round(median((y2 - y1) / 200 * 200 * 640 / 260), 3) AS median_px, count(*) AS n FROM bx GROUP BY image")
def median_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median height of an image's boxes in the detector's square."""
    px = g.detector_px((F.col("y2") - F.col("y1")) / 200, F.lit(260), F.lit(200))
    return boxes(spark, sf_dir).groupBy("image").agg(F.round(F.percentile(px, 0.5), 3).alias("median_px"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT CASE WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) < 'b' THEN 'train' ELSE 'val' END AS split, lang, CASE WHEN n_chars < 200 THEN 'small' WHEN n_chars < 2000 THEN 'medium' ELSE 'large' END AS size_bin FROM documents)
SELECT coalesce(split, 'all') AS split, coalesce(lang, 'all') AS lang, coalesce(size_bin, 'all') AS size_bin, count(*) AS n FROM d GROUP BY CUBE (split, lang, size_bin)""")
def split_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by split, language and size, with all totals."""
    size = F.when(F.col("n_chars") < 200, "small").when(F.col("n_chars") < 2000, "medium").otherwise("large")
    d = _documents(spark, sf_dir).select(F.when(F.col("nibble") < "b", "train").otherwise("val").alias("split"), "lang", size.alias("size_bin"))
    return d.cube("split", "lang", "size_bin").agg(F.count(F.lit(1)).alias("n")).select(*[F.coalesce(c, F.lit("all")).alias(c) for c in ("split", "lang", "size_bin")], "n")

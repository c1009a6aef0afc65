"""Readers and writers with explicit schemas; rows that do not parse are reported, not lost."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

LABEL = "class_id int, cx double, cy double, w double, h double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file with `_corrupt_record` for lines that do not parse; a missing path is an empty table."""
    full = StructType.fromDDL(f"{schema}, _corrupt_record string")
    try:
        return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], full)
        raise


def merged(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Last write wins per key: rows of `new` over `old`, within each the larger seq; rows without a key are left out."""
    order = [F.desc("__new"), *([F.desc(seq)] if seq else [])]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True).filter(F.col(key).isNotNull())
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return both.withColumn("__n", n).filter("__n = 1").drop("__n", "__new")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (from 0), line, torn of uncompressed text files: torn marks a file's last line where it has no line feed.

    Files are read line by line, in as many tasks as they have blocks; a line's number is the lines of the blocks before it
    and its place in its own. A file whose lines and their line feeds come to more than its size has no feed at its end.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("__size"), F.col("_metadata.file_block_start").alias("__block"))
    rows = raw.withColumn("__at", F.monotonically_increasing_id())  # consecutive within a block
    blocks = rows.groupBy("path", "__block", "__size").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"), F.sum(F.octet_length("line") + 1).alias("__bytes"))
    order, every = Window.partitionBy("path").orderBy("__block"), Window.partitionBy("path")
    known = blocks.select(
        "path", "__block", "__first", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("__all"),
        (F.sum("__bytes").over(every) > F.col("__size")).alias("__open"),
    )
    met = rows.drop("__size").join(known, ["path", "__block"]).withColumn("n", F.col("__before") + F.col("__at") - F.col("__first"))
    return met.select("path", "n", "line", (F.col("__open") & (F.col("n") == F.col("__all") - 1)).alias("torn"))


def ledger(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, problems (lines that do not parse) and torn tails (files whose last line has no line feed) of append-only files."""
    lines = numbered_lines(spark, path)
    whole = lines.filter(~F.col("torn") & (F.trim("line") != ""))
    parsed = whole.withColumn("row", F.from_json("line", StructType.fromDDL(f"{schema}, __bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("row").isNull() | F.col("row.__bad").isNotNull()
    names = [f.name for f in StructType.fromDDL(schema)]
    return parsed.filter(~bad).select(*[F.col(f"row.{n}") for n in names]), parsed.filter(bad).select("path", "n", "line"), lines.filter("torn").select("path", "line")


def labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label rows (image, class_id, cx, cy, w, h) of text files, and the lines that have not five numbers."""
    text = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("image"), F.trim("value").alias("line")).filter("line <> ''")
    parts = F.split("line", r"\s+")
    rows = text.select("image", "line", F.size(parts).alias("n"), *[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("class_id", "cx", "cy", "w", "h"))])
    good = (F.col("n") == 5) & F.col("class_id").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    return rows.filter(good).select("image", F.col("class_id").cast("int").alias("class_id"), "cx", "cy", "w", "h"), rows.filter(~good).select("image", "line")


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """image, name, x1, y1, x2, y2 of VOC annotation files."""
    schema = "filename string, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    return docs.select(F.col("filename").alias("image"), F.explode("object").alias("o")).select("image", "o.name", *[F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])


def coco_boxes(spark: SparkSession, path: str) -> DataFrame:
    """image, name, x1, y1, x2, y2 of COCO files."""
    schema = "images array<struct<id:long,file_name:string>>, categories array<struct<id:long,name:string>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("image"))
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("name"))
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.*").join(images, "image_id").join(F.broadcast(names), "category_id")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    return boxes.select("image", "name", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def word_boxes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """image, name, x1, y1, x2, y2 of text annotations (image, line): a word, then x, y, width and height, then anything;
    and the lines that are none. Empty lines, those that begin with % and headings that begin with class do not count."""
    text = lines.withColumn("line", F.trim("line")).filter("line <> '' and line not like '\\%%' and lower(line) not like 'class%'")
    parts = F.split("line", r"\s+")
    x, y, w, h = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (2, 3, 4, 5))
    rows = text.select("image", "line", F.lower(parts[0]).alias("name"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    good = F.col("x2").isNotNull() & F.col("y2").isNotNull()
    return rows.filter(good).drop("line"), rows.filter(~good).select("image", "line")


def geometry_lines(lines: DataFrame) -> DataFrame:
    """clip, track_id, frame, x1, y1, x2, y2 of lines (clip, line) that hold g0 (a box as four numbers), id1 and ts0."""
    box = F.split(F.regexp_extract("line", r"'g0': '([^']*)'", 1), " ")
    number = lambda key: F.regexp_extract("line", rf"'{key}': (\d+)", 1).try_cast("long")
    rows = lines.select("clip", number("id1").alias("track_id"), number("ts0").alias("frame"), *[F.try_element_at(box, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    return rows.dropna()


def type_lines(lines: DataFrame) -> DataFrame:
    """clip, track_id, name: the likeliest class of each track, of lines (clip, line) that hold cset3 (names with scores) and id1;
    of equal scores the name that comes first in the alphabet."""
    pairs = F.regexp_extract_all("line", F.lit(r"'?([A-Za-z_ ]+?)'?\s*:\s*([0-9.]+)\s*[,}]"), F.lit(0))
    scores = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r":\s*([0-9.]+)", 1).try_cast("double").alias("score"), F.trim(F.translate(F.split_part(p, F.lit(":"), F.lit(1)), "'{,", "")).alias("name")))
    held = lines.filter("line like '%cset3%'").select("clip", F.regexp_extract("line", r"'id1': (\d+)", 1).try_cast("long").alias("track_id"), F.explode(scores).alias("s"))
    own = held.filter("track_id is not null and s.name <> '' and s.score is not null and s.name not in ('id1', 'cset3')").select("clip", "track_id", "s.name", "s.score")
    best = own.groupBy("clip", "track_id", "score").agg(F.min("name").alias("name"))
    return best.groupBy("clip", "track_id").agg(F.max_by("name", "score").alias("name"))


def training_summary(log: DataFrame) -> DataFrame:
    """One row on a training log (epoch, and session, fitness, seconds where it has them): rows, epoch_min, epoch_max, those
    logged more than once, sessions, the epoch of the best fitness (of equals the last), the upper median of the seconds and
    the hours. No accuracy figure is read."""
    have = lambda c: F.col(c) if c in log.columns else F.lit(None).cast("double")
    rows = log.select(*[have(c).alias(c) for c in ("epoch", "session", "fitness", "seconds")])
    again = rows.filter("epoch is not null").groupBy(F.col("epoch").cast("int").alias("epoch")).count().filter("count > 1").agg(F.array_sort(F.collect_list("epoch")).alias("epochs_repeated"))
    best = F.max(F.when(F.col("fitness").isNotNull() & F.col("epoch").isNotNull(), F.struct("fitness", "epoch")))["epoch"].cast("int")
    middle = F.expr("try_element_at(array_sort(collect_list(seconds)), cast(count(seconds) div 2 + 1 as int))")
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.min("epoch").cast("int").alias("epoch_min"), F.max("epoch").cast("int").alias("epoch_max"), F.count_distinct("session").alias("sessions"),
        best.alias("best_epoch"), middle.alias("seconds_median"), (F.sum("seconds") / 3600).alias("hours"),
    )
    return one.join(F.broadcast(again))


def persons_csv(spark: SparkSession, path: str, wanted: Sequence[str], bad: Sequence[str]) -> DataFrame:
    """Image ids of a large box table with the boxes of wanted classes, without images that hold a bad class. Filters reach the scan."""
    boxes = spark.read.option("header", True).schema("ImageID string, LabelName string, XMin double, XMax double, YMin double, YMax double").csv(path)
    kept = boxes.filter(F.col("LabelName").isin(*wanted, *bad)).groupBy("ImageID").agg(F.bool_or(F.col("LabelName").isin(*bad)).alias("bad"), F.collect_list(F.when(F.col("LabelName").isin(*wanted), F.struct("XMin", "YMin", "XMax", "YMax"))).alias("boxes"))
    return kept.filter("not bad and size(boxes) > 0").drop("bad")


def label_tsv(spark: SparkSession, path: str) -> DataFrame:
    """path, text of a tab-separated label file, text in Unicode's composed form."""
    import unicodedata

    compose = F.pandas_udf(lambda s: s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore"), "string")
    return spark.read.option("sep", "\t").schema("path string, text string, lines string").csv(path).select("path", compose("text").alias("text"), "lines")


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def training_log(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Columns of a training log found by pattern, renamed; an error if one is missing."""
    import re

    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    out = {}
    for name, pattern in patterns.items():
        hits = [c for c in raw.columns if re.search(pattern, c.strip())]
        if not hits:
            raise ValueError(f"no column like {pattern}")
        out[name] = F.col(f"`{hits[0]}`").try_cast("double").alias(name)
    return raw.select(*out.values())


def clips(spark: SparkSession, path: str, sidecars: DataFrame, default_camera: str) -> DataFrame:
    """Clip files with their sidecar (stem, camera_id, captured_at); without one, the file's time and a default camera."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    j = files.withColumn("stem", stem).join(sidecars, "stem", "left")
    return j.select("stem", "path", "length", F.coalesce("camera_id", F.lit(default_camera)).alias("camera_id"), F.coalesce("captured_at", "modificationTime").alias("captured_at"))


def natural_key(name: Column) -> Column:
    """Sorts names by their numbers' size, other parts by letter: frame2 comes before frame10."""
    parts = F.split(F.lower(name), r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def folder_frames(spark: SparkSession, path: str, fps: float = 20.0, pattern: str = r"(?i)\.(jpe?g|png|bmp|tiff?|webp)$") -> DataFrame:
    """camera_id (the folder's name), seq, t and path of the image files below `path`, each folder's in natural order at
    `fps` frames a second. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").filter(F.col("path").rlike(pattern))
    named = files.withColumns({"camera_id": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "__name": F.regexp_extract("path", r"([^/]+)$", 1)})
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy(natural_key(F.col("__name")), "__name", "path")) - 1
    return named.withColumn("seq", place.cast("long")).select("camera_id", "seq", (F.col("seq") / fps).alias("t"), "path")


def with_gap(frames: DataFrame, by: Sequence[str], least: float = 2.0) -> DataFrame:
    """gap_s before each frame, null where it is short."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t", "seq"))
    return frames.withColumn("gap_s", F.when(gap >= least, gap))


def backoff(attempt: Column, first: float = 0.5, most: float = 30.0) -> Column:
    """Seconds to wait before an attempt, doubled each time."""
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), attempt))


def probe(frames: DataFrame) -> dict[str, object]:
    """Whether there is a row, and the schema."""
    return {"readable": not frames.limit(1).isEmpty(), "schema": frames.schema.simpleString()}


def count_check(observed: DataFrame, expected: dict[str, int], tolerance: float) -> DataFrame:
    """name, observed, expected, ok: counts against expectations within a tolerance; names without files count 0."""
    e = observed.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    n = observed.groupBy("name").agg(F.count(F.lit(1)).alias("observed"))
    return e.join(n, "name", "left").select("name", F.coalesce("observed", F.lit(0)).alias("observed"), "expected").withColumn("ok", F.abs(F.col("observed") - F.col("expected")) <= tolerance * F.col("expected"))


def log_numbers(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The last number that each pattern finds in log lines (n, line)."""
    cols = [F.max_by(F.regexp_extract("line", p, 1), F.when(F.col("line").rlike(p), F.col("n"))).try_cast("double").alias(k) for k, p in patterns.items()]
    return lines.agg(*cols)


def outbox(messages: DataFrame, replies: DataFrame, most: int = 5) -> DataFrame:
    """Delivery status of messages (id, kind) from replies (id, attempt, status): delivered by 2xx or 409, rejected by another 4xx but 408, 425 and 429, lost after `most` tries, else pending; patches of events that are not delivered are skipped."""
    ok = F.col("status").between(200, 299) | (F.col("status") == 409)
    no = F.col("status").between(400, 499) & ~F.col("status").isin(408, 409, 425, 429)
    r = replies.filter(F.col("attempt") <= most).groupBy("id").agg(F.bool_or(ok).alias("ok"), F.bool_or(no).alias("no"), F.max("attempt").alias("tries"), F.min_by(F.when(ok, "ok").otherwise("no"), F.when(ok | no, F.col("attempt"))).alias("end"))
    status = F.when(F.col("end") == "ok", "delivered").when(F.col("end") == "no", "rejected").when(F.col("tries") >= most, "lost").otherwise("pending")
    m = messages.join(r, "id", "left").withColumn("state", status)
    gone = m.filter("kind = 'event' and state in ('lost', 'rejected')").select(F.col("event_id"), F.lit(True).alias("__gone"))
    return m.join(gone, "event_id", "left").select("id", "event_id", "kind", F.when((F.col("kind") == "patch") & F.col("__gone"), "skipped").otherwise(F.col("state")).alias("state"), F.coalesce("tries", F.lit(0)).alias("tries"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_lines(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append rows to a ledger of JSON lines. Files appear when they are whole, so no append can leave a torn line."""
    rows.select(F.to_json(F.struct(*columns)).alias("line")).write.mode("append").text(path)


def without_torn_tails(spark: SparkSession, path: str, target: str) -> int:
    """Write the whole lines of a ledger's files to `target`, and return how many torn tails were left out."""
    lines = numbered_lines(spark, path)
    lines.filter(~F.col("torn") & (F.length("line") > 0)).select("line").write.mode("errorifexists").text(target)
    return lines.filter("torn").count()


def configs(spark: SparkSession, path: str, schema: str, key: str = "camera_id") -> DataFrame:
    """The newest configuration of each camera among JSON files (one object each), with changed_at, the file's time. Read
    anew, it has what changed since; a stream does so in each of its batches."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("changed_at"), F.col("_metadata.file_path").alias("__file"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("changed_at"), F.desc("__file")))
    return rows.filter(F.col(key).isNotNull()).withColumn("__n", n).filter("__n = 1").drop("__n", "__file")


def save_baselines(baselines: DataFrame, path: str, key: str = "camera_id") -> None:
    """Replace the stored baselines of the cameras given; those of others stay."""
    write_partitioned(baselines, path, [key])


def load_baselines(spark: SparkSession, path: str, schema: str, cells: int | None = None, column: str = "grid") -> tuple[DataFrame, DataFrame]:
    """Stored baselines, and those that are refused because their grid has not `cells` numbers."""
    rows = spark.read.schema(schema).parquet(path)
    fits = F.lit(True) if cells is None else F.coalesce(F.size(column) == cells, F.lit(False))
    return rows.filter(fits), rows.filter(~fits)


def located(spark: SparkSession, roots: Sequence[str], pattern: str) -> str | None:
    """The first root below which files match a glob, None if none does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for root in roots:
        path = hadoop.Path(f"{root}/{pattern}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found is not None and len(found):
            return root
    return None


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown."""
    rows = to_pandas_table(df, most)
    cell = lambda v: "" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [rows.columns, ["---"] * len(rows.columns), *rows.astype(object).itertuples(index=False, name=None)]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)


def to_pandas_table(df: DataFrame, most: int = 1000) -> pd.DataFrame:
    """A small report table; larger ones are an error."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("too large for a report")
    return rows

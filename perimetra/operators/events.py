"""Event and update documents: building them from rows, and the errors of documents given as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from perimetra.operators.validate import Schema, consistent_event

# Formats and allowed words of the documents' fields.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SHA256 = r"^[0-9a-f]{64}$"
NAME = r"^[A-Za-z0-9_.-]{1,64}$"
URL = r"^https?://\S{1,2040}$"
UTC_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
STAGES = ("provisional", "confirmed", "sealed")
CLASSES = ("person", "truck", "car", "two_wheeler", "cart")
BANDS = ("detect", "observe", "recognise", "identify")
FILLED = r"^[\s\S]+$"

EXPLANATION = "struct<text:string,source:string,model:string,latency_ms:bigint>"
PLATE = "struct<text:string,script:string,line_confidences:array<double>>"
EVIDENCE = "struct<evidence_id:string,block_n:bigint,clip_sha256:string,prev_sha256:string,clip_url:string,thumb_url:string,sealed_at:string>"
DETECTION = "struct<track_id:bigint,class:string,bbox:array<double>,channel_scores:struct<appearance:double,motion:double>,agreed:boolean,threshold:double,ir:boolean,dori_band:string>"
RULE = "struct<fired:array<string>,baseline:struct<dominant_direction:string,with:bigint,against:bigint>,metrics:struct<dwell_s:double,net_px:double,path_px:double>>"
EVENT = f"struct<event_id:string,post_id:string,camera_id:string,captured_at:string,stage:string,detection:{DETECTION},rule:{RULE},explanation:{EXPLANATION},anpr:{PLATE},evidence:{EVIDENCE},confidence:bigint,source:string>"
UPDATE = f"struct<event_id:string,stage:string,explanation:{EXPLANATION},anpr:{PLATE},evidence:{EVIDENCE}>"


def _keys(schema: Schema, text: Column, kind: DataType, path: str, parts: Column | None = None) -> None:
    """Unknown keys at every level that is an object. parts: the texts of the next level's objects, if they are known."""
    schema.known_keys(text, path, kind.fieldNames())
    for f in kind.fields:
        if isinstance(f.dataType, StructType):
            inner = F.get_json_object(text, f"$.{f.name}") if parts is None else parts[f.name]
            _keys(schema, inner, f.dataType, f"{path}.{f.name}")


def _unit(schema: Schema, values: Column, path: str, least: int, most: int) -> None:
    schema.check(~F.size(values).between(least, most) & values.isNotNull(), f"{path}: bad length")
    schema.check(F.exists(values, lambda v: ~v.between(0, 1) | v.isNull()), f"{path}: out of range")


def _parts(schema: Schema, d: Column) -> None:
    """Explanation, plate and evidence, where they are there."""
    e, p, v = d["explanation"], d["anpr"], d["evidence"]
    schema.check(e.isNotNull() & e["text"].isNull(), "$.explanation.text: required").matches(e["text"], "$.explanation.text", FILLED, 1000)
    schema.check(e.isNotNull() & e["source"].isNull(), "$.explanation.source: required").one_of(e["source"], "$.explanation.source", ("vlm", "template"))
    schema.check(F.length(e["model"]) > 128, "$.explanation.model: bad format").between(e["latency_ms"], "$.explanation.latency_ms", 0, 600_000)
    schema.check(p.isNotNull() & p["text"].isNull(), "$.anpr.text: required").matches(p["text"], "$.anpr.text", FILLED, 64)
    schema.check(p.isNotNull() & p["script"].isNull(), "$.anpr.script: required").one_of(p["script"], "$.anpr.script", ("devanagari", "latin"))
    _unit(schema, p["line_confidences"], "$.anpr.line_confidences", 0, 8)
    for name, pattern in (("evidence_id", NAME), ("clip_sha256", SHA256), ("prev_sha256", SHA256), ("sealed_at", UTC_STAMP)):
        schema.check(v.isNotNull() & v[name].isNull(), f"$.evidence.{name}: required").matches(v[name], f"$.evidence.{name}", pattern)
    schema.check(v.isNotNull() & v["block_n"].isNull(), "$.evidence.block_n: required").check(v["block_n"] < 0, "$.evidence.block_n: out of range")
    for name in ("clip_url", "thumb_url"):
        schema.matches(v[name], f"$.evidence.{name}", URL, 2048)


def _once(raw: Column, kind: str, errors: Callable[[Column], Column]) -> Column:
    """errors(row) of a text that holds an object, with its text, its parsed document d, and parts, the texts of the objects
    in it. These are made once for a text; named field by field they would be parsed for each of them."""
    objects = ", ".join(f"{f.name} string" for f in StructType.fromDDL(kind[7:-1]).fields if isinstance(f.dataType, StructType))
    row = F.struct(raw.alias("text"), F.json_object_keys(raw).isNotNull().alias("is_object"), F.from_json(raw, kind).alias("d"), F.from_json(raw, objects).alias("parts"))
    found = F.transform(F.array(row), lambda p: F.when(p["is_object"], errors(p)).otherwise(F.array(F.lit("$: no object"))))
    return F.element_at(found, 1)


def event_errors(raw: Column, schema_id: str, most: int = 12) -> Column:
    """All errors of an event document, at most `most`: fields, ranges, formats, unknown keys, and what must go together.

    A field of a wrong type counts as missing; a text that is no JSON object has one error.
    """
    return _once(raw, EVENT, lambda row: _event_checks(row, schema_id).errors(most))


def _event_checks(row: Column, schema_id: str) -> Schema:
    raw, d = row["text"], row["d"]
    schema = Schema()
    schema.check(F.coalesce(F.get_json_object(raw, "$.schema") != schema_id, F.lit(True)), "$.schema: not allowed")
    _keys(schema, raw, StructType.fromDDL(f"schema string, {EVENT[7:-1]}"), "$", row["parts"])
    for name, pattern in (("event_id", UUID), ("post_id", NAME), ("camera_id", NAME), ("captured_at", UTC_STAMP)):
        schema.required(d[name], f"$.{name}").matches(d[name], f"$.{name}", pattern)
    for name, allowed in (("stage", STAGES), ("source", ("rtsp", "file"))):
        schema.required(d[name], f"$.{name}").one_of(d[name], f"$.{name}", allowed)
    schema.required(d["confidence"], "$.confidence").between(d["confidence"], "$.confidence", 0, 100)
    x = d["detection"]
    schema.required(x, "$.detection").check(x["track_id"] < 0, "$.detection.track_id: out of range")
    schema.check(x.isNotNull() & x["class"].isNull(), "$.detection.class: required").one_of(x["class"], "$.detection.class", CLASSES)
    _unit(schema, x["bbox"], "$.detection.bbox", 4, 4)
    for path, value in (("channel_scores.appearance", x["channel_scores"]["appearance"]), ("channel_scores.motion", x["channel_scores"]["motion"]), ("threshold", x["threshold"])):
        schema.check(x.isNotNull() & value.isNull(), f"$.detection.{path}: required").between(value, f"$.detection.{path}", 0, 1)
    schema.check(x.isNotNull() & ~F.coalesce(x["agreed"], F.lit(False)), "$.detection.agreed: not allowed").check(x.isNotNull() & x["ir"].isNull(), "$.detection.ir: required")
    schema.one_of(x["dori_band"], "$.detection.dori_band", BANDS)
    r = d["rule"]
    schema.check(r.isNotNull() & r["fired"].isNull(), "$.rule.fired: required").longest(r["fired"], "$.rule.fired", 8)
    schema.check(F.exists(r["fired"], lambda f: ~F.length(f).between(1, 64)), "$.rule.fired: bad format")
    for name in ("with", "against"):
        schema.check(r["baseline"].isNotNull() & (r["baseline"][name].isNull() | (r["baseline"][name] < 0)), f"$.rule.baseline.{name}: out of range")
    schema.check(F.length(r["baseline"]["dominant_direction"]) > 16, "$.rule.baseline.dominant_direction: bad format")
    for name in ("dwell_s", "net_px", "path_px"):
        schema.check(r["metrics"][name] < 0, f"$.rule.metrics.{name}: out of range")
    _parts(schema, d)
    schema.rules += consistent_event(d["stage"], d["explanation"], d["evidence"]).rules
    return schema


def update_errors(raw: Column, schema_id: str, most: int = 12) -> Column:
    """All errors of an update document; it carries one of stage, explanation, anpr and evidence at least."""
    return _once(raw, UPDATE, lambda row: _update_checks(row, schema_id).errors(most))


def _update_checks(row: Column, schema_id: str) -> Schema:
    raw, d = row["text"], row["d"]
    schema = Schema()
    schema.check(F.coalesce(F.get_json_object(raw, "$.schema") != schema_id, F.lit(True)), "$.schema: not allowed")
    _keys(schema, raw, StructType.fromDDL(f"schema string, {UPDATE[7:-1]}"), "$", row["parts"])
    schema.required(d["event_id"], "$.event_id").matches(d["event_id"], "$.event_id", UUID).one_of(d["stage"], "$.stage", STAGES[1:])
    _parts(schema, d)
    schema.check(F.coalesce(d["stage"], F.lit("")).eqNullSafe("") & d["explanation"].isNull() & d["anpr"].isNull() & d["evidence"].isNull(), "$: nothing to update")
    schema.check((d["stage"] == "sealed") & d["evidence"].isNull(), "$.evidence: required when sealed")
    return schema


def unit_box(box: list[Column], width: Column, height: Column) -> Column:
    """A pixel box (x1, y1, x2, y2) as shares of the frame, cut to it."""
    cut = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    return F.array(*[cut(v, size) for v, size in zip(box, (width, height, width, height), strict=True)])


def event_document(schema_id: str, ids: dict[str, Column], detection: dict[str, Column], rule: dict[str, Column], confidence: Column, source: Column) -> Column:
    """The provisional event of a detection, as JSON with the empty parts kept."""
    fields = lambda values: F.struct(*[c.alias(n) for n, c in values.items()])
    empty = {name: F.lit(None).cast(kind) for name, kind in (("explanation", EXPLANATION), ("anpr", PLATE), ("evidence", EVIDENCE))}
    whole = {"schema": F.lit(schema_id), **ids, "stage": F.lit("provisional"), "detection": fields(detection), "rule": fields(rule), **empty, "confidence": confidence, "source": source}
    return F.to_json(fields(whole), {"ignoreNullFields": "false"})


# An alert's stages, names of classes, the hash it shows before it has one, and its sentence.
ALERT_STAGES = {"provisional": "prov", "confirmed": "conf", "sealed": "sealed"}
CLASS_NAMES = {"person": "Person", "truck": "Truck", "car": "Car", "two_wheeler": "Two-wheeler", "cart": "Cart"}
PENDING = "pending…"
SENTENCE = "%s flagged on %s%s; appearance and motion channels agree at %d%% confidence."


def _named(names: dict[str, str], value: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]


def alerts_of(documents: DataFrame, camera_name: Column | None = None, raw: str = "raw") -> DataFrame:
    """The documents with the alert that each event (JSON text in `raw`) is shown as; rows that hold no object have none.

    alert_id, camera, stage, at (hh:mm:ss UTC), reason (the event's own, else a sentence of its class, camera, rules and
    confidence), confidence, plate, hash (shortened, or pending), seed (0 to 100, from the event's id), appearance and
    motion (whether each channel reaches the threshold), and more: JSON of what else is known of track_id, bbox,
    channel_scores, dori_band, rule_fired, evidence_id, clip_url and thumb_url.
    """
    rows = documents.withColumn("__d", F.from_json(raw, EVENT)).filter(F.json_object_keys(raw).isNotNull())
    d = F.col("__d")
    x, v = d["detection"], d["evidence"]
    rules = F.coalesce(d["rule"]["fired"], F.array().cast("array<string>"))
    fired = F.when(F.size(rules) > 0, F.array_join(rules, " + "))
    camera = d["camera_id"] if camera_name is None else F.coalesce(camera_name, d["camera_id"])
    told = F.format_string(SENTENCE, F.coalesce(_named(CLASS_NAMES, x["class"]), F.lit("Object")), camera, F.coalesce(F.concat(F.lit(" ("), fired, F.lit(")")), F.lit("")), d["confidence"])
    digest, sha = F.sha2(d["event_id"], 256), v["clip_sha256"]
    more = F.struct(
        x["track_id"].alias("track_id"), x["bbox"].alias("bbox"), x["channel_scores"].alias("channel_scores"), x["dori_band"].alias("dori_band"), fired.alias("rule_fired"),
        v["evidence_id"].alias("evidence_id"), v["clip_url"].alias("clip_url"), v["thumb_url"].alias("thumb_url"),
    )
    reaches = lambda channel: F.coalesce(x["channel_scores"][channel], F.lit(0.0)) >= x["threshold"]
    return rows.withColumns({
        "alert_id": F.concat(F.lit("A"), F.substring(F.translate(d["event_id"], "-", ""), 1, 16)), "camera": camera, "stage": _named(ALERT_STAGES, d["stage"]), "at": F.date_format(F.try_to_timestamp(d["captured_at"]), "HH:mm:ss"),
        "reason": F.coalesce(d["explanation"]["text"], told), "confidence": d["confidence"], "plate": d["anpr"]["text"],
        "hash": F.when(F.length(sha) >= 14, F.concat(F.substring(sha, 1, 8), F.lit("…"), F.substring(sha, -6, 6))).otherwise(PENDING),
        "seed": F.round(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967295.0 * 100, 2), "appearance": reaches("appearance"), "motion": reaches("motion"), "more": F.to_json(more),
    }).drop("__d")

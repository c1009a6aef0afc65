"""Queries of the text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import text
from perimetra.plans.bind import table
from perimetra.plans.registry import query


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_DIGITS_SQL = "translate(CAST(1000 + user_id % 9000 AS VARCHAR), '0123456789', '०१२३४५६७८९')"


@query(f"""WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'B' || upper(substr(event_type, 1, 1 + CAST(event_id % 3 AS INTEGER))) || CAST(1000 + user_id AS VARCHAR) WHEN 1 THEN 'BP-' || CAST(event_id % 12 AS VARCHAR) || '-A' || CAST(1000 + user_id AS VARCHAR)
  WHEN 2 THEN 'बा२च' || {_DIGITS_SQL} WHEN 3 THEN 'बागमतीप्रदेश०२' || CASE WHEN event_id % 2 = 0 THEN '०२५' ELSE '०२' END || 'च' || {_DIGITS_SQL} ELSE event_type || 'मे१प' || {_DIGITS_SQL} || 'x' END AS plate FROM events)
SELECT event_id, plate, regexp_full_match(plate, {_sql(text.NEPAL_EMBOSSED)}) AS embossed, regexp_full_match(plate, {_sql(text.BHUTAN)}) AS bhutan, regexp_full_match(plate, {_sql(text.NEPAL_ZONE)}) AS zone, regexp_full_match(plate, {_sql(text.NEPAL_PROVINCE)}) AS province,
  nullif(regexp_extract(plate, '(?:' || {_sql(text.NEPAL_PROVINCE)} || '|' || {_sql(text.NEPAL_ZONE.replace("?P<", "?P<z_"))} || ')', 0), '') AS best FROM p""")
def plate_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plates parse, by grammar, and the plate found inside a reading."""
    e = table(spark, sf_dir, "events")
    letters = F.upper(F.expr("substr(event_type, 1, cast(1 + event_id % 3 as int))"))
    digits, k = (F.col("user_id") + 1000).cast("string"), F.col("event_id") % 5
    own = F.translate((F.col("user_id") % 9000 + 1000).cast("string"), "0123456789", "०१२३४५६७८९")
    lot = F.when(F.col("event_id") % 2 == 0, "०२५").otherwise("०२")
    plate = F.when(k == 0, F.concat(F.lit("B"), letters, digits)).when(k == 1, F.concat(F.lit("BP-"), (F.col("event_id") % 12).cast("string"), F.lit("-A"), digits)).when(k == 2, F.concat(F.lit("बा२च"), own))
    plate = plate.when(k == 3, F.concat(F.lit("बागमतीप्रदेश०२"), lot, F.lit("च"), own)).otherwise(F.concat("event_type", F.lit("मे१प"), own, F.lit("x")))
    kinds = (("embossed", text.NEPAL_EMBOSSED), ("bhutan", text.BHUTAN), ("zone", text.NEPAL_ZONE), ("province", text.NEPAL_PROVINCE))
    best = F.pandas_udf(lambda plates: plates.map(text.best_plate), "string")
    return e.select("event_id", plate.alias("plate")).select("event_id", "plate", *[F.col("plate").rlike(text.java(form)).alias(name) for name, form in kinds], best("plate").alias("best"))


_LEXICON_SQL = ", ".join(f"({_sql(code)}, {_sql(label)}, {_sql(pattern)})" for code, lexicon in text.FORBIDDEN.items() for pattern, label in lexicon)


# DuckDB's word borders know ASCII letters only, so other letters are made ASCII ones first.
@query(f"SELECT conv_id, turn, code, label FROM (SELECT *, regexp_replace(text, '[À-ɏЀ-ӿऀ-ॿ぀-ヿ一-鿿가-힣]', 'x', 'g') AS plain FROM conversations), (VALUES {_LEXICON_SQL}) AS l(code, label, pattern) WHERE regexp_matches(plain, pattern, 'i')")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forbidden words that each turn uses, by label."""
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.lexicon_labels(F.col("text"))).alias("hit"))
    return hits.select("conv_id", "turn", "hit.code", "hit.label")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'crossed line in' WHEN event_id % 4 = 1 THEN 'At 10:30: ' || event_type ELSE 'At 10:30: movement noted' END AS reason FROM events""")
def template_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reason that is there at once and never empty."""
    k = F.col("event_id") % 4
    given, rules = F.when(k == 0, "crossed line in").when(k == 3, "  "), F.when(k == 1, F.col("event_type")).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", text.template_reason(rules, given, F.lit("10:30")).alias("reason"))


@query()
def sentence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of what is wrong with each turn as an alert's reason; grounding in facts has no SQL form."""
    facts = text.Facts(frozenset({"loitering"}), "10:30", (("duration_s", 5.0),))

    def codes(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: ",".join(text.violations(text.repaired(r), facts)))

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.pandas_udf(codes, "string")("text").alias("codes"))

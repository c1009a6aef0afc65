"""Queries of the evidence family: orders of one customer are a chain of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import evidence
from perimetra.plans.bind import POINTS_SQL, settled, table, track_points
from perimetra.plans.registry import query

_FIELDS = ("id", "status", "sealed_at")
_BODY = "'block/1' || chr(10) || 'id=' || CAST(id AS VARCHAR) || chr(10) || 'status=' || status || chr(10) || 'sealed_at=' || CAST(sealed_at AS VARCHAR) || chr(10) || 'prev=' || {prev} || chr(10)"
_CHAIN_SQL = f"""blk AS (SELECT o_custkey AS chain, o_orderkey AS id, o_orderstatus AS status, CAST(epoch(o_orderdate) AS BIGINT) AS sealed_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
ch AS (SELECT chain, id, status, sealed_at, n, repeat('0', 64) AS prev, sha256({_BODY.format(prev="repeat('0', 64)")}) AS h FROM blk WHERE n = 1
  UNION ALL SELECT b.chain, b.id, b.status, b.sealed_at, b.n, c.h, sha256({_BODY.replace("id AS", "b.id AS").replace("|| status ||", "|| b.status ||").replace("CAST(sealed_at", "CAST(b.sealed_at").format(prev="c.h")}) FROM ch c JOIN blk b ON b.chain = c.chain AND b.n = c.n + 1)"""
#: Tampering: some blocks get another status, some are lost.
_TAMPERED_SQL = f"""{_CHAIN_SQL}, st AS (SELECT chain, id, CASE WHEN id % 41 = 7 THEN 'X' ELSE status END AS status, sealed_at, n, prev, h FROM ch WHERE id % 53 <> 11),
ck AS (SELECT *, h <> sha256({_BODY.format(prev="prev")}) AS b_hash, CASE WHEN lag(h) OVER w IS NULL THEN prev <> repeat('0', 64) ELSE prev <> lag(h) OVER w END AS b_link,
  CASE WHEN lag(n) OVER w IS NULL THEN n <> 1 ELSE n <> lag(n) OVER w + 1 END AS b_seq, coalesce(sealed_at < lag(sealed_at) OVER w, false) AS b_time FROM st WINDOW w AS (PARTITION BY chain ORDER BY n))"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("sealed_at"))
    return evidence.chained(o, ["chain"], ["id"], _FIELDS)


@query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT chain, n, id, prev AS prev_block_hash, h AS block_hash FROM ch")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("chain", "n", "id", "prev_block_hash", "block_hash")


@query(f"""WITH RECURSIVE {_TAMPERED_SQL} SELECT chain, n, array_to_string(list_filter([CASE WHEN b_hash THEN 'hash' END, CASE WHEN b_link THEN 'link' END, CASE WHEN b_seq THEN 'sequence' END, CASE WHEN b_time THEN 'sealed_at' END], lambda x: x IS NOT NULL), ',') AS reasons,
  NOT bool_or(b_hash OR b_link) OVER (PARTITION BY chain ORDER BY n ROWS UNBOUNDED PRECEDING) AND NOT (b_hash OR b_link OR b_seq OR b_time) AS ok FROM ck""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tampered ledger: what is wrong where, and which blocks still stand."""
    bad = _blocks(spark, sf_dir).filter("id % 53 <> 11").withColumn("status", F.when(F.col("id") % 41 == 7, "X").otherwise(F.col("status")))
    v = evidence.verify(bad, evidence.chain_hash(_FIELDS), ["chain"])
    return v.select("chain", "n", F.array_join("reasons", ",").alias("reasons"), "ok")


@query(f"""WITH RECURSIVE {_TAMPERED_SQL}, v AS (SELECT chain, n, strftime(to_timestamp(sealed_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, array_to_string(list_filter([CASE WHEN b_hash THEN 'hash' END, CASE WHEN b_link THEN 'link' END, CASE WHEN b_seq THEN 'sequence' END, CASE WHEN b_time THEN 'sealed_at' END], lambda x: x IS NOT NULL), ',') AS reasons,
  NOT bool_or(b_hash OR b_link) OVER (PARTITION BY chain ORDER BY n ROWS UNBOUNDED PRECEDING) AND NOT (b_hash OR b_link OR b_seq OR b_time) AS ok FROM ck)
SELECT chain, count(*) AS blocks, count(*) FILTER (ok) AS standing, min(n) FILTER (NOT ok) AS first_broken, arg_min(reasons, n) FILTER (NOT ok) AS reasons, min(day) AS from_day, max(day) AS to_day FROM v WHERE day BETWEEN '1996-06-01' AND '1998-12-31' GROUP BY chain""")
def certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's certificate of two and a half years of the tampered ledger."""
    bad = _blocks(spark, sf_dir).filter("id % 53 <> 11").withColumn("status", F.when(F.col("id") % 41 == 7, "X").otherwise(F.col("status")))
    return evidence.certificate(bad, evidence.chain_hash(_FIELDS), ["chain"], F.to_date(F.timestamp_seconds("sealed_at")), "1996-06-01", "1998-12-31")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("place"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))


def _tree_sql(variant: str, source: str, levels: int = 7) -> str:
    """Roots (g, root, leaves) of the groups g of a source (g, place, content), level by level."""
    first = "unhex(sha256(unhex('00') || unhex(sha256(content))))" if variant == "promote" else "unhex(sha256(content))"
    parts = [f"l0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY place) - 1 AS place, {first} AS h FROM ({source})), sz AS (SELECT g, count(*) AS leaves FROM l0 GROUP BY g)"]
    for k in range(levels):
        if variant == "promote":
            node = "CASE WHEN count(*) = 1 THEN any_value(h) ELSE unhex(sha256(unhex('01') || arg_min(h, place) || arg_max(h, place))) END"
        else:
            node = "CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE unhex(sha256(lower(hex(arg_min(h, place))) || lower(hex(arg_max(h, place))))) END"
        parts.append(f"l{k + 1} AS (SELECT g, place // 2 AS place, {node} AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM l{k}) GROUP BY g, place // 2)")
    return f"{', '.join(parts)}, roots AS (SELECT g, lower(hex(h)) AS root, leaves FROM l{levels} JOIN sz USING (g))"


def _merkle_sql(variant: str) -> str:
    return f"WITH {_tree_sql(variant, 'SELECT o_custkey AS g, o_orderkey AS place, CAST(o_orderkey AS VARCHAR) AS content FROM orders')} SELECT g AS chain, root, leaves FROM roots"


@query(_merkle_sql("promote"))
def merkle_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merkle_root(_leaves(spark, sf_dir), ["chain"])


@query(_merkle_sql("duplicate"))
def merkle_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merkle_root(_leaves(spark, sf_dir), ["chain"], "duplicate")


_PROOF_SQL = _tree_sql("promote", "SELECT strftime(o_orderdate, '%Y-%m') AS g, o_orderkey AS place, CAST(o_orderkey AS VARCHAR) AS content FROM orders", 11)
_SIDES_SQL = " UNION ALL ".join(f"SELECT l0.g, l0.place AS index, {k} AS k, lower(hex(s.h)) AS h FROM l0 JOIN l{k} s ON s.g = l0.g AND s.place = xor(l0.place >> {k}, 1)" for k in range(11))


@query(f"""WITH {_PROOF_SQL}, sides AS ({_SIDES_SQL}), proofs AS (SELECT g, index, string_agg(h, ',' ORDER BY k) AS proof FROM sides GROUP BY 1, 2)
SELECT l0.g AS month, l0.place AS index, leaves, root, coalesce(proof, '') AS proof, true AS stands, false AS stands_changed FROM l0 JOIN roots USING (g) LEFT JOIN proofs p ON p.g = l0.g AND p.index = l0.place""")
def inclusion_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every order in its month's tree; all stand, and none does for another leaf."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("place"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))
    made = evidence.inclusion_proofs(o, ["month"])
    checked = made.withColumn("stands", evidence.proven(made))
    other = checked.withColumn("hash", F.sha2("hash", 256))
    return other.withColumn("stands_changed", evidence.proven(other)).select("month", "index", "leaves", "root", F.array_join("proof", ",").alias("proof"), "stands", "stands_changed")


#: Cameras as devices: each has started once or twice, some after a clean stop, some with clips or torn lines left.
_BOOTS_SQL = f"""{POINTS_SQL}, last AS (SELECT track_id AS device, max(t) AS t, arg_max(class_name, t) AS c, count(*) AS n FROM pts GROUP BY 1),
boots AS (SELECT device, 1 AS boot, floor(t) + 1000 AS began FROM last UNION ALL SELECT -device - 1, 1, floor(t) - 500.0 FROM last WHERE device % 3 = 0),
st AS (SELECT b.device, boot, began, CASE WHEN b.device < 0 OR b.device % 10 = 4 THEN NULL WHEN c IN ('purchase', 'view') THEN 'stopped' ELSE 'running' END AS state, floor(t) AS alive, CASE WHEN b.device % 4 = 1 THEN NULL ELSE n END AS last_n, CASE WHEN b.device % 4 = 1 THEN NULL ELSE floor(t) + CASE WHEN b.device % 5 = 0 THEN 5000 ELSE 60 END END AS sealed,
  CASE WHEN b.device % 7 = 2 THEN 40 + b.device END AS tail, CASE WHEN b.device % 9 = 5 THEN 1 + b.device % 3 END AS clips FROM boots b LEFT JOIN last l ON l.device = b.device),
nt AS (SELECT *, list_filter([CASE WHEN tail > 0 THEN 'ledger tail of ' || CAST(tail AS VARCHAR) || ' bytes set aside' END, CASE WHEN clips > 0 THEN CAST(clips AS VARCHAR) || ' unsealed clips set aside' END], lambda x: x IS NOT NULL) AS notes FROM st),
gp AS (SELECT *, coalesce(state = 'stopped', false) AND len(notes) = 0 AS clean FROM nt WHERE state IS NOT NULL OR coalesce(last_n, 0) > 0 OR len(notes) > 0),
gaps AS (SELECT device, boot, CASE WHEN clean THEN 'restart' ELSE 'power loss' END AS kind, least(CASE WHEN clean THEN alive + 30 ELSE coalesce(greatest(CASE WHEN state IS NOT NULL THEN alive END, sealed), began) END, began) AS start, began AS "end", CAST(coalesce(last_n, 0) AS BIGINT) AS after_n,
  CASE WHEN clean THEN 'restart after a clean shutdown' ELSE array_to_string(list_prepend(CASE WHEN state IS NULL THEN 'no run marker' ELSE 'no clean shutdown' END, notes), '; ') END AS reason FROM gp)"""
_GAP_BODY = "'gap/1' || chr(10) || 'boot=' || CAST(boot AS VARCHAR) || chr(10) || 'kind=' || kind || chr(10) || 'start=' || CAST(CAST(start AS BIGINT) AS VARCHAR) || chr(10) || 'end=' || CAST(CAST(\"end\" AS BIGINT) AS VARCHAR) || chr(10) || 'after_n=' || CAST(after_n AS VARCHAR) || chr(10) || 'reason=' || reason || chr(10) || 'prev=' || {prev} || chr(10)"


@query(f"""WITH {_BOOTS_SQL}, one AS (SELECT *, sha256({_GAP_BODY.format(prev="repeat('0', 64)")}) AS h1 FROM gaps), two AS (SELECT device, 2 AS boot, 'restart' AS kind, "end" + 50 AS start, "end" + 90 AS "end", after_n, 'restart after a clean shutdown' AS reason, h1 FROM one WHERE device % 2 = 0)
SELECT device, boot, kind, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", after_n, reason, 1 AS n, repeat('0', 64) AS prev_block_hash, h1 AS block_hash FROM one
UNION ALL SELECT device, boot, kind, CAST(start AS BIGINT), CAST("end" AS BIGINT), after_n, reason, 2, h1, sha256({_GAP_BODY.format(prev="h1")}) FROM two""")
def restart_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that devices log as they start: of their run markers, ledger heads, pending clips and torn lines. The first
    start's recovery is run twice, as after a kill; some devices then stop cleanly and start again."""
    last = settled(track_points(spark, sf_dir).groupBy(F.col("track_id").alias("device")).agg(F.max("t").alias("t"), F.max_by("class_name", "t").alias("c"), F.count(F.lit(1)).alias("n")))
    at = F.floor("t")
    known = last.select("device", (at + 1000).alias("at")).unionByName(last.filter("device % 3 = 0").select((-F.col("device") - 1).alias("device"), (at - 500).alias("at")))
    boots = known.select("device", F.lit(1).alias("boot"), "at")
    stopped = F.col("c").isin("purchase", "view")
    markers = last.filter("device % 10 <> 4").select("device", F.when(stopped, "stopped").otherwise("running").alias("state"), at.alias("last_alive"), F.when(stopped, at + 30).alias("stopped_at"))
    heads = last.filter("device % 4 <> 1").select("device", F.col("n").alias("last_n"), (at + F.when(F.col("device") % 5 == 0, 5000).otherwise(60)).alias("last_sealed"))
    torn = boots.filter("device % 7 = 2").select("device", F.lit("ledger").alias("log"), (40 + F.col("device")).alias("bytes"))
    pending = boots.filter("device % 9 = 5").select("device", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("device") % 3)).alias("clip"))
    first = evidence.recovered(boots, markers, heads, pending, torn)
    empty = spark.createDataFrame([], "device long, boot int, kind string, start long, end long, after_n long, reason string, n long, prev_block_hash string, block_hash string")
    log = settled(evidence.log_gaps(empty, first).select(empty.columns))
    log = settled(log.unionByName(evidence.log_gaps(log, first).select(empty.columns)))  # again: nothing is added
    again = log.filter("device % 2 = 0").select("device", F.lit(2).alias("boot"), (F.col("end") + 90).alias("at"))
    clean = log.filter("device % 2 = 0").select("device", F.lit("stopped").alias("state"), F.col("end").alias("last_alive"), (F.col("end") + 50).alias("stopped_at"))
    second = evidence.recovered(again, clean, log.select("device", F.col("after_n").alias("last_n"), F.col("end").alias("last_sealed")), pending.limit(0), torn.limit(0))
    return log.unionByName(evidence.log_gaps(log, second).select(empty.columns)).withColumn("n", F.col("n").cast("int"))


_DAYS_SQL = """SELECT 'a' || strftime(o_orderdate, '%Y-%m-%d') AS g, o_orderkey AS place, CAST(o_orderkey AS VARCHAR) AS content FROM orders WHERE EXTRACT(day FROM o_orderdate) <> 3
UNION ALL SELECT 'b' || strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, CASE WHEN EXTRACT(day FROM o_orderdate) = 9 AND o_orderkey % 2 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END FROM orders WHERE EXTRACT(day FROM o_orderdate) <> 4
UNION ALL SELECT 'c' || strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, CASE WHEN EXTRACT(day FROM o_orderdate) = 15 AND o_orderkey % 2 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END FROM orders WHERE EXTRACT(day FROM o_orderdate) <> 21"""


@query(f"""WITH {_tree_sql("promote", _DAYS_SQL)}, a AS (SELECT substr(g, 2) AS day, root FROM roots WHERE g LIKE 'a%'), b AS (SELECT substr(g, 2) AS day, root FROM roots WHERE g LIKE 'b%'), c AS (SELECT substr(g, 2) AS day, root FROM roots WHERE g LIKE 'c%')
SELECT day, CASE WHEN a.root IS NULL THEN 'no local root' WHEN b.root IS NULL THEN 'no mirror root' WHEN c.root IS NULL THEN 'no blocks' WHEN a.root <> b.root THEN 'mirror differs' WHEN a.root <> c.root THEN 'blocks differ' ELSE 'ok' END AS status FROM a FULL JOIN b USING (day) FULL JOIN c USING (day)""")
def root_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local, mirrored and recomputed Merkle roots of the days, some lost and some of other blocks."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.dayofmonth("o_orderdate").alias("dom"), F.col("o_orderkey").alias("n"))

    def roots(lost: int, changed: int) -> DataFrame:
        content = F.when((F.col("dom") == changed) & (F.col("n") % 2 == 0), "x").otherwise(F.col("n").cast("string"))
        return evidence.daily_roots(o.filter(F.col("dom") != lost).withColumn("block_hash", F.sha2(content, 256)), F.col("day"))

    return evidence.compare_roots(roots(3, 0), roots(4, 9), roots(21, 15))


@query(f"""WITH {POINTS_SQL}, m AS (SELECT camera_id, t, CASE WHEN class_name = 'purchase' THEN 'stopped' ELSE 'running' END AS state FROM pts), p AS (SELECT *, lag(t) OVER w AS start_t, lag(state) OVER w AS was FROM m WINDOW w AS (PARTITION BY camera_id ORDER BY t))
SELECT camera_id, round(start_t, 3) AS "start", round(t, 3) AS "end", CASE WHEN was = 'stopped' THEN 'restart' ELSE 'power loss' END AS kind FROM p WHERE t - start_t > 5400""")
def gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long silences of each camera."""
    m = track_points(spark, sf_dir).select("camera_id", "t", F.when(F.col("class_name") == "purchase", "stopped").otherwise("running").alias("state"))
    return evidence.classify_gaps(m, ["camera_id"], 5400.0).withColumns({c: F.round(c, 3) for c in ("start", "end")})


@query("SELECT substr(o_orderkey_sha, 1, 8) || '…' || substr(o_orderkey_sha, 61, 4) AS short, o_orderkey FROM (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS o_orderkey_sha FROM orders)")
def short_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.substring(h, 1, 8), F.lit("…"), F.substring(h, 61, 4)).alias("short"))

"""Change-data capture, history, reload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import scd2
from lakeloom.queries.registry import CDC_SQL, HISTORY_SQL, SHOWN_SQL, cdc_events, no_versions, no_watermark, query, shown


def _applied(spark, read) -> scd2.Applied:
    return scd2.apply(cdc_events(read), no_versions(spark), no_watermark(spark))


@query(f"WITH {HISTORY_SQL} {SHOWN_SQL}")
def scd2_history(spark, read) -> DataFrame:
    return shown(_applied(spark, read).versions)


@query(f"WITH {HISTORY_SQL} SELECT client_id, lsn, reason AS reason_code, CASE reason WHEN 'stale_lsn' THEN 'INFO' ELSE 'WARNING' END AS severity, '{{\"client_id\":' || client_id || ',\"lsn\":' || lsn || ',\"op\":\"' || op || '\"}}' AS raw_payload FROM j1 WHERE reason IS NOT NULL")
def cdc_quarantine(spark, read) -> DataFrame:
    return _applied(spark, read).quarantine.select("client_id", "lsn", "reason_code", "severity", "raw_payload")


@query(f"WITH {HISTORY_SQL} SELECT client_id, max(lsn) AS last_applied_lsn FROM acc GROUP BY client_id")
def cdc_watermark(spark, read) -> DataFrame:
    return _applied(spark, read).watermark


@query(f"WITH {HISTORY_SQL} {SHOWN_SQL}")
def scd2_two_batches(spark, read) -> DataFrame:
    """The log applied in two batches by arrival gives the same history."""
    events = cdc_events(read)
    half = events.agg(F.expr("CAST(max(seq) / 16 AS BIGINT) * 8").alias("h")).first()["h"]
    first = scd2.apply(events.filter(F.col("seq") < half), no_versions(spark), no_watermark(spark))
    return shown(scd2.apply(events.filter(F.col("seq") >= half), first.versions, first.watermark).versions)


@query(f"WITH {HISTORY_SQL} SELECT client_id, source_lsn, risk_category, account_balance_usd FROM versions WHERE is_current AND NOT is_deleted")
def scd2_current_state(spark, read) -> DataFrame:
    return _applied(spark, read).versions.filter("is_current AND NOT is_deleted").select("client_id", "source_lsn", "risk_category", "account_balance_usd")


@query(f"WITH {HISTORY_SQL} SELECT count(*) AS clients, count(*) FILTER (WHERE c <> 1) AS without_one_current FROM (SELECT count(*) FILTER (WHERE is_current) AS c FROM versions GROUP BY client_id)")
def scd2_invariants(spark, read) -> DataFrame:
    """Every client has exactly one current version."""
    per = _applied(spark, read).versions.groupBy("client_id").agg(F.count_if("is_current").alias("c"))
    return per.agg(F.count(F.lit(1)).alias("clients"), F.count_if(F.col("c") != 1).alias("without_one_current"))


@query(f"WITH {CDC_SQL} SELECT client_id, arg_min(op, seq) AS op FROM cdc GROUP BY client_id")
def cdc_first_op_arrival(spark, read) -> DataFrame:
    return scd2.first_ops(cdc_events(read), "seq")


@query(f"WITH {CDC_SQL} SELECT client_id FROM cdc GROUP BY client_id HAVING arg_min(op, lsn) = 'insert'")
def insert_first_exclusion(spark, read) -> DataFrame:
    """Clients whose first operation is an insert get no baseline."""
    return scd2.first_ops(cdc_events(read)).filter("op = 'insert'").select("client_id")


@query(f"WITH {CDC_SQL}, w AS (SELECT client_id, max(lsn) AS m FROM cdc WHERE seq < 4000 GROUP BY client_id) SELECT client_id, lsn FROM cdc WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.client_id = cdc.client_id AND cdc.lsn <= w.m)")
def cdc_unapplied_events(spark, read) -> DataFrame:
    events = cdc_events(read)
    marks = events.filter("seq < 4000").groupBy("client_id").agg(F.max("lsn").alias("last_applied_lsn"))
    return scd2.unapplied(events, marks).select("client_id", "lsn")


@query(f"WITH {CDC_SQL} SELECT c_custkey AS client_id, CAST(0 AS BIGINT) AS source_lsn, CAST(floor(c_acctbal * 100) AS BIGINT) AS account_balance_usd, true AS is_current FROM customer WHERE c_custkey NOT IN (SELECT client_id FROM cdc GROUP BY client_id HAVING arg_min(op, lsn) = 'insert')")
def baseline_seed(spark, read) -> DataFrame:
    profiles = read("customer").select(F.col("c_custkey").alias("client_id"), F.col("c_mktsegment").alias("risk_category"), F.floor(F.col("c_acctbal") * 100).cast("bigint").alias("account_balance_usd"), F.lit("active").alias("account_status"))
    out = scd2.baseline(profiles, cdc_events(read), no_versions(spark))
    return out.select("client_id", "source_lsn", "account_balance_usd", "is_current")


_START, _STOP = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
_AFFECTED_SQL = f"aff AS (SELECT client_id, min(lsn) AS reset_lsn FROM cdc WHERE commit_ts >= TIMESTAMP '{_START}' AND commit_ts < TIMESTAMP '{_STOP}' GROUP BY client_id)"


def _bounds():
    return F.lit(_START).cast("timestamp_ntz"), F.lit(_STOP).cast("timestamp_ntz")


@query(f"WITH {CDC_SQL}, {_AFFECTED_SQL} SELECT client_id, reset_lsn FROM aff")
def reload_affected(spark, read) -> DataFrame:
    events = cdc_events(read)
    first = _applied(spark, read)
    _, affected = scd2.reload(events, first.versions, first.watermark, *_bounds())
    return affected


_RELOAD_SQL = f"""WITH {HISTORY_SQL}, {_AFFECTED_SQL},
kept AS (SELECT a.client_id, a.lsn, a.op, a.risk_category, a.account_balance_usd, a.account_status, a.commit_ts FROM acc a LEFT JOIN aff USING (client_id) WHERE reset_lsn IS NULL OR a.lsn < reset_lsn),
replay AS (SELECT e.client_id, e.lsn, e.op, e.risk_category, e.account_balance_usd, e.account_status, e.commit_ts, e.op = 'delete' AND NOT (EXISTS (SELECT 1 FROM kept k WHERE k.client_id = e.client_id) OR coalesce(max(CASE WHEN e.op <> 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY e.client_id ORDER BY e.lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS lost FROM j0 e JOIN aff USING (client_id) WHERE e.lsn >= reset_lsn),
al AS (SELECT client_id, lsn, op, risk_category, account_balance_usd, account_status, commit_ts FROM kept UNION ALL SELECT client_id, lsn, op, risk_category, account_balance_usd, account_status, commit_ts FROM replay WHERE NOT lost),
g AS (SELECT *, count(CASE WHEN op <> 'delete' THEN 1 END) OVER (PARTITION BY client_id ORDER BY lsn) AS grp FROM al),
reloaded AS (SELECT client_id, lsn AS source_lsn, max(CASE WHEN op <> 'delete' THEN risk_category END) OVER (PARTITION BY client_id, grp) AS risk_category, max(CASE WHEN op <> 'delete' THEN account_balance_usd END) OVER (PARTITION BY client_id, grp) AS account_balance_usd, CASE WHEN op = 'delete' THEN 'deleted' ELSE account_status END AS account_status, commit_ts AS valid_from, coalesce(lead(commit_ts) OVER (PARTITION BY client_id ORDER BY lsn), TIMESTAMP '9999-12-31 00:00:00') AS valid_to, lead(commit_ts) OVER (PARTITION BY client_id ORDER BY lsn) IS NULL AS is_current, op = 'delete' AS is_deleted FROM g)"""


@query(f"{_RELOAD_SQL} {SHOWN_SQL.replace('FROM versions', 'FROM reloaded')}")
def reload_history(spark, read) -> DataFrame:
    """History rebuilt by replay in lsn order for the clients with events in a window."""
    first = _applied(spark, read)
    return shown(scd2.reload(cdc_events(read), first.versions, first.watermark, *_bounds())[0].versions)


@query(f"{_RELOAD_SQL} SELECT p.lsn, p.client_id, v.source_lsn FROM cdc p LEFT JOIN reloaded v ON p.client_id = v.client_id AND v.valid_from <= p.commit_ts AND v.valid_to > p.commit_ts WHERE p.event_type = 'purchase'")
def reload_fact_reresolve(spark, read) -> DataFrame:
    """Facts find their keys again after a reload; deterministic keys need no repointing."""
    from lakeloom.operators import star

    first = _applied(spark, read)
    versions = scd2.reload(cdc_events(read), first.versions, first.watermark, *_bounds())[0].versions
    facts = cdc_events(read).filter("account_status = 'purchase'").select("lsn", "client_id", "commit_ts")
    return star.asof_window(facts, versions, "client_id", F.col("commit_ts"), ["source_lsn"]).select("lsn", "client_id", "source_lsn")


@query(f"WITH {HISTORY_SQL} SELECT client_id || '|' || source_lsn || '|' || risk_category || '|' || account_balance_usd || '|' || account_status || '|' || is_current || '|' || is_deleted AS line FROM versions")
def state_dump(spark, read) -> DataFrame:
    return scd2.state_lines(_applied(spark, read).versions)

"""Data quality, health and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import quality as Q
from lakeloom.queries.registry import money, query

_CHECKS = [("balance_not_negative", "CRITICAL", "SELECT count(*) FROM customer WHERE c_acctbal < 0"), ("name_present", "CRITICAL", "SELECT count(*) FROM customer WHERE c_name IS NULL"), ("segment_known", "WARNING", "SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")]
_CHECKS_SQL = " UNION ALL ".join(f"SELECT 'customer' AS table_name, '{n}' AS check_name, '{s}' AS severity, CAST(({q}) AS BIGINT) AS unexpected_count" for n, s, q in _CHECKS)


@query(f"SELECT *, unexpected_count = 0 AS passed FROM ({_CHECKS_SQL})")
def dq_sql_assertions(spark, read) -> DataFrame:
    read("customer").createOrReplaceTempView("customer")
    return Q.run_assertions(spark, "customer", _CHECKS)


_SUITE_SQL = """SELECT 'orders' AS table_name, check_name, severity, n = 0 AS passed, n AS unexpected_count, checked FROM (
SELECT 'expect_column_values_to_be_between:o_totalprice' AS check_name, 'CRITICAL' AS severity, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS n, count(*) AS checked FROM orders
UNION ALL SELECT 'expect_column_values_to_not_be_null:o_orderkey', 'CRITICAL', count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FROM orders
UNION ALL SELECT 'expect_column_values_to_be_in_set:o_orderstatus', 'WARNING', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FROM orders)"""


def _suite(read) -> DataFrame:
    return Q.run_suite(read("orders"), "orders", [Q.between("o_totalprice", 1000, 400000), Q.not_null("o_orderkey"), Q.in_set("o_orderstatus", ["F", "O"])])


@query(_SUITE_SQL)
def dq_expectation_suite(spark, read) -> DataFrame:
    """All expectations of a table in one pass."""
    return _suite(read)


@query(f"""SELECT table_name, check_name AS reason_code, severity, '{{"check_name":"' || check_name || '","unexpected_count":' || unexpected_count || '}}' AS raw_payload FROM ({_SUITE_SQL}) WHERE NOT passed AND severity = 'CRITICAL'""")
def dq_severity_routing(spark, read) -> DataFrame:
    """Failed critical checks leave one summary row each."""
    return Q.quarantine_summaries(_suite(read))


#: A check log from events: tables are event types, runs are days, a check is an event.
_LOG_SQL = "log AS (SELECT event_type AS table_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, CAST(event_id AS VARCHAR) AS check_name, value >= 5 AS passed, event_id AS executed_at FROM events)"
_HEALTH_SQL = f"WITH {_LOG_SQL}, r AS (SELECT table_name, run_id, min(executed_at) AS run_at, count(*) FILTER (WHERE NOT passed) AS failed_checks, count(*) AS total_checks FROM log GROUP BY 1, 2), h AS (SELECT *, lag(failed_checks) OVER (PARTITION BY table_name ORDER BY run_at) AS prev_failed_checks FROM r)"


def _log(read) -> DataFrame:
    return read("events").select(F.col("event_type").alias("table_name"), F.to_date("ts").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("check_name"), (F.col("value") >= 5).alias("passed"), F.col("event_id").alias("executed_at"))


@query(f"{_HEALTH_SQL} SELECT *, coalesce(failed_checks > prev_failed_checks, false) AS is_regression FROM h")
def dq_table_health(spark, read) -> DataFrame:
    """Failed checks by run against the run before."""
    return Q.table_health(_log(read))


@query(f"WITH {_LOG_SQL} SELECT table_name, count(*) AS checked, count(*) FILTER (WHERE NOT passed) AS failed, CAST(1 - count(*) FILTER (WHERE NOT passed) / count(*) AS DECIMAL(10,6)) AS score FROM log GROUP BY 1")
def dq_pass_rate_score(spark, read) -> DataFrame:
    """The share of checks that pass."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("passed"))
    return _log(read).groupBy("table_name").agg(n.alias("checked"), bad.alias("failed"), (1 - bad / n).cast("decimal(10,6)").alias("score"))


_FEEDS_SQL = "l AS (SELECT o_custkey AS client_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_custkey AS client_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 3 <> 1)"


def _feeds(read):
    o = read("orders").select("o_orderkey", F.col("o_custkey").alias("client_id"), money("o_totalprice").alias("amount"))
    return o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1")


@query(f"""WITH {_FEEDS_SQL}, d AS (SELECT *, 'missing_right' AS discrepancy_type FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'missing_left' FROM (SELECT * FROM r EXCEPT SELECT * FROM l))
SELECT 'feed' AS reconciliation_name, '{{"client_id":"' || client_id || '","amount":"' || amount || '"}}' AS natural_key, client_id, amount, discrepancy_type FROM d""")
def recon_discrepancies(spark, read) -> DataFrame:
    return Q.reconcile(*_feeds(read), "feed", ["client_id", "amount"])


@query(f"WITH {_FEEDS_SQL} SELECT client_id, 'missing_right' AS discrepancy_type FROM (SELECT client_id FROM l EXCEPT ALL SELECT client_id FROM r) UNION ALL SELECT client_id, 'missing_left' FROM (SELECT client_id FROM r EXCEPT ALL SELECT client_id FROM l)")
def recon_multiset(spark, read) -> DataFrame:
    return Q.reconcile_multiset(*_feeds(read), ["client_id"])


@query(f"WITH {_FEEDS_SQL} SELECT count(*) AS matches FROM (SELECT * FROM l INTERSECT SELECT * FROM r)")
def recon_matches(spark, read) -> DataFrame:
    """The positive control: keys in both feeds."""
    left, right = (f.select("client_id", "amount") for f in _feeds(read))
    return left.intersect(right).agg(F.count(F.lit(1)).alias("matches"))

"""Query registry and the views that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function (spark, read) under its name; ``read(table)`` gives a DataFrame."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def money(column) -> F.Column:
    """A double amount as a decimal; sums of decimals don't depend on order."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("decimal(18,2)")


def micros(column) -> F.Column:
    """A timestamp as microseconds since 1970, UTC."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


#: The change log: clients are users, lsn the event number, arrival shuffled within blocks of eight.
CDC_SQL = """cdc AS (SELECT user_id AS client_id, event_id + 1 AS lsn, ts AS commit_ts, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, (event_id - event_id % 8) + (event_id * 5) % 8 AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100) AS BIGINT) AS cents, event_type FROM events)"""
ATTRIBUTES_SQL = "CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_category, cents AS account_balance_usd, event_type AS account_status"
HISTORY_SQL = (
    CDC_SQL
    + f""",
j0 AS (SELECT *, {ATTRIBUTES_SQL}, op = 'delete' AND NOT coalesce(max(CASE WHEN op <> 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS lost FROM cdc),
j1 AS (SELECT *, CASE WHEN lost THEN 'delete_with_no_baseline' WHEN lsn <= coalesce(max(CASE WHEN lost THEN NULL ELSE lsn END) OVER (PARTITION BY client_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 'stale_lsn' END AS reason FROM j0),
acc AS (SELECT *, count(CASE WHEN op <> 'delete' THEN 1 END) OVER (PARTITION BY client_id ORDER BY lsn) AS grp FROM j1 WHERE reason IS NULL),
versions AS (SELECT client_id, lsn AS source_lsn, max(CASE WHEN op <> 'delete' THEN risk_category END) OVER (PARTITION BY client_id, grp) AS risk_category, max(CASE WHEN op <> 'delete' THEN account_balance_usd END) OVER (PARTITION BY client_id, grp) AS account_balance_usd, CASE WHEN op = 'delete' THEN 'deleted' ELSE account_status END AS account_status, commit_ts AS valid_from, coalesce(lead(commit_ts) OVER (PARTITION BY client_id ORDER BY lsn), TIMESTAMP '9999-12-31 00:00:00') AS valid_to, lead(commit_ts) OVER (PARTITION BY client_id ORDER BY lsn) IS NULL AS is_current, op = 'delete' AS is_deleted FROM acc)"""
)


def cdc_events(read) -> DataFrame:
    e = read("events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(F.col("user_id").alias("client_id"), (F.col("event_id") + 1).alias("lsn"), F.col("ts").alias("commit_ts"), op.alias("op"), ((F.col("event_id") - F.col("event_id") % 8) + (F.col("event_id") * 5) % 8).alias("seq"), F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("risk_category"), F.floor(F.col("value") * 100).cast("bigint").alias("account_balance_usd"), F.col("event_type").alias("account_status"))


def no_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "client_id bigint, risk_category string, account_balance_usd bigint, account_status string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, is_deleted boolean, source_lsn bigint")


def no_watermark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "client_id bigint, last_applied_lsn bigint")


def shown(versions: DataFrame) -> DataFrame:
    return versions.select("client_id", "source_lsn", "risk_category", "account_balance_usd", "account_status", micros("valid_from").alias("valid_from_us"), micros("valid_to").alias("valid_to_us"), "is_current", "is_deleted")


SHOWN_SQL = "SELECT client_id, source_lsn, risk_category, account_balance_usd, account_status, epoch_us(valid_from) AS valid_from_us, epoch_us(valid_to) AS valid_to_us, is_current, is_deleted FROM versions"

"""Data-quality checks, their log and health view, and reconciliation of feeds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """``failing`` is true for rows that break it; null counts as not failing, as nulls are a check of their own."""

    name: str
    severity: str
    failing: Column


def between(column: str, low=None, high=None, severity: str = "CRITICAL") -> Expectation:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return Expectation(f"expect_column_values_to_be_between:{column}", severity, bad)


def not_null(column: str, severity: str = "CRITICAL") -> Expectation:
    return Expectation(f"expect_column_values_to_not_be_null:{column}", severity, F.col(column).isNull())


def in_set(column: str, values: Sequence, severity: str = "WARNING") -> Expectation:
    return Expectation(f"expect_column_values_to_be_in_set:{column}", severity, F.col(column).isNotNull() & ~F.col(column).isin(*values))


def run_suite(rows: DataFrame, table_name: str, suite: Sequence[Expectation]) -> DataFrame:
    """A result row per expectation, all counted in one pass over the rows."""
    counts = rows.agg(*[F.count_if(e.failing).alias(f"c{i}") for i, e in enumerate(suite)], F.count(F.lit(1)).alias("n"))
    entries = F.array(*[F.struct(F.lit(e.name).alias("check_name"), F.lit(e.severity).alias("severity"), F.col(f"c{i}").alias("unexpected_count"), F.col("n").alias("checked")) for i, e in enumerate(suite)])
    return counts.select(F.explode(entries).alias("e")).select(F.lit(table_name).alias("table_name"), "e.check_name", "e.severity", (F.col("e.unexpected_count") == 0).alias("passed"), "e.unexpected_count", "e.checked")


def run_assertions(spark: SparkSession, table_name: str, checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(name, severity, sql): each statement gives the number of failing rows; all run as one job."""
    parts = [f"SELECT '{table_name}' AS table_name, '{name}' AS check_name, '{severity}' AS severity, CAST(({sql}) AS BIGINT) AS unexpected_count" for name, severity, sql in checks]
    return spark.sql(" UNION ALL ".join(parts)).withColumn("passed", F.col("unexpected_count") == 0)


def quarantine_summaries(results: DataFrame) -> DataFrame:
    """A summary row for each failed CRITICAL check; loading goes on."""
    failed = results.filter("NOT passed AND severity = 'CRITICAL'")
    return failed.select("table_name", F.col("check_name").alias("reason_code"), "severity", F.to_json(F.struct("check_name", "unexpected_count")).alias("raw_payload"))


def split_critical(rows: DataFrame, suite: Sequence[Expectation]) -> tuple[DataFrame, DataFrame]:
    """(rows that may load, rows that break a CRITICAL expectation): the opt-in row-level mode."""
    bad = F.lit(False)
    for e in suite:
        if e.severity == "CRITICAL":
            bad = bad | F.coalesce(e.failing, F.lit(False))
    return rows.filter(~bad), rows.filter(bad)


def append_log(log: DataFrame, results: DataFrame, run_id: str, executed_at: Column) -> DataFrame:
    """The log with a run's results; results of the same run, table and check are replaced."""
    new = results.withColumn("run_id", F.lit(run_id)).withColumn("executed_at", executed_at).select(*log.columns)
    return log.join(new.select("run_id", "table_name", "check_name"), ["run_id", "table_name", "check_name"], "left_anti").unionByName(new)


def table_health(log: DataFrame) -> DataFrame:
    """Failed checks of each table and run against the run before."""
    runs = log.groupBy("table_name", "run_id").agg(F.min("executed_at").alias("run_at"), F.count_if(~F.col("passed")).alias("failed_checks"), F.count(F.lit(1)).alias("total_checks"))
    before = F.lag("failed_checks").over(Window.partitionBy("table_name").orderBy("run_at"))
    return runs.withColumn("prev_failed_checks", before).withColumn("is_regression", F.coalesce(F.col("failed_checks") > F.col("prev_failed_checks"), F.lit(False)))


def reconcile(left: DataFrame, right: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Two-way set difference of the keys, null equal to null: ``missing_right`` and ``missing_left``."""
    left, right = left.select(*keys), right.select(*keys)
    tagged = left.subtract(right).withColumn("discrepancy_type", F.lit("missing_right")).unionByName(right.subtract(left).withColumn("discrepancy_type", F.lit("missing_left")))
    return tagged.select(F.lit(name).alias("reconciliation_name"), F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])).alias("natural_key"), *keys, "discrepancy_type")


def reconcile_multiset(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``reconcile``, with repeated keys counted."""
    left, right = left.select(*keys), right.select(*keys)
    return left.exceptAll(right).withColumn("discrepancy_type", F.lit("missing_right")).unionByName(right.exceptAll(left).withColumn("discrepancy_type", F.lit("missing_left")))


def replace_report(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A run's report replaces the one of the same name and run."""
    return existing.join(new.select("reconciliation_name", "run_id").distinct(), ["reconciliation_name", "run_id"], "left_anti").unionByName(new)

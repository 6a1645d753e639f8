"""Dimensions, foreign keys, as-of joins and fact loads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.rows import calendar, mapped, surrogate_key

OPEN_END = "9999-12-31 00:00:00"


def derived_dimension(rows: DataFrame, source: str, natural_key: str, key: str, attributes: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Distinct non-null values of a column as a dimension, with attributes looked up in value maps."""
    values = rows.select(F.col(source).cast("string").alias(natural_key)).filter(F.col(natural_key).isNotNull()).distinct()
    for name, values_map in (attributes or {}).items():
        values = values.withColumn(name, mapped(F.col(natural_key), values_map, f"{name} of {natural_key}"))
    return values.withColumn(key, surrogate_key(F.col(natural_key)))


def generated_dates(spark, first: str, last: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d"))
    return days.select(*[c.alias(n) for n, c in calendar(F.col("d")).items()])


def lookup_key(facts: DataFrame, dim: DataFrame, fact_col: str, natural_key: str, key: str, out: str, nullable: bool = True) -> DataFrame:
    """The surrogate key for a natural key: a miss is an error; a null stays null or is an error. Adaptive execution broadcasts the
    dimension where its measured size allows."""
    d = dim.select(F.col(natural_key).alias("__nk"), F.col(key).alias("__sk"))
    joined = facts.join(d, facts[fact_col] == d["__nk"], "left")
    miss = F.raise_error(F.concat(F.lit(f"{fact_col}: no {natural_key} "), F.col(fact_col).cast("string"))).cast("bigint")
    empty = F.lit(None).cast("bigint") if nullable else F.raise_error(F.lit(f"{fact_col} is null")).cast("bigint")
    return joined.withColumn(out, F.when(F.col("__sk").isNotNull(), F.col("__sk")).when(F.col(fact_col).isNull(), empty).otherwise(miss)).drop("__nk", "__sk")


def inferred_members(facts: DataFrame, dim: DataFrame, fact_key: str, natural_key: str) -> DataFrame:
    """Stubs (natural key, is_inferred) for the clients of facts that the dimension lacks."""
    asked = facts.select(F.col(fact_key).alias(natural_key)).filter(F.col(natural_key).isNotNull()).distinct()
    return asked.join(dim.select(natural_key), natural_key, "left_anti").withColumn("is_inferred", F.lit(True))


def asof_range(facts: DataFrame, versions: DataFrame, client: str, at: Column, take: Sequence[str]) -> DataFrame:
    """The version valid at ``at`` (from inclusive, to exclusive), nulls on a miss: an equi-join on the client with the range as
    residual. Right where clients have few versions."""
    v = versions.select(F.col("client_id").alias("__c"), F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t"), *take)
    return facts.withColumn("__at", at).join(v, (F.col(client) == F.col("__c")) & (F.col("__f") <= F.col("__at")) & (F.col("__t") > F.col("__at")), "left").drop("__c", "__f", "__t", "__at")


def asof_window(facts: DataFrame, versions: DataFrame, client: str, at: Column, take: Sequence[str]) -> DataFrame:
    """The same result for sides of any size: union, sort by client and time, carry the last version forward. No rows multiply."""
    columns = facts.columns
    f = facts.select(F.col(client).alias("__c"), at.alias("__at"), F.lit(1).alias("__kind"), F.struct(*columns).alias("__fact"), F.lit(None).cast(versions.select(F.struct("valid_to", *take)).schema[0].dataType).alias("__v"))
    v = versions.select(F.col("client_id").alias("__c"), F.col("valid_from").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(f.schema["__fact"].dataType).alias("__fact"), F.struct("valid_to", *take).alias("__v"))
    w = Window.partitionBy("__c").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    held = f.unionByName(v).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1")
    valid = F.col("__last.valid_to") > F.col("__at")
    return held.select("__fact.*", *[F.when(valid, F.col(f"__last.{c}")).alias(c) for c in take])


def stopgaps(missed: DataFrame, versions: DataFrame, client: str = "client_id", at: str = "event_ts") -> DataFrame:
    """A version of a microsecond for each missed (client, time) of clients without real history (source_lsn >= 0), numbered
    below the client's least lsn; clients with real history are an error."""
    real = versions.filter("source_lsn >= 0").select("client_id").distinct().withColumn("__real", F.lit(True))
    low = versions.groupBy("client_id").agg(F.min("source_lsn").alias("__low"))
    asked = missed.select(F.col(client).alias("client_id"), F.col(at).alias("valid_from")).distinct().join(real, "client_id", "left").join(low, "client_id", "left")
    checked = asked.filter(F.when(F.col("__real").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("no version valid for client "), F.col("client_id").cast("string"))).cast("boolean")))
    nth = F.row_number().over(Window.partitionBy("client_id").orderBy("valid_from"))
    # the least lsn of a client without rows counts as 0
    return checked.select("client_id", "valid_from", (F.col("valid_from") + F.expr("interval 1 microsecond")).alias("valid_to"), (F.least(F.coalesce("__low", F.lit(0)), F.lit(0)) - nth).cast("bigint").alias("source_lsn"), F.lit("unknown").alias("risk_category"), F.lit(0).cast("decimal(14,2)").alias("account_balance_usd"), F.lit("unknown").alias("account_status"), F.lit(False).alias("is_current"), F.lit(False).alias("is_deleted"))


def fact_rows(staged: DataFrame, dim_client: DataFrame, versions: DataFrame, client: str, event_date: str, literals: Mapping[str, str] | None = None, lookups: Sequence[tuple[DataFrame, str, str, str, str, bool]] = ()) -> DataFrame:
    """Facts with all keys: the client's, the snapshot's at midnight UTC of the event date, the date's, plain dimensions' (dimension, fact
    column, natural key, key, name, nullable), literals. No client's facts are multiplied by its versions."""
    out = lookup_key(staged, dim_client, client, "client_id", "client_key", "client_key", nullable=False)
    out = asof_window(out, versions, client, F.col(event_date).cast("timestamp"), ["risk_snapshot_key"])
    out = out.withColumn("date_key", F.date_format(event_date, "yyyyMMdd").cast("int"))
    for dim, column, natural_key, key, name, nullable in lookups:
        out = lookup_key(out, dim, column, natural_key, key, name, nullable)
    for name, value in (literals or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out

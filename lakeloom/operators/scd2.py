"""Change-data capture into slowly-changing history, as windows over each client's events.

Events: client_id, lsn, commit_ts, op (insert, update, delete), seq (arrival order), and the attributes. Versions: client_id,
attributes, valid_from, valid_to, is_current, is_deleted, source_lsn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("risk_category", "account_balance_usd", "account_status")


@dataclass(frozen=True)
class Applied:
    versions: DataFrame
    quarantine: DataFrame
    watermark: DataFrame


def unapplied(events: DataFrame, watermark: DataFrame) -> DataFrame:
    """Events above their client's watermark."""
    w = watermark.select(F.col("client_id").alias("__c"), F.col("last_applied_lsn").alias("__last"))
    return events.join(w, (F.col("client_id") == F.col("__c")) & (F.col("lsn") <= F.col("__last")), "left_anti")


def judge(events: DataFrame, versions: DataFrame, watermark: DataFrame, order: str = "seq") -> DataFrame:
    """The events with ``reason``: null if accepted, else ``delete_with_no_baseline`` or ``stale_lsn``."""
    based = versions.select("client_id").distinct().withColumn("__stored", F.lit(True))
    marks = watermark.select("client_id", F.col("last_applied_lsn").alias("__mark"))
    before = Window.partitionBy("client_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    e = events.join(based, "client_id", "left").join(marks, "client_id", "left")
    has_base = F.coalesce("__stored", F.lit(False)) | F.coalesce(F.max(F.col("op") != "delete").over(before), F.lit(False))
    e = e.withColumn("__lost", (F.col("op") == "delete") & ~has_base)
    # a rejected lsn never exceeds the mark, so the running maximum over all others is that of the accepted
    high = F.greatest(F.coalesce("__mark", F.lit(0)), F.coalesce(F.max(F.when(~F.col("__lost"), F.col("lsn"))).over(before), F.lit(0)))
    e = e.withColumn("reason", F.when(F.col("__lost"), "delete_with_no_baseline").when(F.col("lsn") <= high, "stale_lsn"))
    return e.drop("__stored", "__mark", "__lost")


def history(accepted: DataFrame, stored: DataFrame, attributes: Sequence[str] = ATTRIBUTES, end: str = "9999-12-31 00:00:00") -> DataFrame:
    """Versions from stored ones and accepted events: each is valid until the next one's time. A tombstone carries the last attributes
    forward, and only a tombstone does: a partial change must not hide behind older values. Stopgaps (lsn < 0) stay as they are."""
    columns = ["client_id", *attributes, "valid_from", "is_deleted", "source_lsn"]
    new = accepted.select("client_id", *[F.when(F.col("op") != "delete", F.col(a)).alias(a) for a in attributes], F.col("commit_ts").alias("valid_from"), (F.col("op") == "delete").alias("is_deleted"), F.col("lsn").alias("source_lsn"))
    real = stored.filter("source_lsn >= 0").select(*columns).withColumn("__fresh", F.lit(False)).unionByName(new.withColumn("__fresh", F.lit(True)))
    w = Window.partitionBy("client_id").orderBy("source_lsn")
    carried = F.last(F.when(~(F.col("is_deleted") & F.col("__fresh")), F.struct(*attributes)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tomb = F.col("is_deleted") & F.col("__fresh")
    out = real.withColumn("__carried", carried).withColumn("__next", F.lead("valid_from").over(w))
    picked = [F.when(tomb, F.lit("deleted") if a == "account_status" else F.col(f"__carried.{a}")).otherwise(F.col(a)).alias(a) for a in attributes]
    kind = real.schema["valid_from"].dataType
    out = out.select("client_id", *picked, "valid_from", F.coalesce("__next", F.lit(end).cast(kind)).alias("valid_to"), F.col("__next").isNull().alias("is_current"), "is_deleted", "source_lsn")
    return out.unionByName(stored.filter("source_lsn < 0").select(*out.columns))


def apply(events: DataFrame, versions: DataFrame, watermark: DataFrame, attributes: Sequence[str] = ATTRIBUTES, order: str = "seq") -> Applied:
    """Apply the events not yet applied, in arrival order."""
    judged = judge(unapplied(events, watermark), versions, watermark, order)
    accepted, rejected = judged.filter("reason is null"), judged.filter("reason is not null")
    severity = F.when(F.col("reason") == "stale_lsn", "INFO").otherwise("WARNING")
    quarantine = rejected.select(F.lit("client_profile_changes").alias("table_name"), F.col("reason").alias("reason_code"), severity.alias("severity"), F.to_json(F.struct("client_id", "lsn", "op")).alias("raw_payload"), "client_id", "lsn")
    marks = accepted.groupBy("client_id").agg(F.max("lsn").alias("last_applied_lsn")).unionByName(watermark.select("client_id", "last_applied_lsn"))
    return Applied(history(accepted, versions, attributes), quarantine, marks.groupBy("client_id").agg(F.max("last_applied_lsn").alias("last_applied_lsn")))


def first_ops(events: DataFrame, order: str = "lsn") -> DataFrame:
    """(client_id, op): each client's earliest operation by lsn, or by arrival (``order='seq'``)."""
    return events.groupBy("client_id").agg(F.min_by("op", order).alias("op"))


def baseline(profiles: DataFrame, events: DataFrame, versions: DataFrame, start: str = "1970-01-01 00:00:00", end: str = "9999-12-31 00:00:00") -> DataFrame:
    """Version 0 of every profiled client, but for clients whose first operation is an insert and those with history. Clients
    known by stopgaps alone get one of unknown values. Returns the versions with their stopgaps cleared."""
    excluded = first_ops(events).filter("op = 'insert'").select("client_id")
    has = versions.filter("source_lsn > 0").select("client_id").distinct()
    already = versions.filter("source_lsn = 0").select("client_id")
    seeds = profiles.select("client_id", *ATTRIBUTES).join(excluded, "client_id", "left_anti").join(has, "client_id", "left_anti").join(already, "client_id", "left_anti")
    orphans = versions.filter("source_lsn < 0").select("client_id").distinct().join(profiles.select("client_id"), "client_id", "left_anti").join(excluded, "client_id", "left_anti").join(already, "client_id", "left_anti")
    unknown = orphans.select("client_id", F.lit("unknown").alias("risk_category"), F.lit(0).cast(profiles.schema["account_balance_usd"].dataType).alias("account_balance_usd"), F.lit("unknown").alias("account_status"))
    kind = versions.schema["valid_from"].dataType
    new = seeds.unionByName(unknown).select("client_id", *ATTRIBUTES, F.lit(start).cast(kind).alias("valid_from"), F.lit(end).cast(kind).alias("valid_to"), F.lit(True).alias("is_current"), F.lit(False).alias("is_deleted"), F.lit(0).cast("bigint").alias("source_lsn"))
    seeded = new.select("client_id").unionByName(already)
    stay = versions.filter("source_lsn >= 0").unionByName(versions.filter("source_lsn < 0").join(seeded, "client_id", "left_anti"))
    return stay.select(*new.columns).unionByName(new)


def reload(events: DataFrame, versions: DataFrame, watermark: DataFrame, start, stop, attributes: Sequence[str] = ATTRIBUTES) -> tuple[Applied, DataFrame]:
    """Rebuild the history of clients with an event in ``[start, stop)``: versions from the first such lsn on go, and all events from it
    on are replayed in lsn order. Returns the result and (client_id, reset_lsn) of the clients concerned."""
    affected = events.filter((F.col("commit_ts") >= start) & (F.col("commit_ts") < stop)).groupBy("client_id").agg(F.min("lsn").alias("reset_lsn"))
    # history is worked out for the clients concerned alone; the others pass as they are
    own, others = (lambda df: df.join(affected, "client_id")), (lambda df: df.join(affected, "client_id", "left_anti"))
    kept = own(versions).filter("source_lsn < reset_lsn").drop("reset_lsn").select(*versions.columns)
    marks = own(watermark).select("client_id", (F.col("reset_lsn") - 1).alias("last_applied_lsn"))
    replay = own(events).filter("lsn >= reset_lsn").drop("reset_lsn").withColumn("seq", F.col("lsn"))
    done = apply(replay, kept, marks, attributes)
    rest = others(versions).select(*done.versions.columns)
    return Applied(done.versions.unionByName(rest), done.quarantine, done.watermark.unionByName(others(watermark).select(*done.watermark.columns))), affected


def state_lines(versions: DataFrame) -> DataFrame:
    """A line per real version, for comparing states."""
    real = versions.filter("source_lsn >= 0")
    return real.select(F.concat_ws("|", "client_id", F.col("source_lsn").cast("string"), *[F.col(a).cast("string") for a in ATTRIBUTES], F.col("is_current").cast("string"), F.col("is_deleted").cast("string")).alias("line"))

"""Merges by natural key, each as a plan that rebuilds the table: parquet has no MERGE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregation, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*rows.columns)


def overwrite(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key (incoming keys are unique)."""
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming.select(*existing.columns))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def staging_merge(rows: DataFrame, keys: Sequence[str], update_columns: Sequence[str], flags: Sequence[str], order: Sequence[str], present: dict[str, str] | None = None) -> DataFrame:
    """Fold the deliveries of each key in ``order``: update columns take the last value that is present (``present`` names the column
    that tells), flags are or-ed, all other columns keep their first value."""
    present = present or {}
    aggs = []
    place = F.struct(*order)
    for c in rows.columns:
        if c in keys or c in order or c in present.values():
            continue
        if c in flags:
            aggs.append(F.bool_or(c).alias(c))
        elif c in update_columns:
            at = F.when(F.col(present[c]), place) if c in present else place
            aggs.append(F.coalesce(F.max_by(F.struct(F.col(c).alias("v")), at)["v"], F.min_by(F.struct(F.col(c).alias("v")), place)["v"]).alias(c) if c in present else F.max_by(F.struct(F.col(c).alias("v")), place)["v"].alias(c))
        else:
            aggs.append(F.min_by(F.struct(F.col(c).alias("v")), place)["v"].alias(c))
    return rows.groupBy(*keys).agg(*aggs)


def with_noop_detection(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], tracked: Sequence[str], stamp: str = "staged_at", now=None) -> DataFrame:
    """``incoming`` with the existing ``stamp`` where no tracked column is distinct from before, else ``now``."""
    old = existing.select(*keys, F.struct(*tracked).alias("__old"), F.col(stamp).alias("__at"))
    changed = F.col("__old").isNull() | ~F.struct(*tracked).eqNullSafe(F.col("__old"))
    return incoming.join(old, list(keys), "left").withColumn(stamp, F.when(changed, F.current_timestamp() if now is None else now).otherwise(F.col("__at"))).drop("__old", "__at")


def owned_upsert(existing: DataFrame, incoming: DataFrame, key: str, owned: Sequence[str]) -> DataFrame:
    """A source overwrites only the columns that it owns; new keys get null elsewhere and stubs become real."""
    new = incoming.select(key, F.struct(*owned).alias("__new"))
    both = existing.join(new, key, "full_outer")
    columns = [F.col(key)]
    for c in existing.columns:
        if c == key:
            continue
        if c in owned:
            columns.append(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c))
        elif c == "is_inferred":
            columns.append(F.when(F.col("__new").isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return both.select(*columns)


def with_ordinals(rows: DataFrame, order: Sequence[str], name: str = "raw_seq") -> DataFrame:
    """Arrival ordinals 1, 2, ... over all rows, without bringing them into one task: ranges of the order, sizes of the ranges, and a
    number within each range."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(before, "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", "__part")


def assert_unique(rows: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows, which fail when read if a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("__n", n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: duplicate key "), F.to_json(F.struct(*keys)))).cast("boolean"))).drop("__n")


def assert_not_null(rows: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{what}: null in {c}")).cast(rows.schema[c].dataType)))
    return rows

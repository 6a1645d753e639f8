"""Streams: the change log applied in micro-batches against stored state, and a velocity check over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import scd2


def apply_stream(events: DataFrame, load, save, checkpoint: str):
    """Apply a stream of events. ``load()`` gives (versions, watermark), ``save(Applied)`` stores the new state; the watermark
    makes a repeated micro-batch do nothing."""

    def one(batch: DataFrame, _: int) -> None:
        versions, marks = load()
        save(scd2.apply(batch, versions, marks))

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def velocity(events: DataFrame, most: int, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(client_id, window, n) of clients with over ``most`` events in a window; events later than ``late`` are left out."""
    counts = events.withWatermark("commit_ts", late).groupBy("client_id", F.window("commit_ts", window)).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > most)

"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive plans; on a cluster ``master`` and sizes come from spark-submit instead."""
    builder = SparkSession.builder.master(master).appName("lakeloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

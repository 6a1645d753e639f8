from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lakeloom.operators import scd2
from lakeloom.queries.registry import cdc_events, no_versions, no_watermark
from lakeloom.streaming.cdc import apply_stream, velocity

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = scd2.apply(cdc_events(lambda n: spark.read.parquet(f"{SF}/{n}.parquet")), no_versions(spark), no_watermark(spark))
    events = cdc_events(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))
    half = 496
    events.filter(F.col("seq") < half).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    events.filter(F.col("seq") >= half).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    state = {"n": 0}

    def load():
        if not state["n"]:
            return no_versions(spark), no_watermark(spark)
        return spark.read.parquet(f"{tmp_path}/v{state['n']}"), spark.read.parquet(f"{tmp_path}/w{state['n']}")

    def save(done):
        n = state["n"] + 1
        done.versions.write.parquet(f"{tmp_path}/v{n}")
        done.watermark.write.parquet(f"{tmp_path}/w{n}")
        state["n"] = n

    for part in (1, 2):
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/{part}")
        apply_stream(stream, load, save, f"{tmp_path}/cp{part}").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/v{state['n']}")
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, batch.versions.select(*sorted(got.columns)).collect()))


def test_velocity(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t + datetime.timedelta(seconds=i)) for i in range(5)] + [(2, t), (3, t + datetime.timedelta(days=1))]
    spark.createDataFrame(rows, "client_id int, commit_ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client_id int, commit_ts timestamp").parquet(f"{tmp_path}/in")
    q = velocity(stream, 3).writeStream.format("memory").queryName("velocity").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["client_id"], r["n"]) for r in spark.table("velocity").collect()] == [(1, 5)]

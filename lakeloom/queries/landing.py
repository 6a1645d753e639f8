"""Landing, drift, casts and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import rows as R
from lakeloom.operators import merge, quality
from lakeloom.queries.registry import CDC_SQL, micros, money, query

_FULL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_ORDER_SQL = ", ".join(_FULL_ORDER)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _FULL_ORDER)}) AS rn FROM lineitem) WHERE rn = 1")
def raw_land_last_wins(spark, read) -> DataFrame:
    """Of several deliveries of a key the last one stays."""
    rows = read("lineitem").select("l_orderkey", "l_linenumber", *_FULL_ORDER)
    return merge.last_wins(rows, ["l_orderkey", "l_linenumber"], _FULL_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_quantity").alias("quantity"))


_TWO_FILES_SQL = """d AS (SELECT o_orderkey AS k, 0 AS f, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, false AS drift FROM orders UNION ALL SELECT o_orderkey, 1, 'redelivered', CAST(o_totalprice AS DECIMAL(18,2)) + 1, o_orderkey % 2 = 0 FROM orders WHERE o_orderkey % 3 = 0)"""


def _two_files(read) -> DataFrame:
    o = read("orders")
    first = o.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("f"), F.col("o_orderstatus").alias("status"), money("o_totalprice").cast("decimal(19,2)").alias("amount"), F.lit(False).alias("drift"))
    second = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("f"), F.lit("redelivered").alias("status"), (money("o_totalprice") + 1).cast("decimal(19,2)").alias("amount"), (F.col("o_orderkey") % 2 == 0).alias("drift"))
    return first.unionByName(second)


@query(f"WITH {_TWO_FILES_SQL} SELECT k, arg_max(status, f) AS status, CAST(arg_min(amount, f) AS DECIMAL(19,2)) AS amount, bool_or(drift) AS drift FROM d GROUP BY k")
def staging_merge_sticky(spark, read) -> DataFrame:
    """Update columns take the last delivery, others keep the first, flags stay set."""
    return merge.staging_merge(_two_files(read), ["k"], ["status"], ["drift"], ["f"]).select("k", "status", "amount", "drift")


@query(f"WITH {_TWO_FILES_SQL}, old AS (SELECT * FROM d WHERE f = 0), new AS (SELECT k, arg_max(status, f) AS status, arg_max(amount, f) AS amount FROM d GROUP BY k) SELECT CASE WHEN old.status IS DISTINCT FROM new.status OR old.amount IS DISTINCT FROM new.amount THEN 2 ELSE 1 END AS staged_at, count(*) AS n FROM new LEFT JOIN old USING (k) GROUP BY 1")
def staging_noop_detect(spark, read) -> DataFrame:
    """The stamp moves only for rows that changed."""
    both = _two_files(read)
    old = both.filter("f = 0").select("k", "status", "amount").withColumn("staged_at", F.lit(1))
    new = merge.staging_merge(both, ["k"], ["status", "amount"], ["drift"], ["f"]).select("k", "status", "amount")
    return merge.with_noop_detection(old, new, ["k"], ["status", "amount"], now=F.lit(2)).groupBy("staged_at").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TWO_FILES_SQL}, old AS (SELECT * FROM d WHERE f = 0), new AS (SELECT * FROM d WHERE f = 1) SELECT k, status FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, status FROM new")
def merge_overwrite(spark, read) -> DataFrame:
    """Keyed overwrite: an incoming row replaces the row of its key."""
    both = _two_files(read).select("k", "f", "status")
    return merge.overwrite(both.filter("f = 0").drop("f"), both.filter("f = 1").drop("f"), ["k"])


@query("SELECT c_custkey, c_name FROM customer")
def merge_insert_absent(spark, read) -> DataFrame:
    """Only absent keys are inserted."""
    c = read("customer").select("c_custkey", "c_name")
    return merge.insert_absent(c.filter("c_custkey % 4 <> 0"), c.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise("x")), ["c_custkey"])


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS raw_seq FROM events")
def arrival_ordinals(spark, read) -> DataFrame:
    """Ordinals over all rows from ranges and their sizes, in parallel."""
    return merge.with_ordinals(read("events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "raw_seq")


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['k', 'method'] WHEN 1 THEN ['k', 'payment_method'] WHEN 2 THEN ['k'] ELSE ['k', 'payment_method', 'extra'] END AS keys, event_type AS v FROM events)
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1, 3) THEN v END AS payment_method, event_id % 4 IN (0, 3) AS drift, CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS n_unrecognised FROM p""")
def drift_resolution(spark, read) -> DataFrame:
    """Aliases resolve and count as drift, unknown keys too; missing keys don't."""
    e, kind = read("events"), F.col("event_id") % 4
    k, v = F.lit("k"), F.col("event_type")
    payload = F.when(kind == 0, F.create_map(k, v, F.lit("method"), v)).when(kind == 1, F.create_map(k, v, F.lit("payment_method"), v)).when(kind == 2, F.create_map(k, v)).otherwise(F.create_map(k, v, F.lit("payment_method"), v, F.lit("extra"), v))
    expected, aliases = ["k", "payment_method"], {"method": "payment_method"}
    e = e.select("event_id", payload.alias("payload"))
    return e.select("event_id", R.canonical(F.col("payload"), expected, aliases)["payment_method"].alias("payment_method"), R.drifted(F.col("payload"), expected).alias("drift"), F.size(R.unrecognised(F.col("payload"), expected, aliases)).alias("n_unrecognised"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 6 > 2 AS is_late FROM lineitem")
def late_arrival_flag(spark, read) -> DataFrame:
    """Delivery dates come from file names."""
    rows = read("lineitem").withColumn("day", F.to_date("l_shipdate"))
    name = F.concat(F.lit("feed_"), F.date_format(F.date_add("day", (F.col("l_orderkey") % 6).cast("int")), "yyyyMMdd"), F.lit(".csv"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.late(name, F.col("day"), r"feed_(\d{8})\.csv", 2).alias("is_late"))


@query("SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS DECIMAL(14,2)) AS amount_usd, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date FROM orders")
def typed_cast_decimal(spark, read) -> DataFrame:
    """Strings cast to declared types; a malformed value fails the batch."""
    o = read("orders").select("o_orderkey", money("o_totalprice").cast("string").alias("amount"), F.to_date("o_orderdate").cast("string").alias("day"))
    return o.select("o_orderkey", F.col("amount").cast("decimal(14,2)").alias("amount_usd"), F.col("day").cast("date").cast("string").alias("order_date"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, read) -> DataFrame:
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT 'orders' AS table_name, 'negative_balance' AS reason_code, '{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || '}' AS raw_payload FROM customer WHERE c_acctbal < 0")
def json_build_quarantine(spark, read) -> DataFrame:
    """Rejected rows with their payload as JSON."""
    bad = read("customer").filter("c_acctbal < 0")
    return bad.select(F.lit("orders").alias("table_name"), F.lit("negative_balance").alias("reason_code"), F.to_json(F.struct("c_custkey", "c_nationkey")).alias("raw_payload"))


_CLASSES = {"0": "FX", "1": "Commodity", "2": "Crypto", "3": "Index"}


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'FX' WHEN 1 THEN 'Commodity' WHEN 2 THEN 'Crypto' ELSE 'Index' END AS asset_class FROM part")
def value_map_asset_class(spark, read) -> DataFrame:
    return read("part").select("p_partkey", R.mapped((F.col("p_partkey") % 4).cast("string"), _CLASSES, "asset class").alias("asset_class"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'vendor' ELSE 'internal' END AS source_system FROM orders")
def literal_source_tag_union(spark, read) -> DataFrame:
    """Two feeds with disjoint keys, tagged and united."""
    o = read("orders").select("o_orderkey", money("o_totalprice").alias("amount"))
    return o.filter("o_orderkey % 2 = 0").withColumn("source_system", F.lit("vendor")).unionByName(o.filter("o_orderkey % 2 <> 0").withColumn("source_system", F.lit("internal")))


@query(f"WITH {CDC_SQL} SELECT client_id, lsn, epoch_us(commit_ts) AS commit_us, op, seq FROM cdc")
def typed_passthrough(spark, read) -> DataFrame:
    """A typed feed is copied with its arrival order."""
    from lakeloom.queries.registry import cdc_events

    return cdc_events(read).select("client_id", "lsn", micros("commit_ts").alias("commit_us"), "op", "seq")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def key_uniqueness(spark, read) -> DataFrame:
    """Keys and repeated keys: the constraint check as a report."""
    n = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") > 1).alias("repeated"))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer WHERE c_acctbal >= 0")
def load_without_critical(spark, read) -> DataFrame:
    """Opt-in row-level mode: rows that break a CRITICAL expectation don't load."""
    good, _ = quality.split_critical(read("customer"), [quality.between("c_acctbal", 0)])
    return good.select("c_custkey", money("c_acctbal").alias("balance"))

"""Dimensions, facts, as-of joins and star rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakeloom.functions.rows import surrogate_key
from lakeloom.operators import merge, star
from lakeloom.queries.registry import CDC_SQL, HISTORY_SQL, cdc_events, micros, money, no_versions, no_watermark, query
from lakeloom.operators import scd2

_NET = "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2)) AS DECIMAL(18,4))"


def _net():
    kept = (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")).cast("decimal(4,2)")
    return (F.col("l_extendedprice").cast("decimal(14,2)") * kept).cast("decimal(18,4)")


@query("SELECT p_type, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS gross, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS volume, count(*) AS trades FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def flagship_asset_pnl(spark, read) -> DataFrame:
    """Amounts by asset class and year over the star."""
    lines = read("lineitem").select("l_orderkey", "l_partkey", money("l_extendedprice").alias("amount"), money("l_quantity").alias("quantity"))
    joined = lines.join(read("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(read("orders").select("o_orderkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("p_type", "year").agg(F.sum("amount").alias("gross"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades"))


@query("SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(CAST(d AS DATE) AS VARCHAR) AS full_date, CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, isodow(d) >= 6 AS is_weekend FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', INTERVAL 1 DAY) t(d)")
def generated_dim_date(spark, read) -> DataFrame:
    return star.generated_dates(spark, "2024-01-01", "2024-12-31").withColumn("full_date", F.col("full_date").cast("string"))


@query("SELECT DISTINCT n_name AS manager_id FROM nation")
def derived_dim_manager(spark, read) -> DataFrame:
    return star.derived_dimension(read("nation"), "n_name", "manager_id", "manager_key").select("manager_id")


#: Classes of the types; one that isn't listed is an error.
_CLASSES = {"ECONOMY": "basic", "STANDARD": "basic", "PROMO": "offer", "SMALL": "size", "MEDIUM": "size", "LARGE": "size"}


@query("SELECT DISTINCT p_type AS instrument_name, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'basic' WHEN p_type = 'PROMO' THEN 'offer' ELSE 'size' END AS asset_class FROM part")
def derived_dim_instrument(spark, read) -> DataFrame:
    """A derived dimension with a mapped attribute."""
    out = star.derived_dimension(read("part"), "p_type", "instrument_name", "instrument_key", {"asset_class": _CLASSES})
    return out.select("instrument_name", "asset_class")


@query("SELECT c_custkey AS client_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS country, false AS is_inferred FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def dim_client_owned_upsert(spark, read) -> DataFrame:
    """Two sources own different columns of one dimension."""
    c = read("customer")
    empty = spark.createDataFrame([], "client_id bigint, full_name string, country string, is_inferred boolean")
    names = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("full_name"))
    lands = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("client_id"), F.col("c_mktsegment").alias("country"))
    out = merge.owned_upsert(empty, names, "client_id", ["full_name"])
    return merge.owned_upsert(out, lands, "client_id", ["country"]).withColumn("is_inferred", F.coalesce("is_inferred", F.lit(False)))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dim_fk_lookup(spark, read) -> DataFrame:
    dim = read("nation").select("n_nationkey", "n_name").withColumn("nation_key", surrogate_key(F.col("n_nationkey")))
    keyed = star.lookup_key(read("customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey", "n_nationkey", "nation_key", "nation_key", nullable=False)
    return keyed.join(dim.select("nation_key", "n_name"), "nation_key").select("c_custkey", "n_name")


def _restricted(read) -> DataFrame:
    return read("customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("full_name"), F.lit(False).alias("is_inferred"))


@query("SELECT DISTINCT o_custkey AS client_id, true AS is_inferred FROM orders WHERE o_custkey % 10 = 0")
def inferred_members(spark, read) -> DataFrame:
    return star.inferred_members(read("orders"), _restricted(read), "o_custkey", "client_id")


@query("SELECT o_custkey AS client_id, count(*) AS facts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM orders WHERE o_custkey % 10 = 0 GROUP BY 1")
def orphan_clients_report(spark, read) -> DataFrame:
    orders = read("orders").select(F.col("o_custkey").alias("client_id"), money("o_totalprice").alias("amount"))
    stubs = star.inferred_members(orders, _restricted(read), "client_id", "client_id").select("client_id")
    return orders.join(stubs, "client_id", "left_semi").groupBy("client_id").agg(F.count(F.lit(1)).alias("facts"), F.sum("amount").alias("amount"))


def _client_dim(read) -> DataFrame:
    dim = _restricted(read)
    stubs = star.inferred_members(read("orders"), dim, "o_custkey", "client_id").withColumn("full_name", F.lit(None).cast("string"))
    return dim.unionByName(stubs.select(*dim.columns)).withColumn("client_key", surrogate_key(F.col("client_id")))


def _client_versions(read) -> DataFrame:
    """Two versions of each client: before and from 1995."""
    c = read("customer").select(F.col("c_custkey").alias("client_id"))
    old = c.select("client_id", F.lit("1970-01-01").cast("timestamp").alias("valid_from"), F.lit("1995-01-01").cast("timestamp").alias("valid_to"), F.lit(0).cast("bigint").alias("source_lsn"))
    new = c.select("client_id", F.lit("1995-01-01").cast("timestamp").alias("valid_from"), F.lit("9999-12-31").cast("timestamp").alias("valid_to"), F.lit(1).cast("bigint").alias("source_lsn"))
    return old.unionByName(new).withColumn("risk_snapshot_key", surrogate_key(F.col("client_id"), F.col("source_lsn")))


@query("SELECT o_orderkey AS deposit_id, o_custkey AS client_id, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 ELSE 1 END AS source_lsn, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, CAST(o_totalprice AS DECIMAL(18,2)) AS amount_usd, 'internal' AS source_system, o_custkey % 10 = 0 AS is_inferred FROM orders")
def fact_deposits_load(spark, read) -> DataFrame:
    """Deposits with client, snapshot and date keys; natural keys are shown."""
    staged = read("orders").select(F.col("o_orderkey").alias("deposit_id"), F.col("o_custkey").alias("client"), F.to_date("o_orderdate").alias("deposit_date"), money("o_totalprice").alias("amount_usd"))
    dim, versions = _client_dim(read), _client_versions(read)
    facts = star.fact_rows(staged, dim, versions, "client", "deposit_date", {"source_system": "internal"})
    shown = facts.join(dim.select("client_key", "client_id", "is_inferred"), "client_key").join(versions.select("risk_snapshot_key", "source_lsn"), "risk_snapshot_key")
    return shown.select("deposit_id", "client_id", F.col("source_lsn").cast("int").alias("source_lsn"), "date_key", "amount_usd", "source_system", "is_inferred")


@query("SELECT p_type AS instrument, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS month_key, count(*) AS trades, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def fact_trades_load(spark, read) -> DataFrame:
    """Trades with their instrument key, rolled up by natural keys."""
    dim = star.derived_dimension(read("part"), "p_type", "instrument_name", "instrument_key")
    staged = read("lineitem").join(read("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("p_type", "l_shipdate", money("l_extendedprice").alias("amount"))
    keyed = star.lookup_key(staged, dim, "p_type", "instrument_name", "instrument_key", "instrument_key", nullable=False)
    by_key = keyed.groupBy("instrument_key", F.date_format("l_shipdate", "yyyyMM").cast("int").alias("month_key")).agg(F.count(F.lit(1)).alias("trades"), F.sum("amount").alias("amount"))
    return by_key.join(dim, "instrument_key").select(F.col("instrument_name").alias("instrument"), "month_key", "trades", "amount")


def _applied(spark, read):
    return scd2.apply(cdc_events(read), no_versions(spark), no_watermark(spark))


_ASOF_SQL = f"WITH {HISTORY_SQL} SELECT p.lsn, p.client_id, v.source_lsn, v.risk_category FROM cdc p LEFT JOIN versions v ON p.client_id = v.client_id AND v.valid_from <= p.commit_ts AND v.valid_to > p.commit_ts WHERE p.event_type = 'purchase'"


def _purchases(read) -> DataFrame:
    return cdc_events(read).filter("account_status = 'purchase'").select("lsn", "client_id", "commit_ts")


@query(_ASOF_SQL)
def asof_snapshot_fk(spark, read) -> DataFrame:
    """Point-in-time key of each fact by an equi-join with a range."""
    out = star.asof_range(_purchases(read), _applied(spark, read).versions.withColumnRenamed("risk_category", "rc"), "client_id", F.col("commit_ts"), ["source_lsn", "rc"])
    return out.select("lsn", "client_id", "source_lsn", F.col("rc").alias("risk_category"))


@query(_ASOF_SQL)
def asof_snapshot_window(spark, read) -> DataFrame:
    """The same keys by carrying the last version forward."""
    out = star.asof_window(_purchases(read), _applied(spark, read).versions, "client_id", F.col("commit_ts"), ["source_lsn", "risk_category"])
    return out.select("lsn", "client_id", "source_lsn", "risk_category")


@query("SELECT client_id, epoch_us(d) AS valid_from_us, epoch_us(d) + 1 AS valid_to_us, -row_number() OVER (PARTITION BY client_id ORDER BY d) AS source_lsn FROM (SELECT DISTINCT o_custkey AS client_id, date_trunc('day', o_orderdate) AS d FROM orders WHERE o_custkey % 10 = 0)")
def stopgap_windows(spark, read) -> DataFrame:
    """Stopgap versions for facts of clients without history."""
    missed = read("orders").filter("o_custkey % 10 = 0").select(F.col("o_custkey").alias("client_id"), F.to_date("o_orderdate").cast("timestamp").alias("event_ts"))
    out = star.stopgaps(missed, _client_versions(read).filter("client_id % 10 <> 0").select("client_id", "source_lsn"))
    return out.select("client_id", micros("valid_from").alias("valid_from_us"), micros("valid_to").alias("valid_to_us"), "source_lsn")


@query("SELECT o_custkey AS client_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS deposits, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM orders GROUP BY 1, 2")
def star_by_client_date(spark, read) -> DataFrame:
    o = read("orders").select(F.col("o_custkey").alias("client_id"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"), money("o_totalprice").alias("amount"))
    return o.groupBy("client_id", "date_key").agg(F.count(F.lit(1)).alias("deposits"), F.sum("amount").alias("amount"))


@query(f"SELECT p_type, p_brand, count(*) AS trades, CAST(sum({_NET}) AS DECIMAL(28,4)) AS net, CAST(grouping(p_brand) AS INTEGER) AS brand_total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand)")
def star_by_instrument(spark, read) -> DataFrame:
    """Exposure by instrument with subtotals."""
    joined = read("lineitem").select("l_partkey", _net().alias("net")).join(read("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.rollup("p_type", "p_brand").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"), F.grouping("p_brand").cast("int").alias("brand_total"))


@query(f"WITH {HISTORY_SQL} SELECT client_id, risk_category, account_status FROM versions WHERE is_current AND NOT is_deleted AND client_id % 5 = 0")
def partner_scoped_view(spark, read) -> DataFrame:
    """A partner sees the current state of its own clients."""
    v = _applied(spark, read).versions
    return v.filter("is_current AND NOT is_deleted AND client_id % 5 = 0").select("client_id", "risk_category", "account_status")


@query(f"WITH {CDC_SQL} SELECT client_id, lsn, count(*) OVER (PARTITION BY client_id ORDER BY commit_ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM cdc")
def velocity_precheck(spark, read) -> DataFrame:
    """Events of a client within the last hour."""
    e = cdc_events(read).withColumn("us", micros("commit_ts"))
    w = Window.partitionBy("client_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("client_id", "lsn", F.count(F.lit(1)).over(w).alias("in_hour"))

"""Configured pipelines: land, stage, check, load. Each step is one transaction of the store, made of plans over its tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.config import DerivedDimension, GeneratedDimension, Reconciliation, Strategy, TableConfig
from lakeloom.functions import rows as R
from lakeloom.operators import merge, quality, scd2, star
from lakeloom.plans.store import Store
from lakeloom.schemas import references_to, table
from lakeloom.sources import files

SNAPSHOT = "warehouse.dim_client_risk_snapshot"
FLAGS = ("schema_drift_detected", "is_late_arrival")
#: Operations of a change log.
OPERATIONS = ("insert", "update", "delete")


def suite(name: str) -> list[quality.Expectation]:
    """A named suite, of fixed values."""
    if name == "staging_vendor_deposits":
        return [
            quality.between("amount_usd", low=0.01),
            quality.not_null("deposit_id"),
            quality.in_set("payment_method", ["bank_transfer", "credit_card", "e_wallet"]),
        ]
    raise KeyError(f"unknown suite {name!r}")


class NotReady(RuntimeError):
    """A precondition of a step doesn't hold yet."""


@dataclass(frozen=True)
class Warehouse:
    """A store, and the folder in which source files are delivered."""

    store: Store
    data: str

    def landed(self, file_format: str, glob: str) -> DataFrame:
        return files.land(self.store.spark, file_format, f"{self.data.rstrip('/')}/{glob}")


# --- landing


def _keyed(rows: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Rows with their natural key taken from the payload; a missing one is an error."""
    out = rows.select("*", *[F.col("payload")[k].alias(k) for k in keys])
    return merge.assert_not_null(out, keys, what)


def land(cfg: TableConfig, wh: Warehouse) -> int:
    """Land all files that match as they are; returns the rows read. A second delivery of a raw key replaces the first, so landing the
    same files again changes nothing. A change log lands typed, with arrival ordinals that stay."""
    store, raw = wh.store, table(cfg.raw)
    rows = wh.landed(cfg.file_format, cfg.glob)
    old = store.read(cfg.raw)
    if "payload" in raw.types():
        keyed = _keyed(rows, cfg.natural_key, cfg.raw)
        last = merge.last_wins(keyed, list(raw.key), ["source_file", "place"]).drop("place")
    else:
        last = _typed(cfg, rows)
        last = _numbered(last, old, list(raw.key), ["source_file", "place"], "raw_seq").drop("place")
    known = old.select(*raw.key, F.col("ingested_at").alias("__at"))
    stamped = last.join(known, list(raw.key), "left").withColumn("ingested_at", F.coalesce("__at", F.current_timestamp()))
    store.upsert(cfg.raw, _fill(stamped, cfg.raw))
    return rows.count()


def _typed(cfg: TableConfig, rows: DataFrame) -> DataFrame:
    """The columns of the raw table that the config names, cast; a key that a record lacks is null."""
    types = table(cfg.raw).types()
    names = [c for c in dict.fromkeys([*cfg.natural_key, *cfg.expected_columns]) if c in types]
    cast = rows.select("source_file", "place", *[F.col("payload")[c].cast(types[c]).alias(c) for c in names])
    cast = merge.assert_not_null(cast, [c for c in (*cfg.natural_key, "commit_ts", "op") if c in names], cfg.raw)
    if "op" in names:
        wrong = F.raise_error(F.concat(F.lit(f"{cfg.raw}: unknown op "), F.col("op"))).cast("string")
        cast = cast.withColumn("op", F.when(F.col("op").isin(*OPERATIONS), F.col("op")).otherwise(wrong))
    return merge.last_wins(cast, list(table(cfg.raw).key), ["source_file", "place"])


def _numbered(rows: DataFrame, old: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Ordinals in ``order`` that go on from the stored ones; known keys keep theirs."""
    known = old.select(*keys, F.col(name).alias("__seq"))
    top = old.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]
    fresh = merge.with_ordinals(rows.join(known, keys, "left_anti"), order, "__n").select(*keys, (F.col("__n") + top).alias("__new"))
    both = rows.join(known, keys, "left").join(fresh, keys, "left")
    return both.withColumn(name, F.coalesce("__seq", "__new")).drop("__seq", "__new")


# --- staging


def stage(cfg: TableConfig, wh: Warehouse) -> int:
    """Merge all landed rows into the staged ones; returns the number of staged rows."""
    if "payload" in table(cfg.raw).types():
        rows = _stage_payloads(cfg, wh.store)
    else:
        rows = _stage_typed(cfg, wh.store)
    wh.store.write(cfg.target, rows)
    return wh.store.read(cfg.target).count()


def _stage_payloads(cfg: TableConfig, store: Store) -> DataFrame:
    """Typed rows of the payloads: names resolved, drift and lateness flagged. Stored rows count as the earliest delivery and files
    follow by name: update columns take the last value present, flags are or-ed, the rest keeps the first value."""
    types, keys = table(cfg.target).types(), list(cfg.natural_key)
    expected = [c for c in cfg.expected_columns if c in types]
    updated = [c for c in cfg.update_columns if c in expected]
    rows = store.read(cfg.raw).withColumn("__p", R.canonical(F.col("payload"), cfg.expected_columns, cfg.aliases))
    late = F.lit(False)
    if cfg.late_arrival:
        date = F.col("__p")[cfg.late_arrival["event_date_col"]].cast("date")
        late = R.late(F.col("source_file"), date, cfg.late_arrival["delivery_date"]["pattern"], cfg.late_arrival["threshold_days"])
    new = rows.select(
        F.lit(1).alias("__new"),
        "source_file",
        *[F.col("__p")[c].cast(types[c]).alias(c) for c in expected],
        *[F.map_contains_key("__p", F.lit(c)).alias(f"__has_{c}") for c in updated],
        R.drifted(F.col("payload"), cfg.expected_columns).alias(FLAGS[0]),
        late.alias(FLAGS[1]),
    )
    old = store.read(cfg.target)
    held = old.select(
        F.lit(0).alias("__new"),
        F.lit("").alias("source_file"),
        *expected,
        *[F.lit(True).alias(f"__has_{c}") for c in updated],
        *[(F.col(f) if f in types else F.lit(False)).alias(f) for f in FLAGS],
    )
    folded = merge.staging_merge(held.unionByName(new), keys, updated, FLAGS, ["__new", "source_file"], {c: f"__has_{c}" for c in updated})
    tracked = [c for c in dict.fromkeys([*updated, *FLAGS]) if c in types]
    if not tracked:
        tracked = keys
    return _fill(merge.with_noop_detection(old, folded, keys, tracked), cfg.target)


def _stage_typed(cfg: TableConfig, store: Store) -> DataFrame:
    """The change log as landed, numbered in landing order."""
    old, keys = store.read(cfg.target), list(cfg.natural_key)
    rows = _numbered(store.read(cfg.raw), old, keys, ["raw_seq"], "staging_seq")
    tracked = [c for c in cfg.expected_columns if c in old.columns and c not in keys]
    new = _fill(merge.with_noop_detection(old, rows, keys, tracked), cfg.target)
    return merge.overwrite(old, new, keys)


# --- checks


def check(cfg: TableConfig, wh: Warehouse, run_id: str) -> list[str]:
    """Run the table's suite and assertions, log every result, quarantine a summary of each failed critical one; returns their names.
    Loading goes on in any case."""
    store = wh.store
    parts = []
    if cfg.suite:
        parts.append(quality.run_suite(store.read(cfg.target), cfg.target, suite(cfg.suite)).drop("checked"))
    if cfg.checks:
        store.register_views()
        named = [(c.name, c.severity, _plain(c.sql)) for c in cfg.checks]
        parts.append(quality.run_assertions(store.spark, cfg.target, named).select("table_name", "check_name", "severity", "passed", "unexpected_count"))
    if not parts:
        return []
    results = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # a row for each check: worked out once, then logged and routed
    rows = store.spark.createDataFrame(results.collect(), "table_name string, check_name string, severity string, passed boolean, unexpected_count bigint")
    log = store.read("data_quality.dq_check_results")
    typed = rows.withColumn("unexpected_count", F.col("unexpected_count").cast("int"))
    store.write("data_quality.dq_check_results", quality.append_log(log, typed, run_id, F.current_timestamp()))
    bad = quality.quarantine_summaries(rows).withColumn("raw_payload", F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.get_json_object("raw_payload", "$.unexpected_count").cast("int").alias("unexpected_count"))))
    old = store.read("quarantine.rejected_rows")
    new = bad.withColumn("rejected_at", F.current_timestamp()).select(*old.columns)
    seen = old.select("table_name", "reason_code", "raw_payload")
    store.write("quarantine.rejected_rows", old.unionByName(new.join(seen, seen.columns, "left_anti").select(*old.columns)))
    return sorted(r["check_name"] for r in rows.collect() if not r["passed"] and r["severity"] == "CRITICAL")


def _plain(sql: str) -> str:
    """A statement with the names of views: an underscore for the dot."""
    for schema in ("raw", "staging", "warehouse", "quarantine", "data_quality"):
        sql = sql.replace(f"{schema}.", f"{schema}_")
    return sql


# --- loading


def _fill(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a table, null where ``rows`` lacks one."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table(name).schema])


def _write_dimension(store: Store, name: str, rows: DataFrame) -> None:
    """Surrogate keys are hashes: two natural keys of one hash are an error, not one member."""
    key = next(f.name for f in table(name).schema if f.name.endswith("_key"))
    store.write(name, merge.assert_unique(_fill(rows, name), [key], name))


def load_dimension(cfg: TableConfig, s: Strategy, wh: Warehouse) -> None:
    store = wh.store
    staged, dim = store.read(cfg.target), store.read(s.target)
    (key,) = table(s.target).key
    owned = list(s.columns or [c for c in cfg.expected_columns if c in dim.columns and c != key])
    for column, rule in s.lookups().items():
        found = store.read(rule["dim_target"])
        staged = star.lookup_key(staged, found, rule["from_column"], rule["dim_natural_key"], rule["dim_surrogate_key"], column, rule.get("nullable", True))
        owned += [column] if column not in owned else []
    out = merge.owned_upsert(dim, staged, key, owned)
    out = out.withColumn("client_key", R.surrogate_key(F.col(key))).withColumn("is_inferred", F.coalesce("is_inferred", F.lit(False)))
    out = out.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).withColumn("updated_at", F.current_timestamp())
    _write_dimension(store, s.target, out)


def _midnight(date: str) -> F.Column:
    return F.col(date).cast("timestamp")


def load_facts(cfg: TableConfig, s: Strategy, wh: Warehouse) -> None:
    """Inferred members and stopgaps first, as far as the config asks for them, then the facts with all keys; a key that is still
    missing is an error. Only partitions of the fact table that the delivery touches are written."""
    store, date, rules = wh.store, s.options["event_date_column"], s.options.get("fk_resolution", {})
    lookups = s.lookups()
    wanted = dict.fromkeys([*cfg.natural_key, "client_id", date, *s.columns, *(r["from_column"] for r in lookups.values())])
    staged = store.read(cfg.target).select(*wanted)
    if rules.get("dim_client") == "inferred_member_on_miss":
        dim = store.read("warehouse.dim_client")
        stubs = star.inferred_members(staged, dim, "client_id", "client_id").withColumn("client_key", R.surrogate_key(F.col("client_id")))
        _write_dimension(store, "warehouse.dim_client", dim.unionByName(_fill(stubs.withColumn("created_at", F.current_timestamp()), "warehouse.dim_client")))
    if rules.get("risk_snapshot") == "snapshotted_fk":
        versions = store.read(SNAPSHOT)
        missed = star.asof_window(staged, versions, "client_id", _midnight(date), ["risk_snapshot_key"]).filter("risk_snapshot_key IS NULL")
        gaps = star.stopgaps(missed.select("client_id", _midnight(date).alias("event_ts")), versions)
        _write_versions(store, versions.drop("risk_snapshot_key").unionByName(gaps.select(*[c for c in versions.columns if c != "risk_snapshot_key"])))
    dims = [(store.read(r["dim_target"]), r["from_column"], r["dim_natural_key"], r["dim_surrogate_key"], c, r.get("nullable", True)) for c, r in lookups.items()]
    facts = star.fact_rows(staged, store.read("warehouse.dim_client"), store.read(SNAPSHOT), "client_id", date, s.options.get("literals"), dims)
    facts = merge.assert_not_null(facts, ["risk_snapshot_key"], s.target)
    days = facts.select(F.col(date).alias("d")).distinct()
    calendar = days.select(*[c.alias(n) for n, c in R.calendar(F.col("d")).items()])
    store.write("warehouse.dim_date", merge.insert_absent(store.read("warehouse.dim_date"), _fill(calendar, "warehouse.dim_date"), ["date_key"]))
    store.upsert(s.target, _fill(facts, s.target))


def events(store: Store, name: str = "staging.client_profile_changes") -> DataFrame:
    """Changes with the attributes of ``after``; a change that lacks one fails later rather than insert a null."""
    e = store.read(name)
    seq = "staging_seq" if "staging_seq" in e.columns else "raw_seq"
    take = lambda n, kind: F.get_json_object("after", f"$.{n}").cast(kind).alias(n)
    attributes = [take("risk_category", "string"), take("account_balance_usd", "decimal(14,2)"), take("account_status", "string")]
    return e.select("client_id", "lsn", "commit_ts", "op", F.col(seq).alias("seq"), *attributes)


def _write_versions(store: Store, versions: DataFrame) -> None:
    checked = merge.assert_not_null(versions, scd2.ATTRIBUTES, SNAPSHOT)
    _write_dimension(store, SNAPSHOT, checked.withColumn("risk_snapshot_key", R.surrogate_key(F.col("client_id"), F.col("source_lsn"))))


def load_baseline(cfg: TableConfig, s: Strategy, wh: Warehouse) -> None:
    log = wh.landed("jsonl", s.options["cdc_source_glob"])
    changes = log.select(F.col("payload")["client_id"].alias("client_id"), F.col("payload")["lsn"].cast("bigint").alias("lsn"), F.col("payload")["op"].alias("op"))
    versions = wh.store.read(SNAPSHOT).drop("risk_snapshot_key")
    _write_versions(wh.store, scd2.baseline(wh.store.read(cfg.target), changes, versions))


def baseline_ready(store: Store) -> bool:
    """A baseline exists, and every client whose first change in arrival order isn't an insert has one."""
    base = store.read(SNAPSHOT).filter("source_lsn = 0")
    if not base.take(1):
        return False
    staged = store.read("staging.client_profile_changes").withColumn("seq", F.col("staging_seq"))
    first = scd2.first_ops(staged, "seq").filter("op <> 'insert'")
    return not first.join(base, "client_id", "left_anti").take(1)


def instruments_ready(store: Store) -> bool:
    return bool(store.read("warehouse.dim_instrument").take(1))


#: What a table may wait for, by the key of its orchestration.
WAITS: dict[str, Callable[[Store], bool]] = {"requires_dim_instrument": instruments_ready, "requires_scd2_baseline": baseline_ready}


def wait(cfg: TableConfig, wh: Warehouse, poke: float = 30, timeout: float = 3600, sleep: Callable[[float], None] = time.sleep) -> None:
    """Return once all that the table waits for holds; raises NotReady after ``timeout`` seconds."""
    for name, ready in WAITS.items():
        waited = 0.0
        while cfg.orchestration.get(name) and not ready(wh.store):
            if waited >= timeout:
                raise NotReady(f"{cfg.name}: {name} doesn't hold after {timeout:g} seconds")
            sleep(poke)
            waited += poke


def load_changes(cfg: TableConfig, s: Strategy, wh: Warehouse) -> None:
    store = wh.store
    if not baseline_ready(store):
        raise NotReady("the baseline isn't seeded for all clients with changes")
    versions, marks = store.read(SNAPSHOT).drop("risk_snapshot_key"), store.read("warehouse.cdc_watermark")
    _store_applied(store, scd2.apply(events(store), versions, marks))


def _store_applied(store: Store, done: scd2.Applied) -> None:
    q = store.read("quarantine.rejected_rows")
    new = done.quarantine.withColumn("rejected_at", F.current_timestamp()).select(*q.columns)
    seen = q.select("table_name", "reason_code", "raw_payload")
    store.write("quarantine.rejected_rows", q.unionByName(new.join(seen, seen.columns, "left_anti").select(*q.columns)))
    _write_versions(store, done.versions)
    store.write("warehouse.cdc_watermark", done.watermark)


STRATEGIES: dict[str, Callable[[TableConfig, Strategy, Warehouse], None]] = {
    "dimension_upsert": load_dimension,
    "fact_upsert": load_facts,
    "scd2_apply": load_changes,
    "scd2_baseline_seed": load_baseline,
}


def load(cfg: TableConfig, wh: Warehouse) -> None:
    with wh.store.transaction():
        for s in cfg.strategies:
            STRATEGIES[s.strategy](cfg, s, wh)


def run_table(cfg: TableConfig, wh: Warehouse, run_id: str) -> list[str]:
    """All steps of one table; returns the failed critical checks."""
    land(cfg, wh)
    stage(cfg, wh)
    with wh.store.transaction():
        failed = check(cfg, wh, run_id)
    load(cfg, wh)
    return failed


def run_dimension(cfg: DerivedDimension | GeneratedDimension, wh: Warehouse) -> int:
    """Returns the members written: new ones, and for derived dimensions with attributes all that the source has."""
    store = wh.store
    old = store.read(cfg.target)
    if isinstance(cfg, GeneratedDimension):
        new = star.generated_dates(store.spark, cfg.first.isoformat(), cfg.last.isoformat())
        out = merge.insert_absent(old, _fill(new, cfg.target), list(table(cfg.target).key))
        n = out.count() - old.count()
        store.write(cfg.target, out)
        return n
    if cfg.source_table:
        source = store.read(f"staging.{cfg.source_table}")
    else:
        landed = wh.landed(cfg.raw_source_glob.rsplit(".", 1)[-1], cfg.raw_source_glob)
        source = landed.select(F.col("payload")[cfg.source_column].alias(cfg.source_column))
    key = next(f.name for f in table(cfg.target).schema if f.name.endswith("_key"))
    new = _fill(star.derived_dimension(source, cfg.source_column, cfg.natural_key, key, cfg.attributes), cfg.target)
    if cfg.attributes:
        n = new.count()
        _write_dimension(store, cfg.target, merge.overwrite(old, new, [cfg.natural_key]))
    else:
        n = new.join(old, cfg.natural_key, "left_anti").count()
        _write_dimension(store, cfg.target, merge.insert_absent(old, new, [cfg.natural_key]))
    return n


def run_reconciliation(cfg: Reconciliation, wh: Warehouse, run_id: str) -> int:
    """Replace the report of this name and run, log one check; returns the number of discrepancies."""
    store = wh.store
    with store.transaction():
        store.register_views()
        sides = [store.spark.sql(_plain(sql)) for sql in (cfg.left_sql, cfg.right_sql)]
        found = quality.reconcile(*sides, cfg.name, cfg.key).withColumn("run_id", F.lit(run_id)).withColumn("detected_at", F.current_timestamp())
        name = "data_quality.reconciliation_discrepancies"
        old = store.read(name)
        mine = (F.col("reconciliation_name") == cfg.name) & (F.col("run_id") == run_id)
        store.write(name, old.filter(~mine).unionByName(found.select(*old.columns)))
        n = store.read(name).filter(mine).count()
        row = store.spark.createDataFrame([("reconciliation", f"reconciliation:{cfg.name}", "WARNING", n == 0, n)], "table_name string, check_name string, severity string, passed boolean, unexpected_count int")
        store.write("data_quality.dq_check_results", quality.append_log(store.read("data_quality.dq_check_results"), row, run_id, F.current_timestamp()))
    return n


def historical_reload(wh: Warehouse, start: str, stop: str, dates: dict[str, str]) -> dict[str, int]:
    """Rebuild the history of clients with changes in ``[start, stop)`` and find the keys of their facts again; all in one commit, by
    one run at a time. ``dates`` has the event date column of each fact table. Facts of other clients aren't read beyond their keys,
    and a fact for which no version is valid any more is an error."""
    store = wh.store
    with store.lock("reload"), store.transaction():
        lo, hi = F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")
        versions, marks = store.read(SNAPSHOT).drop("risk_snapshot_key"), store.read("warehouse.cdc_watermark")
        log = events(store, "raw.client_profile_changes")
        done, affected = scd2.reload(log, versions, marks, lo, hi)
        counts = {"clients_reset": affected.count(), "events_replayed": log.join(affected, "client_id").filter("lsn >= reset_lsn").count()}
        if not counts["clients_reset"]:
            return counts
        clients = store.read("warehouse.dim_client").join(affected.select("client_id"), "client_id", "left_semi").select("client_key", "client_id")
        _store_applied(store, done)
        fresh = store.read(SNAPSHOT).join(affected.select("client_id"), "client_id", "left_semi")
        for name, column in references_to(SNAPSHOT).items():
            rows = store.read(name).join(clients, "client_key")
            if name not in dates:
                if rows.take(1):
                    raise KeyError(f"no config says which date {name} goes by")
                continue
            again = star.asof_window(rows.drop(column), fresh, "client_id", _midnight(dates[name]), ["risk_snapshot_key"])
            found = merge.assert_not_null(again.withColumnRenamed("risk_snapshot_key", column), [column], name)
            store.upsert(name, _fill(found, name))
    return counts


def state_lines(store: Store, dates: dict[str, str]) -> DataFrame:
    """``line`` in a fixed order: every real version by client and lsn, then every fact's snapshot key by table and key."""
    v = store.read(SNAPSHOT).filter("source_lsn >= 0")
    shown = ["client_id", "source_lsn", "is_current", "is_deleted", *scd2.ATTRIBUTES, "valid_from", "valid_to"]
    text = lambda *cols: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    out = v.select(F.lit(0).alias("a"), F.col("client_id").alias("b"), F.col("source_lsn").alias("c"), text(F.lit("snapshot"), *map(F.col, shown)).alias("line"))
    for i, name in enumerate(sorted(dates)):
        (key,) = table(name).key
        facts = store.read(name)
        out = out.unionByName(facts.select(F.lit(i + 1).alias("a"), F.col(key).alias("b"), F.lit(0).cast("bigint").alias("c"), text(F.lit("fact"), F.lit(name), F.col(key), F.col("risk_snapshot_key")).alias("line")))
    return out.orderBy("a", "b", "c").select("line")

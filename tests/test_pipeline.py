"""Configured pipelines over small files: landing, drift, merges, lateness, history, reload, quality, reconciliation, commands."""

from __future__ import annotations

import json

import pytest
import yaml
from pyspark.sql import functions as F

from lakeloom import commands
from lakeloom.config import ConfigError, event_date_columns, load_all, load_one, main
from lakeloom.plans import graph, migrations
from lakeloom.plans import pipeline as P
from lakeloom.plans.store import Store
from lakeloom.schemas import TABLES
from lakeloom.sources.files import land

DEPOSIT = ["deposit_id", "client_id", "deposit_date", "amount_usd", "payment_method", "currency_original", "exchange_rate", "status", "processing_days", "fee_usd"]
PROFILE = ["client_id", "full_name", "date_of_birth", "nationality", "risk_category", "account_balance_usd", "account_status", "currency", "last_login_date", "preferred_language"]
CHANGE = ["client_id", "lsn", "commit_ts", "op", "before", "after"]


def change(lsn, ts, op, client, after) -> str:
    return json.dumps({"lsn": lsn, "commit_ts": ts, "op": op, "client_id": client, "before": None, "after": after})


def values(risk, balance, status) -> dict:
    return {"risk_category": risk, "account_balance_usd": balance, "account_status": status}


def write_world(root) -> None:
    data, conf = root / "data", root / "conf"
    for d in (data, conf / "tables", conf / "reconciliations"):
        d.mkdir(parents=True)
    head = ",".join(DEPOSIT)
    (data / "feed_20240301.csv").write_text(f"{head}\nV1,C1,2024-03-01,-250.00,credit_card,USD,1.0,ok,1,0.50\nV2,C2,2024-03-01,100.00,credit_card,EUR,1.1,ok,1,0.00")
    second = head.replace("payment_method", "method")
    (data / "feed_20240302.csv").write_text(f"{second}\nV2,C2,2024-03-02,999.00,e_wallet,EUR,1.1,done,1,0.00\nV3,C9,2024-02-20,70.005,e_wallet,USD,1.0,ok,2,0.00\n")
    people = [dict(zip(PROFILE, (c, n, "1990-01-01", "X", "low", 10.5, "active", "USD", None, "en"), strict=True)) for c, n in (("C1", "A B"), ("C2", "C D"), ("C3", "E F"))]
    (data / "profiles.json").write_text(json.dumps(people))
    log = [
        change(11, "2024-03-01T10:00:00Z", "update", "C1", values("high", 20, "active")),
        "",
        change(10, "2024-03-01T09:00:00Z", "update", "C1", values("mid", 15, "active")),
        change(12, "2024-03-02T09:00:00Z", "delete", "C2", None),
        change(13, "2024-03-02T10:00:00Z", "insert", "C3", values("low", 1, "active")),
    ]
    (data / "changes.jsonl").write_text("\n".join(log) + "\n")
    (data / "trades.json").write_text(json.dumps([{"instrument": "Gold"}, {"instrument": None}, {"instrument": "EUR/USD"}, {"instrument": "Gold"}]))

    def table(name, fmt, glob, key, columns, raw, staged, layer3, source=None, layer2=None, orchestration=None):
        doc = {
            "kind": "table",
            "name": name,
            "source": {"format": fmt, "glob": glob, "natural_key": key, "expected_columns": columns, **(source or {})},
            "layer1": {"target": raw},
            "layer2": {"target": staged, **(layer2 or {})},
            "layer3": layer3,
            "orchestration": orchestration or {},
        }
        (conf / f"tables/{name}.yml").write_text(yaml.safe_dump(doc))

    late = {"delivery_date": {"from": "filename", "pattern": r"feed_(\d{8})\.csv"}, "event_date_col": "deposit_date", "threshold_days": 2}
    facts = {"target": "warehouse.fact_deposits", "strategy": "fact_upsert", "event_date_column": "deposit_date", "literals": {"source_system": "vendor"}}
    facts["columns"] = ["amount_usd", "exchange_rate", "fee_usd", "processing_days", "payment_method", "currency_original", "status", "status", "is_late_arrival"]
    facts["fk_resolution"] = {"dim_client": "inferred_member_on_miss", "risk_snapshot": "snapshotted_fk"}
    checks = [{"name": "positive", "severity": "CRITICAL", "sql": "SELECT count(*) FROM staging.vendor_deposits WHERE amount_usd <= 0"}]
    staged = {"update_columns": ["status", "payment_method", "status"], "dq_checks": checks, "ge_suite": "staging_vendor_deposits"}
    table("vendor", "csv", "feed_*.csv", ["deposit_id"], DEPOSIT, "raw.vendor_deposits", "staging.vendor_deposits", [facts], {"aliases": {"method": "payment_method"}, "late_arrival": late}, staged)
    dimension = {"target": "warehouse.dim_client", "strategy": "dimension_upsert", "columns": ["full_name", "date_of_birth", "nationality", "currency", "preferred_language"]}
    seed = {"target": P.SNAPSHOT, "strategy": "scd2_baseline_seed", "cdc_source_glob": "changes.jsonl"}
    table("profile", "json", "profiles.json", ["client_id"], PROFILE, "raw.client_profile", "staging.client_profile", [dimension, seed], None, {"update_columns": PROFILE[1:]}, {"schedule": None})
    table("changes", "jsonl", "changes.jsonl", ["client_id", "lsn"], CHANGE, "raw.client_profile_changes", "staging.client_profile_changes", [{"target": P.SNAPSHOT, "strategy": "scd2_apply"}], None, None, {"requires_scd2_baseline": True})
    (conf / "tables/dates.yml").write_text("kind: generated_dimension\nname: dates\ntarget: warehouse.dim_date\nfrom: 2024-01-01\nto: 2024-12-31\n")
    instruments = {"kind": "derived_dimension", "name": "instruments", "raw_source_glob": "trades.json", "source_column": "instrument", "target": "warehouse.dim_instrument", "target_key_column": "instrument_name", "derived_columns": {"asset_class": {"Gold": "Commodity", "EUR/USD": "FX"}}}
    (conf / "tables/instruments.yml").write_text(yaml.safe_dump(instruments))
    (conf / "reconciliations/feed.yml").write_text("name: feed\nkey: [client_id]\nleft: SELECT DISTINCT client_id FROM staging.vendor_deposits\nright: SELECT client_id FROM staging.client_profile\n")


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    write_world(root)
    return root


def test_pipeline(spark, world):
    tables, recons = load_all(world / "conf")
    by = {t.name: t for t in tables}
    store = Store(spark, f"file://{world}/store")
    wh = P.Warehouse(store, f"file://{world}/data")
    assert len(migrations.migrate(store)) == len(TABLES) and migrations.migrate(store) == []
    with pytest.raises(P.NotReady, match="requires_scd2_baseline"):
        P.wait(by["changes"], wh, 30, 60, lambda s: None)
    report = graph.execute(graph.bootstrap_steps(tables, wh))
    assert report.ok and report.done["build_dates"] == 366 and report.done["build_instruments"] == 2
    assert P.run_dimension(by["dates"], wh) == 0
    base = store.read(P.SNAPSHOT)
    assert {r["client_id"] for r in base.collect()} == {"C1", "C2"}  # C3's first change is an insert

    assert P.land(by["vendor"], wh) == 4 == P.land(by["vendor"], wh) == store.read("raw.vendor_deposits").count()
    assert P.run_table(by["vendor"], wh, "r1") == ["expect_column_values_to_be_between:amount_usd", "positive"]
    assert store.read("data_quality.dq_check_results").count() == 4
    assert store.read("quarantine.rejected_rows").count() == 2
    assert store.sql("SELECT failed_checks FROM data_quality.dq_table_health").first()[0] == 2
    staged = {r["deposit_id"]: r for r in store.read("staging.vendor_deposits").collect()}
    assert len(staged) == 3
    assert (staged["V2"]["status"], staged["V2"]["payment_method"], str(staged["V2"]["amount_usd"])) == ("done", "e_wallet", "100.00")
    assert [staged[k]["schema_drift_detected"] for k in ("V1", "V2", "V3")] == [False, True, True]
    assert [staged[k]["is_late_arrival"] for k in ("V1", "V2", "V3")] == [False, False, True]
    assert str(staged["V3"]["amount_usd"]) == "70.01"
    facts = store.read("warehouse.fact_deposits")
    assert facts.count() == 3 and facts.filter("risk_snapshot_key IS NULL OR client_key IS NULL").count() == 0
    assert [r["client_id"] for r in store.read("warehouse.dim_client").filter("is_inferred").collect()] == ["C9"]
    assert store.read(P.SNAPSHOT).filter("source_lsn < 0").count() == 1

    P.run_table(by["changes"], wh, "r1")
    reasons = {(r["reason_code"], json.loads(r["raw_payload"])["client_id"]) for r in store.read("quarantine.rejected_rows").filter("table_name = 'client_profile_changes'").collect()}
    assert reasons == {("stale_lsn", "C1")}
    versions = store.read(P.SNAPSHOT)
    c2 = {r["source_lsn"]: r for r in versions.filter("client_id = 'C2'").collect()}
    assert c2[12]["is_deleted"] and c2[12]["is_current"] and c2[12]["account_status"] == "deleted" and c2[12]["risk_category"] == "low"
    assert c2[0]["valid_to"] == c2[12]["valid_from"] and not c2[0]["is_current"]
    dates = event_date_columns(tables)
    state = [r["line"] for r in P.state_lines(store, dates).collect()]
    assert state[0].startswith("snapshot|C1|0|") and state[-1].startswith("fact|warehouse.fact_deposits|V3|")
    # a second run changes nothing
    P.run_table(by["changes"], wh, "r2")
    P.run_table(by["vendor"], wh, "r2")
    assert [r["line"] for r in P.state_lines(store, dates).collect()] == state
    assert store.read("quarantine.rejected_rows").filter("table_name = 'client_profile_changes'").count() == 1
    assert {r["staged_at"] for r in store.read("staging.vendor_deposits").collect()} == {r["staged_at"] for r in staged.values()}
    assert [r["staging_seq"] for r in store.read("staging.client_profile_changes").orderBy("staging_seq").collect()] == [1, 2, 3, 4]

    assert P.historical_reload(wh, "2024-03-01", "2024-03-02", dates) == {"clients_reset": 1, "events_replayed": 2}
    c1 = sorted(r["source_lsn"] for r in store.read(P.SNAPSHOT).filter("client_id = 'C1'").collect())
    assert c1 == [0, 10, 11]
    assert store.read("warehouse.fact_deposits").count() == 3 and store.read("warehouse.fact_deposits").filter("risk_snapshot_key IS NULL").count() == 0
    assert P.run_reconciliation(recons[0], wh, "r1") == 2 == P.run_reconciliation(recons[0], wh, "r1")
    assert store.read("data_quality.reconciliation_discrepancies").count() == 2
    with store.lock("reload"), pytest.raises(Exception, match="exist"):
        P.historical_reload(wh, "2024-03-01", "2024-03-02", dates)


def test_staged_rows_outlive_their_files(spark, tmp_path):
    write_world(tmp_path)
    by = {t.name: t for t in load_all(tmp_path / "conf")[0]}
    store = Store(spark, f"file://{tmp_path}/store")
    wh = P.Warehouse(store, f"file://{tmp_path}/data")
    migrations.migrate(store)
    P.land(by["vendor"], wh)
    P.stage(by["vendor"], wh)
    for f in (tmp_path / "data").glob("feed_*.csv"):
        f.unlink()
    (tmp_path / "data/feed_20240309.csv").write_text(f"{','.join(DEPOSIT)}\nV2,C2,2024-03-01,5.00,bank_transfer,EUR,1.1,back,1,0.00\n\"V,\n9\",C1,2024-03-09,1.00,e_wallet,USD,1.0,ok,1,0.00\n")
    assert P.land(by["vendor"], wh) == 2 and P.stage(by["vendor"], wh) == 4
    rows = {r["deposit_id"]: r for r in store.read("staging.vendor_deposits").collect()}
    assert set(rows) == {"V1", "V2", "V3", "V,\n9"}
    # first values and sticky flags stay, update columns follow the last delivery
    assert (str(rows["V2"]["amount_usd"]), rows["V2"]["status"], rows["V2"]["schema_drift_detected"], rows["V2"]["is_late_arrival"]) == ("100.00", "back", True, True)


def test_reload_keeps_facts_or_fails(spark, tmp_path):
    write_world(tmp_path)
    tables = load_all(tmp_path / "conf")[0]
    by, dates = {t.name: t for t in tables}, event_date_columns(tables)
    store = Store(spark, f"file://{tmp_path}/store")
    wh = P.Warehouse(store, f"file://{tmp_path}/data")
    migrations.migrate(store)
    assert graph.execute(graph.bootstrap_steps(tables, wh)).ok
    for name in ("vendor", "changes"):
        P.run_table(by[name], wh, "r")
    # a fact whose client the dimension lacks stays; those of clients concerned get their keys anew
    stray = store.read("warehouse.fact_deposits").limit(1).withColumns({"deposit_id": F.lit("S1"), "client_key": F.lit(5).cast("bigint")})
    busy = store.read("warehouse.fact_deposits").filter("deposit_id = 'V1'").crossJoin(spark.range(2000)).withColumns({"deposit_id": F.concat(F.lit("B"), F.col("id").cast("string")), "risk_snapshot_key": F.lit(1).cast("bigint")}).drop("id")
    store.upsert("warehouse.fact_deposits", stray.unionByName(busy))
    P.historical_reload(wh, "2024-03-01", "2024-03-02", dates)
    facts = store.read("warehouse.fact_deposits")
    assert facts.count() == 2004 and facts.filter("deposit_id = 'S1'").count() == 1 and facts.filter("risk_snapshot_key = 1").count() == 0
    # a fact before all versions is an error, and nothing is committed
    early = facts.filter("deposit_id = 'V1'").withColumns({"deposit_id": F.lit("E1"), "deposit_date": F.to_date(F.lit("1960-01-01")), "date_key": F.lit(19600101)})
    store.upsert("warehouse.fact_deposits", early)
    before, state = store.commits(), store._state()
    with pytest.raises(Exception, match="null in risk_snapshot_key"):
        P.historical_reload(wh, "2024-03-01", "2024-03-02", dates)
    assert store.commits() == before and store._state() == state


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    facts = lambda rows: spark.createDataFrame(rows, "deposit_id string, date_key int").select(*[(F.col(f.name) if f.name in ("deposit_id", "date_key") else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES["warehouse.fact_deposits"].schema])
    name = "warehouse.fact_deposits"
    store.upsert(name, facts([("a", 20240101), ("b", 20240201), ("c", 20240301)]))
    first = store._state()[name]
    store.upsert(name, facts([("b", 20240202), ("d", 20240203)]))
    second = store._state()[name]
    assert sorted(first) == sorted(second) == ["202401", "202402", "202403"]
    assert first["202401"] == second["202401"] and first["202403"] == second["202403"] and first["202402"] != second["202402"]
    store.upsert(name, facts([("a", 20240305)]))  # a key that moves to another partition leaves the old one
    assert {(r["deposit_id"], r["date_key"]) for r in store.read(name).collect()} == {("a", 20240305), ("b", 20240202), ("c", 20240301), ("d", 20240203)}
    with pytest.raises(RuntimeError, match="stop"), store.transaction():
        store.write("warehouse.cdc_watermark", spark.createDataFrame([("x", 1)], TABLES["warehouse.cdc_watermark"].schema))
        assert store.read("warehouse.cdc_watermark").count() == 1
        raise RuntimeError("stop")
    assert store.read("warehouse.cdc_watermark").count() == 0
    for i in range(6):
        store.write("warehouse.cdc_watermark", spark.createDataFrame([("x", i)], TABLES["warehouse.cdc_watermark"].schema))
    assert store.read("warehouse.cdc_watermark").first()["last_applied_lsn"] == 5 and len(store.commits()) == 3
    other = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(Exception, match="exist"), store.transaction():
        store.write("warehouse.cdc_watermark", spark.createDataFrame([("y", 1)], TABLES["warehouse.cdc_watermark"].schema))
        other.write("warehouse.cdc_watermark", spark.createDataFrame([("z", 1)], TABLES["warehouse.cdc_watermark"].schema))
    assert store.read("warehouse.cdc_watermark").first()["client_id"] == "z"
    with pytest.raises(KeyError):
        store.read("no.table")


def test_migration_drift(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    steps = migrations.steps()
    monkeypatch.setattr(migrations, "steps", lambda: steps[:2])
    assert migrations.migrate(store) == [n for n, _ in steps[:2]]
    monkeypatch.setattr(migrations, "steps", lambda: steps[:3])
    assert migrations.migrate(store) == [steps[2][0]] and migrations.migrate(store) == []
    monkeypatch.setattr(migrations, "steps", lambda: [(steps[0][0], "other"), *steps[1:3]])
    with pytest.raises(migrations.Drift, match="000_raw.client_signup"):
        migrations.migrate(store)


def test_graph():
    ran: list[str] = []
    step = lambda n, *after: graph.Step(n, lambda: ran.append(n), after)

    def fail():
        raise ValueError("no")

    report = graph.execute([step("c", "b"), step("a"), graph.Step("b", fail, ("a",)), step("d", "a")])
    assert ran == ["a", "d"] and list(report.failed) == ["b"] and report.skipped == {"c": "b"} and not report.ok
    with pytest.raises(ValueError, match="cycle"):
        graph.ordered([step("a", "b"), step("b", "a")])
    with pytest.raises(ValueError, match="unknown"):
        graph.ordered([step("a", "z")])
    with pytest.raises(ValueError, match="repeat"):
        graph.ordered([step("a"), step("a")])


def test_commands(spark, tmp_path, capsys):
    write_world(tmp_path)
    store, conf, data = f"file://{tmp_path}/store", str(tmp_path / "conf"), f"file://{tmp_path}/data"
    assert commands.main([], spark) == commands.main(["run", store], spark) == commands.main(["fly", store], spark) == 2
    assert commands.main(["verify", store, conf, data], spark) == 0
    capsys.readouterr()
    assert commands.main(["dump-state", store, conf], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("snapshot|C1|0|") and sum(x.startswith("fact|") for x in lines) == 3
    assert commands.main(["migrate", store], spark) == 0 and "nothing to apply" in capsys.readouterr().out
    assert commands.main(["run", store, conf, data, "nothing"], spark) == 1
    assert commands.main(["reconcile", store, conf, data, "feed"], spark) == 0
    assert commands.main(["reload", store, conf, data, "2024-03-01", "2024-03-02"], spark) == 0
    (tmp_path / "data/changes.jsonl").write_text(change(1, "2024-03-01T10:00:00Z", "upsert", "C1", None))
    assert commands.main(["run", store, conf, data, "changes"], spark) == 1 and "unknown op upsert" in capsys.readouterr().err


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        land(spark, "csv", f"{tmp_path}/none*.csv")
    with pytest.raises(ValueError, match="unknown file format"):
        land(spark, "xml", f"{tmp_path}/x")
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        land(spark, "json", f"{tmp_path}/bad.json").collect()
    (tmp_path / "q.csv").write_text('a,b\n"x, y","say ""hi"""\n')
    assert land(spark, "csv", f"{tmp_path}/q.csv").first()["payload"] == {"a": "x, y", "b": 'say "hi"'}
    (tmp_path / "m.csv").write_bytes(b'a,b\r\n1,"two\nlines, here"\r\n\r\n"p\r\n\r\nq",z\n5\n6,7,8')
    got = [r["payload"] for r in land(spark, "csv", f"{tmp_path}/m.csv").orderBy("place").collect()]
    assert got == [{"a": "1", "b": "two\nlines, here"}, {"a": "p\r\n\r\nq", "b": "z"}, {"a": "5"}, {"a": "6", "b": "7"}]


def bad(more: str = "", source: str = "natural_key: [a], expected_columns: [a]", layer2: str = "target: t", layer3: str = "[]") -> str:
    return f"name: t\nsource: {{format: csv, glob: x, {source}}}\nlayer1: {{target: r}}\nlayer2: {{{layer2}}}\nlayer3: {layer3}\n{more}"


BAD = {
    "lacks 'source'": "name: t\nkind: table\n",
    "lacks 'layer1'": "name: t\nkind: table\nsource: {format: csv}\n",
    "unknown kind": "name: t\nkind: view\n",
    "empty or not a mapping": "",
    "unknown strategy": bad(layer3="[{strategy: magic, target: t}]"),
    "must be a list of strings": bad(source="natural_key: a"),
    "severity must be": bad(layer2="target: t, dq_checks: [{name: n, sql: s, severity: BAD}]"),
    "names repeat": bad(layer2="target: t, dq_checks: [{name: n, sql: s, severity: INFO}, {name: n, sql: s, severity: INFO}]"),
    "must be a list of mappings": bad(layer2="target: t, dq_checks: x"),
    "belongs in layer2": bad("dq_checks: []\n"),
    "needs the columns": bad("orchestration: {requires_scd2_baseline: true}\n", layer3=f"[{{strategy: scd2_apply, target: {P.SNAPSHOT}}}]"),
    "needs orchestration.requires_scd2_baseline": bad(source="natural_key: [client_id, lsn], expected_columns: [client_id, lsn, commit_ts, op, after]", layer3=f"[{{strategy: scd2_apply, target: {P.SNAPSHOT}}}]"),
    "needs cdc_source_glob": bad(layer3="[{strategy: scd2_baseline_seed, target: w}]"),
    "needs event_date_column": bad(layer3="[{strategy: fact_upsert, target: w}]"),
    "unknown rule": bad(layer3="[{strategy: fact_upsert, target: w, event_date_column: d, fk_resolution: {dim_client: inferred}}]"),
    "lacks dim_target": bad(layer3="[{strategy: fact_upsert, target: w, event_date_column: d, fk_resolution: {k: {from_column: a}}}]"),
    "needs orchestration.requires_dim_instrument": bad(layer3="[{strategy: fact_upsert, target: w, event_date_column: d, fk_resolution: {k: {from_column: a, dim_target: warehouse.dim_instrument, dim_natural_key: n, dim_surrogate_key: s}}}]"),
    "late_arrival needs": bad(source="natural_key: [a], late_arrival: {threshold_days: 2}"),
    "exactly one of": "name: t\nkind: derived_dimension\ntarget: t\nsource_column: a\ntarget_key_column: a\n",
    "'from' is after 'to'": "name: t\nkind: generated_dimension\ntarget: t\nfrom: 2024-02-01\nto: 2024-01-01\n",
}


@pytest.mark.parametrize("message", BAD)
def test_bad_configs(tmp_path, message):
    p = tmp_path / "c.yml"
    p.write_text(BAD[message])
    with pytest.raises(ConfigError, match=message) as e:
        load_one(p)
    assert str(p) in str(e.value)


def test_cli(world, tmp_path):
    assert main(["--validate-all", str(world / "conf")]) == 0
    assert main(["--validate-all", str(tmp_path)]) == 1
    assert main([]) == 2

"""Configuration: one YAML document per table, dimension or reconciliation, validated so that every error names its file.

A table has ``name``, ``kind: table`` and

* ``source``: format, glob (under the data folder), natural_key, expected_columns, aliases, and for late arrivals ``late_arrival``
  (event_date_col, threshold_days, delivery_date with ``from: filename`` and a pattern);
* ``layer1``: target, the raw table;
* ``layer2``: target, conflict_strategy, update_columns, dq_checks, ge_suite (the name of a suite of expectations);
* ``layer3``: a list of strategies, each with target, columns and what it needs itself;
* ``orchestration``: schedule, start_date, catchup, tags, and what to wait for.

A derived dimension has source_table or raw_source_glob, source_column, target, target_key_column and derived_columns; a
generated one target, from and to. Reconciliations have name, key, left and right.
"""

from __future__ import annotations

import datetime
import sys
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

#: Fixed values.
KINDS = ("table", "derived_dimension", "generated_dimension")
STRATEGIES = ("dimension_upsert", "fact_upsert", "scd2_apply", "scd2_baseline_seed")
SEVERITIES = ("INFO", "WARNING", "CRITICAL")
FK_WORDS = {"dim_client": "inferred_member_on_miss", "risk_snapshot": "snapshotted_fk"}
FK_KEYS = ("from_column", "dim_target", "dim_natural_key", "dim_surrogate_key")
CDC_COLUMNS = ("client_id", "lsn", "commit_ts", "op", "after")
CDC_TARGET = "warehouse.dim_client_risk_snapshot"


class ConfigError(ValueError):
    def __init__(self, path: Path | str, message: str):
        super().__init__(f"{path}: {message}")


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    sql: str


@dataclass(frozen=True)
class Strategy:
    strategy: str
    target: str
    columns: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)

    def lookups(self) -> dict[str, dict]:
        """Columns resolved in another dimension."""
        return {c: r for c, r in self.options.get("fk_resolution", {}).items() if isinstance(r, dict)}


@dataclass(frozen=True)
class TableConfig:
    name: str
    file_format: str
    glob: str
    raw: str
    target: str
    natural_key: tuple[str, ...]
    expected_columns: tuple[str, ...]
    aliases: dict[str, str]
    update_columns: tuple[str, ...]
    conflict_strategy: str | None
    late_arrival: dict[str, Any] | None
    checks: tuple[Check, ...]
    suite: str | None
    strategies: tuple[Strategy, ...]
    orchestration: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DerivedDimension:
    name: str
    target: str
    source_column: str
    natural_key: str
    source_table: str | None
    raw_source_glob: str | None
    attributes: dict[str, dict[str, str]]


@dataclass(frozen=True)
class GeneratedDimension:
    name: str
    target: str
    first: datetime.date
    last: datetime.date


@dataclass(frozen=True)
class Reconciliation:
    name: str
    key: tuple[str, ...]
    left_sql: str
    right_sql: str


def _read(path: Path) -> dict:
    doc = yaml.safe_load(Path(path).read_text())
    if not isinstance(doc, dict) or not doc:
        raise ConfigError(path, "is empty or not a mapping")
    return doc


def _need(path, doc: dict, key: str, kind: type | tuple = object):
    if key not in doc:
        raise ConfigError(path, f"lacks {key!r}")
    if not isinstance(doc[key], kind):
        raise ConfigError(path, f"{key!r} has the wrong type ({type(doc[key]).__name__})")
    return doc[key]


def _strings(path, doc: dict, key: str, required: bool = True) -> tuple[str, ...]:
    if key not in doc and not required:
        return ()
    got = _need(path, doc, key)
    if not isinstance(got, list) or not all(isinstance(x, str) for x in got) or (required and not got):
        raise ConfigError(path, f"{key!r} must be a list of strings")
    return tuple(got)


def _checks(path, layer2: dict) -> tuple[Check, ...]:
    got = layer2.get("dq_checks", [])
    if not isinstance(got, list) or not all(isinstance(c, dict) for c in got):
        raise ConfigError(path, "'dq_checks' must be a list of mappings")
    out = []
    for c in got:
        for k in ("name", "sql"):
            if not isinstance(c.get(k), str):
                raise ConfigError(path, f"a dq check's {k!r} must be a string")
        if c.get("severity") not in SEVERITIES:
            raise ConfigError(path, f"dq check {c['name']!r}: severity must be one of {', '.join(SEVERITIES)}")
        out.append(Check(c["name"], c["severity"], c["sql"]))
    if len({c.name for c in out}) < len(out):
        raise ConfigError(path, "dq check names repeat")
    return tuple(out)


def _fk_rules(path, kind: str, rules: Any, waits: dict) -> None:
    if not isinstance(rules, dict):
        raise ConfigError(path, "fk_resolution must be a mapping")
    for column, rule in rules.items():
        if isinstance(rule, str):
            if kind != "fact_upsert" or rule not in FK_WORDS.values():
                raise ConfigError(path, f"fk_resolution of {column!r}: unknown rule {rule!r}")
            continue
        lost = [k for k in FK_KEYS if k not in rule] if isinstance(rule, dict) else list(FK_KEYS)
        if lost:
            raise ConfigError(path, f"fk_resolution of {column!r} lacks {', '.join(lost)}")
        if kind == "fact_upsert" and rule["dim_target"] == "warehouse.dim_instrument" and waits.get("requires_dim_instrument") is not True:
            raise ConfigError(path, f"fk_resolution of {column!r} needs orchestration.requires_dim_instrument: true")


def _strategy(path, doc: Any, expected: tuple[str, ...], waits: dict) -> Strategy:
    if not isinstance(doc, dict):
        raise ConfigError(path, "a layer3 entry must be a mapping")
    kind = _need(path, doc, "strategy", str)
    if kind not in STRATEGIES:
        raise ConfigError(path, f"unknown strategy {kind!r}; known: {', '.join(STRATEGIES)}")
    target, columns = _need(path, doc, "target", str), _strings(path, doc, "columns", False)
    rest = {k: v for k, v in doc.items() if k not in ("strategy", "target", "columns")}
    if kind == "scd2_apply":
        if lost := [c for c in CDC_COLUMNS if c not in expected and c not in columns]:
            raise ConfigError(path, f"scd2_apply needs the columns {', '.join(lost)}")
        if target != CDC_TARGET:
            raise ConfigError(path, f"scd2_apply writes to {CDC_TARGET} only")
        if waits.get("requires_scd2_baseline") is not True:
            raise ConfigError(path, "scd2_apply needs orchestration.requires_scd2_baseline: true")
    if kind == "scd2_baseline_seed" and not isinstance(rest.get("cdc_source_glob"), str):
        raise ConfigError(path, "scd2_baseline_seed needs cdc_source_glob")
    if kind == "fact_upsert":
        if not isinstance(rest.get("event_date_column"), str):
            raise ConfigError(path, "fact_upsert needs event_date_column")
        if not isinstance(rest.get("literals", {}), dict):
            raise ConfigError(path, "fact_upsert's literals must be a mapping")
    _fk_rules(path, kind, rest.get("fk_resolution", {}), waits)
    # a column named twice counts once
    return Strategy(kind, target, tuple(dict.fromkeys(columns)), rest)


def _late(path, late: Any) -> dict | None:
    if late is None:
        return None
    delivery = late.get("delivery_date") if isinstance(late, dict) else None
    if not isinstance(delivery, dict) or delivery.get("from") != "filename" or not isinstance(delivery.get("pattern"), str):
        raise ConfigError(path, "late_arrival needs a delivery_date with from: filename and a pattern")
    if not isinstance(late.get("threshold_days"), int) or not isinstance(late.get("event_date_col"), str):
        raise ConfigError(path, "late_arrival needs event_date_col and threshold_days")
    return late


def _table(path, doc: dict, name: str) -> TableConfig:
    source = _need(path, doc, "source", dict)
    one, two, three = _need(path, doc, "layer1", dict), _need(path, doc, "layer2", dict), _need(path, doc, "layer3", list)
    if any("dq_checks" in x for x in (doc, source, one)):
        raise ConfigError(path, "'dq_checks' belongs in layer2")
    expected = tuple(dict.fromkeys(_strings(path, source, "expected_columns", False)))
    waits = doc.get("orchestration") or {}
    if not isinstance(waits, dict):
        raise ConfigError(path, "'orchestration' must be a mapping")
    suite = two.get("ge_suite")
    if suite is not None and not isinstance(suite, str):
        raise ConfigError(path, "'ge_suite' must be a name")
    return TableConfig(
        name,
        _need(path, source, "format", str),
        _need(path, source, "glob", str),
        _need(path, one, "target", str),
        _need(path, two, "target", str),
        tuple(dict.fromkeys(_strings(path, source, "natural_key"))),
        expected,
        source.get("aliases") or {},
        tuple(dict.fromkeys(_strings(path, two, "update_columns", False))),
        two.get("conflict_strategy"),
        _late(path, source.get("late_arrival")),
        _checks(path, two),
        suite,
        tuple(_strategy(path, s, expected, waits) for s in three),
        waits,
    )


def load_one(path: Path | str) -> TableConfig | DerivedDimension | GeneratedDimension:
    path = Path(path)
    doc = _read(path)
    kind = doc.get("kind", "table")
    if kind not in KINDS:
        raise ConfigError(path, f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    name = _need(path, doc, "name", str)
    if kind == "table":
        return _table(path, doc, name)
    target = _need(path, doc, "target", str)
    if kind == "generated_dimension":
        try:
            first, last = (datetime.date.fromisoformat(str(_need(path, doc, k))) for k in ("from", "to"))
        except ValueError as e:
            raise ConfigError(path, f"dates must be ISO dates: {e}") from e
        if first > last:
            raise ConfigError(path, "'from' is after 'to'")
        return GeneratedDimension(name, target, first, last)
    sources = [k for k in ("source_table", "raw_source_glob") if doc.get(k)]
    if len(sources) != 1:
        raise ConfigError(path, "needs exactly one of source_table and raw_source_glob")
    column, key = _need(path, doc, "source_column", str), _need(path, doc, "target_key_column", str)
    maps = doc.get("derived_columns") or {}
    if not isinstance(maps, dict) or not all(isinstance(m, dict) for m in maps.values()):
        raise ConfigError(path, "'derived_columns' must map columns to value maps")
    return DerivedDimension(name, target, column, key, doc.get("source_table"), doc.get("raw_source_glob"), maps)


def load_reconciliation(path: Path | str) -> Reconciliation:
    doc = _read(Path(path))
    return Reconciliation(_need(path, doc, "name", str), _strings(path, doc, "key"), _need(path, doc, "left", str), _need(path, doc, "right", str))


def load_all(folder: Path | str) -> tuple[list, list[Reconciliation]]:
    """All of ``tables`` and ``reconciliations`` under ``folder``; no config, a missing folder or a repeated name is an error."""
    folder = Path(folder)
    for sub in ("tables", "reconciliations"):
        if not (folder / sub).is_dir():
            raise ConfigError(folder / sub, "is not a folder")
    tables = [load_one(p) for p in sorted((folder / "tables").glob("*.yml"))]
    if not tables:
        raise ConfigError(folder / "tables", "has no configs")
    recons = [load_reconciliation(p) for p in sorted((folder / "reconciliations").glob("*.yml"))]
    names = [c.name for c in [*tables, *recons]]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(folder, f"repeated names: {', '.join(twice)}")
    return tables, recons


def event_date_columns(tables: list) -> dict[str, str]:
    """Fact table -> its event date column."""
    strategies = [s for t in tables if isinstance(t, TableConfig) for s in t.strategies]
    return {s.target: s.options["event_date_column"] for s in strategies if s.strategy == "fact_upsert"}


def main(args: list[str]) -> int:
    """``python -m lakeloom.config --validate-all FOLDER``: 0 valid, 1 invalid, 2 usage."""
    if len(args) != 2 or args[0] != "--validate-all":
        print("usage: python -m lakeloom.config --validate-all FOLDER", file=sys.stderr)
        return 2
    try:
        tables, recons = load_all(args[1])
    except (ConfigError, OSError, yaml.YAMLError) as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{len(tables)} tables and dimensions, {len(recons)} reconciliations: valid")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

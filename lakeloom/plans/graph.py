"""Graphs of steps: what a table's run, the bootstrap and a reconciliation consist of, and in which order.

Steps run one after another in an order that keeps all edges; each is a Spark job that uses the whole cluster by itself. A step that
fails leaves the steps behind it undone, and the others run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lakeloom.config import DerivedDimension, GeneratedDimension, Reconciliation, TableConfig
from lakeloom.plans import pipeline as P


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]
    after: tuple[str, ...] = ()


@dataclass
class Report:
    """What became of each step: its result, its error, or the step that it would have needed."""

    done: dict[str, object] = field(default_factory=dict)
    failed: dict[str, Exception] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.failed and not self.skipped


def ordered(steps: list[Step]) -> list[Step]:
    """The steps in an order that keeps all edges, else as given; a cycle, an unknown or a repeated name is an error."""
    by = {s.name: s for s in steps}
    if len(by) < len(steps):
        raise ValueError("step names repeat")
    out: list[Step] = []
    placed: set[str] = set()
    left = list(steps)
    while left:
        unknown = [a for s in left for a in s.after if a not in by]
        ready = [s for s in left if set(s.after) <= placed]
        if unknown or not ready:
            raise ValueError(f"unknown steps {unknown}" if unknown else f"a cycle among {[s.name for s in left]}")
        out.append(ready[0])
        placed.add(ready[0].name)
        left.remove(ready[0])
    return out


def execute(steps: list[Step]) -> Report:
    report = Report()
    for s in ordered(steps):
        lost = next((a for a in s.after if a in report.failed or a in report.skipped), None)
        if lost is not None:
            report.skipped[s.name] = lost
            continue
        try:
            report.done[s.name] = s.run()
        except Exception as e:  # noqa: BLE001 - the report has it, and what depends on it is skipped
            report.failed[s.name] = e
    return report


def table_steps(cfg: TableConfig, wh: P.Warehouse, run_id: str, poke: float = 30, timeout: float = 3600) -> list[Step]:
    """Wait, land, stage, check, load; the wait only where the config asks for one."""
    n = cfg.name
    out, first = [], ()
    if any(cfg.orchestration.get(w) for w in P.WAITS):
        out.append(Step(f"{n}.wait", lambda: P.wait(cfg, wh, poke, timeout)))
        first = (f"{n}.wait",)

    def check() -> list[str]:
        with wh.store.transaction():
            return P.check(cfg, wh, run_id)

    return [
        *out,
        Step(f"{n}.land", lambda: P.land(cfg, wh), first),
        Step(f"{n}.stage", lambda: P.stage(cfg, wh), (f"{n}.land",)),
        Step(f"{n}.check", check, (f"{n}.stage",)),
        Step(f"{n}.load", lambda: P.load(cfg, wh), (f"{n}.check",)),
    ]


def reconciliation_steps(cfg: Reconciliation, wh: P.Warehouse, run_id: str) -> list[Step]:
    return [Step(f"reconcile.{cfg.name}", lambda: P.run_reconciliation(cfg, wh, run_id))]


def bootstrap_steps(tables: list, wh: P.Warehouse) -> list[Step]:
    """All dimensions and the baseline. Tables that load a dimension come one after another, as they write columns of the same rows:
    first those that only upsert, then those that seed the baseline; derived dimensions come after the tables they are made from and
    before those that look keys up in them."""
    out: list[Step] = []
    loads = [t for t in tables if isinstance(t, TableConfig) and any(s.strategy == "dimension_upsert" for s in t.strategies)]
    loads.sort(key=lambda t: (any(s.strategy == "scd2_baseline_seed" for s in t.strategies), t.name))
    derived = {d.target: d for d in tables if isinstance(d, DerivedDimension)}
    before: tuple[str, ...] = ()
    for t in loads:
        # the columns that several tables own are written by one at a time
        out.append(Step(f"stage_{t.name}", lambda t=t: (P.land(t, wh), P.stage(t, wh))[1], before))
        needs = [derived[r["dim_target"]] for s in t.strategies for r in s.lookups().values() if r["dim_target"] in derived]
        after = (f"stage_{t.name}", *(f"build_{d.name}" for d in needs))
        out.append(Step(f"load_{t.name}", lambda t=t: P.load(t, wh), tuple(dict.fromkeys(after))))
        before = (f"load_{t.name}",)
    staged = {t.name for t in loads}
    for d in tables:
        if isinstance(d, DerivedDimension):
            if d.source_table and d.source_table not in staged:
                continue  # made from a table that the bootstrap doesn't stage
            out.append(Step(f"build_{d.name}", lambda d=d: P.run_dimension(d, wh), (f"stage_{d.source_table}",) if d.source_table else ()))
        elif isinstance(d, GeneratedDimension):
            out.append(Step(f"build_{d.name}", lambda d=d: P.run_dimension(d, wh)))
    names = {s.name for s in out}
    out = [Step(s.name, s.run, tuple(a for a in s.after if a in names)) for s in out]
    out.append(Step("bootstrap_complete", lambda: None, tuple(names)))
    return out

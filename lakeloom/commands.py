"""Commands over a store. Exit codes: 0 done, 1 failed, 2 usage.

    python -m lakeloom.commands migrate STORE
    python -m lakeloom.commands bootstrap STORE CONFIG DATA
    python -m lakeloom.commands run STORE CONFIG DATA [TABLE ...]
    python -m lakeloom.commands reconcile STORE CONFIG DATA [NAME ...]
    python -m lakeloom.commands reload STORE CONFIG DATA START STOP
    python -m lakeloom.commands dump-state STORE CONFIG
    python -m lakeloom.commands verify STORE CONFIG DATA

``run`` takes all tables with a schedule unless some are named. ``verify`` migrates, bootstraps and runs everything twice, and fails
unless the state after both runs is the same.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import SparkSession

from lakeloom.config import TableConfig, event_date_columns, load_all
from lakeloom.plans import graph, migrations
from lakeloom.plans import pipeline as P
from lakeloom.plans.store import Store

#: Commands and the least and most arguments of each.
COMMANDS = {"migrate": (1, 1), "bootstrap": (3, 3), "run": (3, None), "reconcile": (3, None), "reload": (5, 5), "dump-state": (2, 2), "verify": (3, 3)}


class Failed(RuntimeError):
    """A step of a command failed."""


def _finish(report: graph.Report) -> None:
    for name, result in report.done.items():
        print(f"{name}: done" + (f" ({result})" if result is not None else ""))
    for name, error in report.failed.items():
        print(f"{name}: failed: {error}", file=sys.stderr)
    for name, lost in report.skipped.items():
        print(f"{name}: skipped, as {lost} didn't run", file=sys.stderr)
    if not report.ok:
        raise Failed(", ".join(report.failed))


def _picked(all_: list, names: list[str], what: str) -> list:
    if unknown := [n for n in names if n not in [x.name for x in all_]]:
        raise Failed(f"unknown {what}: {', '.join(unknown)}")
    return [x for x in all_ if x.name in names]


def bootstrap(wh: P.Warehouse, config: str) -> None:
    _finish(graph.execute(graph.bootstrap_steps(load_all(config)[0], wh)))


def run(wh: P.Warehouse, config: str, names: list[str], run_id: str, poke: float = 30, timeout: float = 3600) -> None:
    tables = [t for t in load_all(config)[0] if isinstance(t, TableConfig)]
    chosen = _picked(tables, names, "tables") if names else [t for t in tables if t.orchestration.get("schedule", "@daily")]
    _finish(graph.execute([s for t in chosen for s in graph.table_steps(t, wh, run_id, poke, timeout)]))


def reconcile(wh: P.Warehouse, config: str, names: list[str], run_id: str) -> None:
    recons = load_all(config)[1]
    chosen = _picked(recons, names, "reconciliations") if names else recons
    _finish(graph.execute([s for r in chosen for s in graph.reconciliation_steps(r, wh, run_id)]))


def state(store: Store, config: str) -> list[str]:
    """The state, for a store whose state fits the driver; ``dump-state`` itself goes row by row."""
    return [r["line"] for r in P.state_lines(store, event_date_columns(load_all(config)[0])).collect()]


def verify(wh: P.Warehouse, config: str) -> None:
    migrations.migrate(wh.store)
    bootstrap(wh, config)
    states = []
    for i in range(2):
        run(wh, config, [], f"verify-{i}", poke=1, timeout=0)
        reconcile(wh, config, [], f"verify-{i}")
        states.append(state(wh.store, config))
    if states[0] != states[1]:
        raise Failed("a second run changed the state")
    print(f"verified: {len(states[0])} lines of state, the same after both runs")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    least, most = COMMANDS.get(args[0], (0, 0)) if args else (0, 0)
    if not least or not least <= len(args) - 1 <= (most if most is not None else len(args)):
        print(__doc__, file=sys.stderr)
        return 2
    if spark is None:
        from lakeloom.session import build

        spark = build()
    command, root, rest = args[0], args[1], args[2:]
    store = Store(spark, root)
    wh = P.Warehouse(store, rest[1] if len(rest) > 1 else "")
    run_id = f"{command}-{uuid.uuid4().hex[:12]}"
    try:
        if command == "migrate":
            made = migrations.migrate(store)
            print(f"applied {len(made)}: {', '.join(made)}" if made else "nothing to apply")
        elif command == "bootstrap":
            bootstrap(wh, rest[0])
        elif command == "run":
            run(wh, rest[0], rest[2:], run_id)
        elif command == "reconcile":
            reconcile(wh, rest[0], rest[2:], run_id)
        elif command == "reload":
            print(P.historical_reload(wh, rest[2], rest[3], event_date_columns(load_all(rest[0])[0])))
        elif command == "dump-state":
            for r in P.state_lines(store, event_date_columns(load_all(rest[0])[0])).toLocalIterator():
                print(r["line"])
        else:
            verify(wh, rest[0])
    except Exception as e:  # noqa: BLE001 - a command ends with a message and a code
        print(f"{command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

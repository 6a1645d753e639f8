"""Migrations of a store: an ordered list of steps, each applied once and recorded with a digest of what it did.

A step is a table to create from the registry. The ledger, a document beside the log, has the digest of each applied step; a step
whose table has since got another schema or key is drift, and an error. ``python -m lakeloom.commands migrate STORE`` runs them.
"""

from __future__ import annotations

import hashlib
import json

from lakeloom.plans.store import Store
from lakeloom.schemas import TABLES

LEDGER = "_migrations/ledger.json"


class Drift(RuntimeError):
    """A step differs from what was applied."""


def steps() -> list[tuple[str, str]]:
    """(name, digest) of all steps in order."""
    out = []
    for i, t in enumerate(TABLES.values()):
        plan = json.dumps([t.name, t.ddl, t.key, t.references, t.partition], sort_keys=True)
        out.append((f"{i:03d}_{t.name}", hashlib.sha256(plan.encode()).hexdigest()))
    return out


def ledger(store: Store) -> dict[str, str]:
    p, fs = store._fs(LEDGER)
    return store._get(LEDGER) if fs.exists(p) else {}


def migrate(store: Store) -> list[str]:
    """Apply the steps not yet recorded; returns their names (none on a second run). All become visible in one commit, which only
    one of several writers can make."""
    known, made = ledger(store), []
    for name, digest in steps():
        if known.get(name, digest) != digest:
            raise Drift(f"migration {name} has changed since it was applied")
    with store.transaction():
        for name, digest in steps():
            if name in known:
                continue
            table = name.split("_", 1)[1]
            if not store.exists(table):
                store.write(table, store.spark.createDataFrame([], TABLES[table].schema))
            known[name] = digest
            made.append(name)
    if made:
        p, fs = store._fs(LEDGER)
        fs.mkdirs(p.getParent())
        tmp, _ = store._fs("_migrations/ledger.old")
        fs.delete(tmp, False)
        if fs.exists(p) and not fs.rename(p, tmp):
            raise OSError(f"can't replace {p}")
        fs.mkdirs(store._fs("_log/x")[0].getParent())
        store._put(LEDGER, known)
    return made

"""All registered queries and their SQL."""

from __future__ import annotations

from workloads import code, notes, snapshots, streams, text, usage

MODULES = [usage, text, code, snapshots, notes, streams]


def queries():
    return {fn.__name__: fn for m in MODULES for fn in m.QUERIES}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}

"""All queries of the core. Those of optional subpackages are added by __spark_entry__."""

from __future__ import annotations

from tidemark.plans import problems, reference, streams

MODULES = (problems, reference, streams)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

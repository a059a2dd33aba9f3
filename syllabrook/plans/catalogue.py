"""All queries of the core, by name, with the SQL that gives the same result."""

from __future__ import annotations

from syllabrook.plans import amounts, catalog, documents, lookups, matching, records, stateful
from syllabrook.plans.registry import Query

_MODULES = (catalog, matching, records, documents, stateful, lookups)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"p3_found": amounts.p3_found, "p3_minutes": amounts.p3_minutes}
    for m in _MODULES:
        out |= m.registry.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.registry.sql
    return out

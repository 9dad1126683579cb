"""Queries of the core engine and their DuckDB counterparts."""

from __future__ import annotations

from mensura.plans import catalogue, drawing, streams, takeoff

MODULES = (catalogue, streams, takeoff, drawing)


def _united(tables: list[dict]) -> dict:
    """All entries; a name that two modules give is an error, as one would hide the other."""
    out: dict = {}
    for table in tables:
        if twice := out.keys() & table.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= table
    return out


QUERIES = _united([m.QUERIES for m in MODULES])
ORACLE_SQL = _united([m.ORACLE_SQL for m in MODULES])
FLAGSHIP = "boq_rollup"

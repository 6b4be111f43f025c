"""Registry of the core queries and of the SQL they are compared with."""

from __future__ import annotations

from . import dsp, generated, records, signals

MODULES = (records, signals, generated, dsp)


def core_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def core_oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

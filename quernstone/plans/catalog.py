"""All queries of the core by name, with SQL for those that SQL can express."""

from __future__ import annotations

from quernstone.plans import corpus_queries, ledger_queries, model_queries, telemetry_queries

PARTS = (corpus_queries, ledger_queries, telemetry_queries, model_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}

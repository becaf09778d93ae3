"""The engine's query catalogue: every module adds its queries and oracles."""

from __future__ import annotations

from tideline.plans import block_queries, correlation_queries, extra_queries, fold_queries, ledger_queries, service_queries, state_queries

MODULES = (state_queries, fold_queries, block_queries, correlation_queries, ledger_queries, extra_queries, service_queries)


def queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

"""Registry of named queries over the given tables and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the SQL (when the operator is
SQL-expressible) computes the same columns over the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = [
    "tessera.plans.q_lexical",
    "tessera.plans.q_render",
    "tessera.plans.q_filters",
    "tessera.plans.q_dense",
    "tessera.plans.q_rerank",
    "tessera.plans.q_reports",
    "tessera.plans.q_guard",
    "tessera.plans.q_dataset",
    "tessera.plans.q_stages",
    "tessera.plans.q_eval",
    "tessera.plans.q_stream",
    "tessera.plans.q_more",
    "tessera.plans.q_extra",
    "tessera.plans.q_pruned",
    "tessera.plans.q_ann",
    "tessera.plans.q_needles",
    "tessera.plans.q_models",
    "tessera.plans.q_plugins",
]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)

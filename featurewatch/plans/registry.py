"""Query registry: every operator key of SURVEY §2 mapped to a Spark plan on
the driver tables and, where SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

import importlib

_MODULES = ["q_drift", "q_log", "q_classify", "q_features", "q_store", "q_quality", "q_ml", "q_stream"]


def _collect():
    queries, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"featurewatch.plans.{m}")
        queries.update(mod.Q)
        sql.update(mod.SQL)
    return queries, sql


def queries():
    return _collect()[0]


def oracle_sql():
    return _collect()[1]

"""Registered queries: name -> Spark builder ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB oracle text.

Queries are grouped in modules under ``carelake.queries``; each module
exposes ``QUERIES`` and ``ORACLES`` dicts that are merged here.
"""

from __future__ import annotations

import importlib

MODULES = [
    "carelake.queries.silver_q",
    "carelake.queries.reports_q",
    "carelake.queries.operators_q",
    "carelake.queries.dq_q",
    "carelake.queries.checks_q",
    "carelake.queries.tables_q",
]


def _load():
    queries, oracles = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        queries.update(mod.QUERIES)
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def queries():
    return _load()[0]


def oracles():
    return _load()[1]

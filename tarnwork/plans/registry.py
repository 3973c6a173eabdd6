"""All queries of the core with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules with QUERIES and SQL.
MODULES = ("hierarchy_queries", "packed_queries", "unit_queries", "scalar_queries", "join_queries", "aggregate_queries", "ranking_queries", "statistics_queries", "graph_queries", "evaluation_queries", "evidence_queries", "rule_queries", "match_queries", "layer_queries", "report_queries", "input_queries")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out.update(importlib.import_module(f"tarnwork.plans.{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(importlib.import_module(f"tarnwork.plans.{m}").SQL)
    return out

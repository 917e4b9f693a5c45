"""Queries that bind the operators to the tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from evgraph.plans import dataset_plans, feature_plans, graph_plans, link_plans, metric_plans, model_plans, selection_plans, table_plans, unit_plans

_PARTS = (unit_plans, graph_plans, metric_plans, link_plans, table_plans, model_plans, feature_plans, selection_plans, dataset_plans)


def queries() -> dict:
    out = {k: f for part in _PARTS for k, (f, _) in part.ORACLES.items()}
    for part in _PARTS:
        out |= getattr(part, "ROWS_ONLY", {})
    return out


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, (_, s) in part.ORACLES.items()}

"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("bayes_queries", "structure_queries", "cluster_queries", "graph_queries", "log_queries")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"sparkloom.plans.{family}")
        merged.update(getattr(module, attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")

"""Registered queries: importing ``load`` fills the registry."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    from alertloom.plans import comparison_queries, evaluation_queries, grouping_queries, mining_queries, report_queries, window_queries  # noqa: F401
    from alertloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES

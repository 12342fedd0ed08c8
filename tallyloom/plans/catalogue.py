"""All queries over the test tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from tallyloom.plans import audit_queries, fixture_queries, record_queries, score_queries, state_queries, text_queries  # noqa: F401  they register themselves
from tallyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries over the given tables."""

from workload import rules, runs, tables, vetting  # noqa: F401
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

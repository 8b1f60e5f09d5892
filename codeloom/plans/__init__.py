"""Queries: operators bound to tables, with their SQL."""

from codeloom.plans import analytic, composites, extraction, facts, indexed, listings, relational, resolved, rules, upkeep  # noqa: F401
from codeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

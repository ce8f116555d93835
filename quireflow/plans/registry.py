"""Registered queries and their oracle SQL."""

from __future__ import annotations

from quireflow.plans import format_queries  # noqa: F401  (adds its queries)
from quireflow.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

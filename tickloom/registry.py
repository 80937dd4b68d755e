"""All queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from tickloom.plans import adaptive, learned, ledgers, online, reports, runs, scans, signals, sources_joins  # noqa: F401
from tickloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from runloom.plans import (  # noqa: F401
    queries_depth,
    queries_records,
    queries_reports,
    queries_sql,
    queries_streams,
    queries_types,
)
from runloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

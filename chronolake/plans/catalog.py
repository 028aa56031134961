"""Every registered query with its oracle, by name."""

from . import asof_queries, audit_queries, composite_queries, join_queries, perf_queries, scan_queries, stream_queries, time_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

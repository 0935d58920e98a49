"""All registered queries over the driver tables, and their oracle SQL."""

from __future__ import annotations

from . import audit_queries, flow_queries, fold_queries, placing_queries, scalar_queries, service_queries, timeline_queries

_PARTS = (audit_queries, scalar_queries, timeline_queries, fold_queries, placing_queries, flow_queries, service_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

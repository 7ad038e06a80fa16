"""All queries of the drawing engine, by name, and the SQL to hold them against."""

from __future__ import annotations

from tracegrid.plans import audit_queries, counterfactual_queries, export_queries, graph_queries, integrity_queries, model_queries, object_queries, offgrid_queries, semantic_queries, shape_queries

_PARTS = (graph_queries, offgrid_queries, semantic_queries, object_queries, model_queries, integrity_queries, audit_queries, shape_queries, counterfactual_queries, export_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}

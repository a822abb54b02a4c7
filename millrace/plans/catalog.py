"""All queries, by name."""

from __future__ import annotations

from . import builder_queries, dataset_queries, held_out_queries, log_queries, metric_queries, more_queries, panel_queries, report_queries, sampling_queries, text_queries

CATALOGS = (text_queries.C, sampling_queries.C, metric_queries.C, log_queries.C, builder_queries.C, more_queries.C, dataset_queries.C, held_out_queries.C, report_queries.C, panel_queries.C)
QUERIES = {name: f for c in CATALOGS for name, f in c.queries.items()}
SQL = {name: s for c in CATALOGS for name, s in c.sql.items()}

"""All queries of the engine on the star-schema tables, with their SQL twins."""

from __future__ import annotations

from lodestone.plans import case_queries, catalogue_queries, design_queries, file_queries, graph_queries, index_queries, mesh_queries, network_queries, percentile_queries, proof_queries, reach_queries, report_queries, retention_queries, rule_queries, source_queries, store_queries, validation_queries, variant_queries  # noqa: F401  they register themselves
from lodestone.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Queries over nested JSON by VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import query, table
from lodestone.sources import variants


@query("""SELECT o_orderkey, 'head.customer' AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'head.marks[0]', o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL SELECT o_orderkey, 'head.marks[1].priority', o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL""")
def order_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a nested document for each order."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    doc = F.concat(F.lit('{"head": {"customer": '), F.col("o_custkey").cast("string"), F.lit(', "marks": ['), quoted("o_orderstatus"), F.lit(', {"priority": '), quoted("o_orderpriority"), F.lit("}]}}"))
    return variants.leaves(table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")), "doc", ["o_orderkey"])


@query("""SELECT 'k' AS path, count(json_extract_string(props, '$.k')) AS n FROM events HAVING count(json_extract_string(props, '$.k')) > 0""")
def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events have each property."""
    return variants.path_counts(variants.leaves(table(spark, sf_dir, "events"), "props", ["event_id"])).where("path = 'k'")

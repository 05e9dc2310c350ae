"""Lineage questions over whole tables, by reachability labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import reachability as R
from lodestone.plans.adapters import GRAPH_SQL, graph
from lodestone.plans.registry import query, table

_WALK = f"""{GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_id LIKE 'o%'
    UNION SELECT w.origin, e.source_id FROM walk w JOIN edges e ON e.target_id = w.artifact_id)"""


def _orders(nodes: DataFrame) -> DataFrame:
    return nodes.where("artifact_id LIKE 'o%'")


@query(f"WITH RECURSIVE {_WALK} SELECT origin, artifact_id, artifact_type FROM walk JOIN nodes USING (artifact_id)")
def reach_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of all orders."""
    nodes, edges = graph(spark, sf_dir)
    return R.ancestors(_orders(nodes), R.labels(nodes, edges)).join(nodes, "artifact_id").select("origin", "artifact_id", "artifact_type")


@query(f"""WITH RECURSIVE {_WALK}, asked AS (SELECT 'n' || c_nationkey AS a, 'o' || o_orderkey AS b FROM orders JOIN customer ON c_custkey = o_custkey // 2 + 1 UNION SELECT 'c1', 'o' || o_orderkey FROM orders)
    SELECT a, b, EXISTS (SELECT 1 FROM walk WHERE origin = b AND artifact_id = a) AS reaches FROM asked""")
def reach_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some nation, and a customer on a cycle, is an ancestor of each order."""
    nodes, edges = graph(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").withColumn("c_custkey", F.floor(F.col("o_custkey") / 2) + 1)
    order = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("b")
    pairs = orders.join(table(spark, sf_dir, "customer"), "c_custkey").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("a"), order)
    return R.reaches(pairs.union(orders.select(F.lit("c1"), order)), R.labels(nodes, edges))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, up AS (SELECT artifact_id FROM nodes WHERE artifact_type = '1-URGENT' UNION SELECT e.source_id FROM up w JOIN edges e ON e.target_id = w.artifact_id)
    SELECT artifact_id FROM up""")
def reach_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pins on all urgent orders keep."""
    nodes, edges = graph(spark, sf_dir)
    return R.closure(nodes.where("artifact_type = '1-URGENT'"), R.labels(nodes, edges))

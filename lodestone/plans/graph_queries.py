"""Lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import connectivity as K
from lodestone.operators import lineage as G
from lodestone.operators.catalogue import select_records
from lodestone.plans.adapters import GRAPH_SQL, graph
from lodestone.plans.registry import query, table

_UP = "SELECT w.origin, e.source_id FROM walk w JOIN edges e ON e.target_id = w.artifact_id"


def _starts(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "artifact_id string")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_id IN ('o1', 'o50', 'c1', 'gone') UNION {_UP})
    SELECT origin, artifact_id, artifact_type FROM walk JOIN nodes USING (artifact_id)""")
def lineage_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ancestors(*graph(spark, sf_dir), _starts(spark, "o1", "o50", "c1", "gone")).select("origin", "artifact_id", "artifact_type")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_id IN ('r2', 'n3') UNION SELECT w.origin, e.target_id FROM walk w JOIN edges e ON e.source_id = w.artifact_id)
    SELECT origin, artifact_id FROM walk JOIN nodes USING (artifact_id)""")
def lineage_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendants(*graph(spark, sf_dir), _starts(spark, "r2", "n3")).select("origin", "artifact_id")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id, 0 AS d FROM nodes WHERE artifact_id IN ('r2', 'r0') UNION SELECT w.origin, e.target_id, d + 1 FROM walk w JOIN edges e ON e.source_id = w.artifact_id WHERE d < 2 AND relation IN ('derived_from', 'config_of'))
    SELECT origin, artifact_id, CAST(min(d) AS INT) AS depth FROM walk JOIN nodes USING (artifact_id) GROUP BY ALL""")
def lineage_bounded_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendants(*graph(spark, sf_dir), _starts(spark, "r2", "r0"), max_depth=2, relations=["derived_from", "config_of"]).select("origin", "artifact_id", "depth")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_id IN ('o3', 'o4') UNION {_UP})
    SELECT origin, artifact_id FROM walk JOIN nodes USING (artifact_id) WHERE artifact_type IN ('region', 'nation')""")
def lineage_ancestors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ancestors(*graph(spark, sf_dir), _starts(spark, "o3", "o4")).where(F.col("artifact_type").isin("region", "nation")).select("origin", "artifact_id")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_id IN ('o3', 'o9') UNION {_UP}), roled AS (SELECT 'c' || c_custkey AS artifact_id FROM customer WHERE c_acctbal > 0)
    SELECT origin, artifact_id FROM walk JOIN roled USING (artifact_id)""")
def lineage_ancestors_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("artifact_id"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("root_input"))).otherwise(F.array(F.lit("cache"))).alias("roles"))
    return G.ancestors(*graph(spark, sf_dir), _starts(spark, "o3", "o9")).join(own.where(F.array_contains("roles", "root_input")), "artifact_id").select("origin", "artifact_id")


@query(f"WITH {GRAPH_SQL} SELECT artifact_id FROM nodes WHERE artifact_id NOT IN (SELECT target_id FROM edges)")
def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roots(*graph(spark, sf_dir)).select("artifact_id")


@query(f"WITH {GRAPH_SQL} SELECT artifact_id FROM nodes WHERE artifact_id NOT IN (SELECT source_id FROM edges)")
def lineage_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leaves(*graph(spark, sf_dir)).select("artifact_id")


@query(f"WITH {GRAPH_SQL} SELECT target_id, source_id AS artifact_id, relation FROM edges WHERE source_id IN (SELECT artifact_id FROM nodes)")
def lineage_direct_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.direct_inputs(*graph(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL} SELECT 'nodes_by_type' AS statistic, artifact_type AS key, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges_by_relation', relation, count(*) FROM edges GROUP BY 2
    UNION ALL SELECT 'roots', '', count(*) FROM nodes WHERE artifact_id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT 'leaves', '', count(*) FROM nodes WHERE artifact_id NOT IN (SELECT source_id FROM edges)""")
def lineage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_stats(*graph(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT conv_id || '/' || turn AS a, conv_id || '/' || (turn + 1) AS b FROM conversations), n AS (SELECT conv_id || '/' || turn AS id FROM conversations),
    w AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT b FROM e) UNION ALL SELECT e.b, level + 1 FROM w JOIN e ON e.a = w.id WHERE e.b IN (SELECT id FROM n)) SELECT id AS artifact_id, CAST(max(level) AS INT) AS level FROM w GROUP BY id""")
def lineage_topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    name = lambda x: F.concat(F.col("conv_id").cast("string"), F.lit("/"), x.cast("string"))
    nodes = turns.select(name(F.col("turn")).alias("artifact_id"))
    edges = turns.select(name(F.col("turn")).alias("source_id"), name(F.col("turn") + 1).alias("target_id"))
    return G.topological_levels(nodes, edges)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, pins AS (SELECT 'c' || c_custkey AS artifact_id FROM customer WHERE c_custkey % 50 = 1 UNION SELECT 'n4'), walk AS (SELECT artifact_id AS origin, artifact_id FROM pins WHERE artifact_id IN (SELECT artifact_id FROM nodes) UNION {_UP})
    SELECT DISTINCT artifact_id FROM walk WHERE origin <> artifact_id AND artifact_id IN (SELECT artifact_id FROM nodes)""")
def lineage_ancestors_of_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    pins = table(spark, sf_dir, "customer").where("c_custkey % 50 = 1").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("artifact_id")).union(_starts(spark, "n4"))
    return G.ancestors_of_pins(edges, nodes, pins)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_id IN ('o2', 'o7', 'n3') UNION {_UP}), known AS (SELECT origin, artifact_id FROM walk JOIN nodes USING (artifact_id))
    SELECT k.origin, count(*) - 1 AS n_ancestors, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, relation FROM edges JOIN known x ON x.artifact_id = target_id WHERE x.origin = k.origin)) AS n_edges,
    coalesce(list_sort(list(artifact_id) FILTER (artifact_id NOT IN (SELECT target_id FROM edges))), []) AS root_ids FROM known k GROUP BY k.origin""")
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit(*graph(spark, sf_dir), _starts(spark, "o2", "o7", "n3"))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_nationkey AS net, (s_suppkey * 7919) % 1000 AS x, (s_suppkey * 104729) % 1000 AS y, 40 + s_suppkey % 30 AS r FROM supplier),
    e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.net = b.net AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (a.r + b.r) * (a.r + b.r)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT id, id AS c FROM p UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.id) SELECT id, min(c) AS component FROM w GROUP BY id""")
def connectivity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("net"), (key * 7919 % 1000).alias("x"), (key * 104729 % 1000).alias("y"), (40 + key % 30).alias("r"))
    return G.components(K.touching(points, 70), points)


@query("""WITH p AS (SELECT s_suppkey AS id, s_nationkey AS net, (s_suppkey * 7919) % 1000 AS x, (s_suppkey * 104729) % 1000 AS y, 40 + s_suppkey % 30 AS r FROM supplier)
    SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.net = b.net AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (a.r + b.r) * (a.r + b.r)""")
def connectivity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("net"), (key * 7919 % 1000).alias("x"), (key * 104729 % 1000).alias("y"), (40 + key % 30).alias("r"))
    return K.touching(points, 70)


@query(f"WITH {GRAPH_SQL} SELECT artifact_id, artifact_type FROM nodes WHERE artifact_type = 'customer' ORDER BY artifact_id DESC LIMIT 30 OFFSET 5")
def node_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph(spark, sf_dir)
    return select_records(nodes, {"artifact_type": "customer"}, order_by="artifact_id", limit=30, offset=5)

"""Star-schema tables in the shapes that operators take, each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.integrity import placed
from lodestone.plans.registry import table

ARTIFACTS_SQL = """artifacts AS (SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, o_orderpriority AS artifact_type,
    sha256(CAST(o_custkey AS VARCHAR)) AS digest, CAST(floor(o_totalprice) AS BIGINT) AS byte_size,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_utc, CAST(o_custkey AS VARCHAR) AS run_id,
    CASE o_orderstatus WHEN 'F' THEN ['root_input'] WHEN 'O' THEN ['intermediate', 'final_output'] ELSE ['cache'] END AS roles FROM orders)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifact records; orders of one customer share their content."""
    status = F.col("o_orderstatus")
    roles = F.when(status == "F", F.array(F.lit("root_input"))).when(status == "O", F.array(F.lit("intermediate"), F.lit("final_output"))).otherwise(F.array(F.lit("cache")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("artifact_id"),
        F.col("o_orderpriority").alias("artifact_type"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest"),
        F.floor("o_totalprice").cast("bigint").alias("byte_size"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_utc"),
        F.col("o_custkey").cast("string").alias("run_id"),
        roles.alias("roles"),
    )


RUNS_SQL = """runs AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_mktsegment AS stage_name,
    CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 5000 THEN 'completed' ELSE 'running' END AS status FROM customer)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("stage_name"), F.when(balance < 0, "failed").when(balance < 5000, "completed").otherwise("running").alias("status")
    )


GRAPH_SQL = """edges AS (
    SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'derived_from' AS relation FROM nation
    UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'config_of' FROM customer
    UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, 'produced_by' FROM orders
    UNION SELECT 'c1', 'r0', 'back' UNION SELECT 'missing', 'n3', 'derived_from'),
nodes AS (SELECT 'r' || r_regionkey AS artifact_id, 'region' AS artifact_type FROM region
    UNION SELECT 'n' || n_nationkey, 'nation' FROM nation UNION SELECT 'c' || c_custkey, 'customer' FROM customer
    UNION SELECT 'o' || o_orderkey, o_orderpriority FROM orders)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and orders as a lineage graph, with one cycle and one dangling source: (nodes, edges)."""
    t = lambda x: table(spark, sf_dir, x)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda f, a, b, r: f.select(a.alias("source_id"), b.alias("target_id"), F.lit(r).alias("relation"))
    edges = (
        edge(t("nation"), name("r", "n_regionkey"), name("n", "n_nationkey"), "derived_from")
        .union(edge(t("customer"), name("n", "c_nationkey"), name("c", "c_custkey"), "config_of"))
        .union(edge(t("orders"), name("c", "o_custkey"), name("o", "o_orderkey"), "produced_by"))
        .union(spark.createDataFrame([("c1", "r0", "back"), ("missing", "n3", "derived_from")], "source_id string, target_id string, relation string"))
        .distinct()
    )
    node = lambda f, i, k: f.select(i.alias("artifact_id"), k.alias("artifact_type"))
    nodes = (
        node(t("region"), name("r", "r_regionkey"), F.lit("region"))
        .union(node(t("nation"), name("n", "n_nationkey"), F.lit("nation")))
        .union(node(t("customer"), name("c", "c_custkey"), F.lit("customer")))
        .union(node(t("orders"), name("o", "o_orderkey"), F.col("o_orderpriority")))
        .distinct()
    )
    return nodes, edges


#: Vectors whose ids share a range of that many make up a network for each label: networks grow in number with the table, not in length.
POINTS = 250
NETWORK_SQL = f"""named AS (SELECT CAST(label AS VARCHAR) || CASE WHEN vec_id >= {POINTS} THEN '-' || CAST(vec_id // {POINTS} AS VARCHAR) ELSE '' END AS network_id, embedding, vec_id FROM embeddings),
ranked AS (SELECT network_id, embedding, row_number() OVER (PARTITION BY network_id ORDER BY vec_id) AS f_idx FROM named),
networks AS (SELECT network_id, CAST(f_idx AS INT) AS f_idx, f_idx * 1e8 AS freq_hz, i, j,
    2 * CAST(embedding[20 + 4 * (i - 1) + 2 * (j - 1)] AS DOUBLE) AS re, 2 * CAST(embedding[21 + 4 * (i - 1) + 2 * (j - 1)] AS DOUBLE) AS im
    FROM ranked, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) p(i, j))"""


def _cells(ranked: DataFrame) -> DataFrame:
    cell = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (2 * F.col("embedding")[19 + 4 * (i - 1) + 2 * (j - 1)].cast("double")).alias("re"), (2 * F.col("embedding")[20 + 4 * (i - 1) + 2 * (j - 1)].cast("double")).alias("im"))
    return ranked.select("network_id", "f_idx", (F.col("f_idx") * F.lit(1e8)).alias("freq_hz"), F.inline(F.array(cell(1, 1), cell(1, 2), cell(2, 1), cell(2, 2))))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 2-port networks, one per label and range of ids, in long form: network_id, f_idx, freq_hz, i, j, re, im."""
    from pyspark.sql import Window

    part = F.when(F.col("vec_id") >= POINTS, F.concat(F.lit("-"), F.floor(F.col("vec_id") / POINTS).cast("string"))).otherwise("")
    named = table(spark, sf_dir, "embeddings").select(F.concat(F.col("label").cast("string"), part).alias("network_id"), "embedding", "vec_id")
    ranked = named.withColumn("f_idx", F.row_number().over(Window.partitionBy("network_id").orderBy("vec_id")))
    return _cells(ranked)


WHOLE_NETWORK_SQL = """ranked AS (SELECT CAST(label AS VARCHAR) AS network_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f_idx FROM embeddings),
networks AS (SELECT network_id, CAST(f_idx AS INT) AS f_idx, f_idx * 1e8 AS freq_hz, i, j,
    2 * CAST(embedding[20 + 4 * (i - 1) + 2 * (j - 1)] AS DOUBLE) AS re, 2 * CAST(embedding[21 + 4 * (i - 1) + 2 * (j - 1)] AS DOUBLE) AS im
    FROM ranked, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) p(i, j))"""


def whole_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As networks, but one for each label, whose length grows with the table: points are numbered within ranges."""
    named = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("network_id"), "embedding", "vec_id")
    return _cells(placed(named, ["network_id"], ["vec_id"], "f_idx"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as candidate vectors of 19 numbers in [0, 1]."""
    u = F.transform(F.slice("embedding", 1, 19), lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cand_id"), u.alias("u"))

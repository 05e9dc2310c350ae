"""Proofs, verification reports, utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import proofs as P
from lodestone.operators import verification as V
from lodestone.plans.adapters import ARTIFACTS_SQL, artifacts
from lodestone.plans.registry import query, table

_LONG = """r AS (SELECT p_partkey, 'SIZE_MIN' AS constraint_id, 'T0' AS tier, CAST(p_size AS DOUBLE) AS value, CAST(10 AS DOUBLE) AS "limit", CAST(p_size - 10 AS DOUBLE) AS margin, p_size >= 10 AS passed FROM part
    UNION ALL SELECT p_partkey, 'PRICE_MAX', 'T1', p_retailprice, 1800, 1800 - p_retailprice, p_retailprice <= 1800 FROM part
    UNION ALL SELECT p_partkey, 'SIZE_CENTRED', 'T2', p_size, 25, 15 - abs(p_size - 25), abs(p_size - 25) <= 15 FROM part
    UNION ALL SELECT p_partkey, 'BRANDED', 'T2', CAST(p_brand <> 'Brand#1' AS INT), 1, CAST(p_brand <> 'Brand#1' AS INT) - 1, p_brand <> 'Brand#1' FROM part)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return P.evaluate(table(spark, sf_dir, "part"), "p_partkey", [P.at_least("SIZE_MIN", "T0", size, F.lit(10)), P.at_most("PRICE_MAX", "T1", price, F.lit(1800.0)), P.equals("SIZE_CENTRED", "T2", size, F.lit(25), 15), P.holds("BRANDED", "T2", F.col("p_brand") != "Brand#1")])


@query(f'WITH {_LONG} SELECT p_partkey, constraint_id, tier, round(value, 6) AS value, "limit", round(margin, 6) AS margin, passed FROM r')
def constraint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).withColumns({"value": F.round("value", 6), "margin": F.round("margin", 6)})


@query(f"WITH {_LONG} SELECT p_partkey, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS n_failed, array_to_string(list_sort(list(constraint_id) FILTER (NOT passed)), ',') AS failures, min(tier) FILTER (NOT passed) AS first_failing_tier FROM r GROUP BY p_partkey")
def constraint_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.proof(_long(spark, sf_dir), "p_partkey")
    return own.withColumn("failures", F.when(F.size("failures") > 0, F.array_join("failures", ",")))


@query("""WITH l AS (SELECT p_partkey, unnest(['L1', 'L2']) AS layer, 700000 AS pad, 800000 + p_size * 10000 - 250000 AS size_x, 900000 AS size_y, 300000 AS drill FROM part),
    m AS (SELECT p_partkey, layer, 'COVERAGE' AS c, CAST(least(size_x, size_y) - pad AS BIGINT) AS margin FROM l UNION ALL SELECT p_partkey, layer, 'X', CAST(floor((size_x - drill) / 2) AS BIGINT) - 250000 FROM l UNION ALL SELECT p_partkey, layer, 'Y', CAST(floor((size_y - drill) / 2) AS BIGINT) - 250000 FROM l)
    SELECT p_partkey, 'T3_ANTIPAD_' || layer || '_' || c AS constraint_id, margin, margin >= 0 AS passed FROM m""")
def antipad_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda x: F.lit(x).cast("bigint")
    own = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit("L1"), F.lit("L2"))).alias("layer"), n(700_000).alias("pad"), (n(800_000) + F.col("p_size") * 10_000 - 250_000).alias("size_x"), n(900_000).alias("size_y"), n(300_000).alias("drill"))
    return P.antipads(own, "p_partkey", 250_000)


@query(f"""WITH {ARTIFACTS_SQL}, objects AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS digest, CAST(100000 AS BIGINT) AS length FROM customer WHERE c_custkey % 3 > 0)
    SELECT artifact_id, 'unknown_type' AS "check" FROM artifacts WHERE artifact_type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') UNION ALL SELECT artifact_id, 'unknown_role' FROM artifacts WHERE list_contains(roles, 'cache')
    UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'missing_input' FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT artifact_id, CASE WHEN length IS NULL THEN 'missing_object' ELSE 'size_mismatch' END FROM artifacts LEFT JOIN objects USING (digest) WHERE length IS NULL OR length <> byte_size""")
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("digest"), F.lit(100_000).cast("bigint").alias("length"))
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("artifact_id"), F.col("l_partkey").cast("string").alias("input_id"))
    return P.verify(artifacts(spark, sf_dir), inputs, objects, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], ["root_input", "intermediate", "final_output"])


@query("SELECT user_id AS device, count(*) AS samples, round(avg(value), 6) AS mean, max(value) AS largest FROM events GROUP BY user_id")
def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.utilisation(table(spark, sf_dir, "events").withColumnRenamed("user_id", "device"), "device", "value")
    return own.withColumn("mean", F.round("mean", 6))


@query("""SELECT l_orderkey AS case_id, CAST(l_linenumber AS VARCHAR) AS metric, round(max(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity END) - max(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END), 6) AS d FROM lineitem GROUP BY 1, 2 HAVING d IS NOT NULL AND abs(d) > 40""")
def calibration_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("metric"), (F.col("l_suppkey") % 2).alias("side")).agg(F.max("l_quantity").alias("value"))
    a, b = (own.where(f"side = {s}").drop("side") for s in (0, 1))
    got = V.regression(a, b, {str(k): 40.0 for k in range(1, 8)}).where("blocking AND delta IS NOT NULL").select("case_id", "metric")
    return got.join(a.withColumnRenamed("value", "x"), ["case_id", "metric"]).join(b.withColumnRenamed("value", "y"), ["case_id", "metric"]).select("case_id", "metric", F.round(F.col("y") - F.col("x"), 6).alias("d"))


@query("""SELECT user_id, max(event_id) - min(event_id) + 1 - count(*) AS gaps, count(*) - count(DISTINCT event_type) AS duplicate_ids, 0 = count(*) - count(DISTINCT event_id) AS unique_indices FROM events GROUP BY user_id""")
def port_map_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("port_id"), F.col("event_id").alias("port_index"))
    got = V.ports(own, "user_id").join(own.groupBy("user_id").agg((F.max("port_index") - F.min("port_index") + 1 - F.count("*")).alias("gaps")), "user_id")
    return got.select("user_id", "gaps", "duplicate_ids", (F.col("duplicate_indices") == 0).alias("unique_indices"))


@query("""SELECT o_orderkey, 'ram' AS resource, o_totalprice AS need, CAST(400000 AS DOUBLE) AS budget FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'gpu', CAST(o_custkey % 10 AS DOUBLE), 8 FROM orders WHERE o_custkey % 10 > 8""")
def resource_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("ram"), (F.col("o_custkey") % 10).alias("gpu"))
    return V.resource_excess(jobs, {"ram": 400_000, "gpu": 8}, "o_orderkey")


_LAYERS = {"x_min": "o_custkey % 4", "x_max": "o_custkey % 5", "y_min": "o_custkey % 2", "y_max": "0", "z_min": "1", "z_max": "o_orderkey % 3"}
_SET_UPS = {"f_max_hz": "o_totalprice * CAST(100000 AS DOUBLE)", "f_start_hz": "(o_orderkey % 20) * CAST(1000000000 AS DOUBLE)", "n_excited": "o_custkey % 3", "use_gpu": "o_orderkey % 2 = 0", "engine": "CASE o_orderkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'multithreaded' ELSE 'other' END"} | {f: f"CASE {x} WHEN 0 THEN 32 WHEN 1 THEN 16 WHEN 2 THEN 8 END" for f, x in _LAYERS.items()}


@query("WITH s AS (SELECT o_orderkey, " + ", ".join(f"{x} AS {n}" for n, x in _SET_UPS.items()) + """ FROM orders), b AS (SELECT *, least(x_min, x_max, y_min, y_max, z_min, z_max) AS few, CASE WHEN f_max_hz <= 2e10 THEN 8 ELSE 16 END AS least_, CASE WHEN f_max_hz < 5e9 THEN 8 WHEN f_max_hz <= 2e10 THEN 16 ELSE 32 END AS wanted FROM s)
    SELECT o_orderkey, 'absorbing_layers' AS "check", CASE WHEN few < least_ THEN 'FAILED' WHEN x_min IS NULL OR x_max IS NULL OR few < wanted THEN 'WARNING' ELSE 'PASSED' END AS status FROM b UNION ALL SELECT o_orderkey, 'device', CASE WHEN use_gpu AND engine = 'other' THEN 'WARNING' ELSE 'PASSED' END FROM s
    UNION ALL SELECT o_orderkey, 'excitation', CASE WHEN n_excited > 0 THEN 'PASSED' ELSE 'FAILED' END FROM s UNION ALL SELECT o_orderkey, 'sweep', CASE WHEN f_start_hz < f_max_hz THEN 'PASSED' ELSE 'FAILED' END FROM s""")
def set_up_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(x).alias(n) for n, x in _SET_UPS.items()])
    return V.set_up_checks(own, "o_orderkey")


_PORTS = {"rotation_deg": "(p_partkey % 8) * CAST(45 AS DOUBLE)", "width": "100000 + p_size * 1000", "signal_width": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 50000 + (p_partkey % 60) * 1000 END", "gap": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 5 - 1) * 10000 END", "length": "p_size * 1000", "mesh_cell": "20000"}


@query("WITH s AS (SELECT p_partkey, " + ", ".join(f"{x} AS {n}" for n, x in _PORTS.items()) + " FROM part) SELECT p_partkey, p_partkey % 2 = 0 AS cardinal, coalesce(gap <= 0 OR signal_width > width OR signal_width + 2 * gap > width, false) AS shorted, length >= mesh_cell AS long_enough FROM s")
def port_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in _PORTS.items()])
    return V.port_shapes(own, ["p_partkey"])


_BOXES = {"x": "(s_suppkey * 7919) % 300", "y": "(s_suppkey * 104729) % 300", "z": "s_suppkey % 2 * 5", "length": "40 + s_suppkey % 30", "width": "60 + s_suppkey % 20", "height": "10"}


@query("WITH s AS (SELECT s_suppkey AS p, s_nationkey, " + ", ".join(f"{x} AS {n}" for n, x in _BOXES.items()) + """ FROM supplier) SELECT a.s_nationkey, a.p AS a, b.p AS b FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.p < b.p
    AND 2 * abs(a.x - b.x) < a.length + b.length AND 2 * abs(a.y - b.y) < a.width + b.width AND 2 * abs(a.z - b.z) < a.height + b.height""")
def port_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p"), "s_nationkey", *[F.expr(x).alias(n) for n, x in _BOXES.items()])
    return V.port_overlaps(own, "s_nationkey", "p", 70)

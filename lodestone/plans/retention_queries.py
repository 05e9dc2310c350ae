"""Retention queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import integrity as I
from lodestone.operators import retention as R
from lodestone.plans.adapters import ARTIFACTS_SQL, artifacts
from lodestone.plans.registry import query, table

AS_OF = "2000-01-01T00:00:00Z"
POLICY = R.Policy(keep_min_age_days=1200, keep_min_count=30, keep_types=("5-LOW",), keep_roles=("cache",), budget_bytes=20_000_000)
_DECIDED = f"""WITH {ARTIFACTS_SQL}, pins AS (SELECT artifact_id FROM artifacts WHERE run_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < -900) UNION SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0),
    ups AS (SELECT CAST(CAST(artifact_id AS BIGINT) * 3 AS VARCHAR) AS artifact_id FROM pins), downs AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS artifact_id FROM lineitem WHERE l_quantity = 50),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY artifact_type ORDER BY created_utc, artifact_id) AS r,
        (epoch_us(TIMESTAMP '2000-01-01 00:00:00') - epoch_us(strptime(created_utc, '%Y-%m-%dT%H:%M:%SZ'))) / 86400000000 AS age FROM artifacts),
    evaluated AS (SELECT *, CASE WHEN artifact_id IN (SELECT artifact_id FROM pins) THEN 'pinned' WHEN artifact_id IN (SELECT artifact_id FROM ups) THEN 'ancestor_of_pinned' WHEN artifact_id IN (SELECT artifact_id FROM downs) THEN 'has_descendants'
        WHEN artifact_type = '5-LOW' THEN 'protected_type' WHEN list_has_any(roles, ['cache']) THEN 'protected_role' WHEN age < 1200 THEN 'age' WHEN r <= 30 THEN 'min_count' ELSE 'delete' END AS reason FROM ranked),
    soft AS (SELECT artifact_id, coalesce(sum(byte_size) OVER (ORDER BY created_utc, artifact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM evaluated WHERE reason IN ('has_descendants', 'age', 'min_count')),
    over AS (SELECT artifact_id FROM soft WHERE run < (SELECT sum(byte_size) FROM evaluated WHERE reason <> 'delete') - 20000000),
    decided AS (SELECT *, reason = 'delete' OR artifact_id IN (SELECT artifact_id FROM over) AS "delete" FROM evaluated)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = artifacts(spark, sf_dir)
    bad = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").cast("string").alias("run_id"), F.lit(None).cast("string").alias("artifact_id"))
    named = table(spark, sf_dir, "labels").where("quality = 0").select(F.lit(None).cast("string").alias("run_id"), F.col("doc_id").cast("string").alias("artifact_id"))
    pins = I.pinned_ids(own, bad.unionByName(named)).union(named.select("artifact_id"))
    ups = pins.select((F.col("artifact_id").cast("bigint") * 3).cast("string").alias("artifact_id"))
    downs = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").cast("string").alias("artifact_id"))
    return R.with_budget(R.evaluate(own, POLICY, AS_OF, pins, ups, downs), POLICY)


@query(_DECIDED + ' SELECT artifact_id, reason, "delete" FROM decided')
def retention_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("artifact_id", "reason", "delete")


@query(_DECIDED + ' SELECT reason, count(*) AS n, count(*) FILTER ("delete") AS deleted, coalesce(sum(byte_size) FILTER ("delete"), 0) AS bytes_freed FROM decided GROUP BY reason')
def retention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(_decided(spark, sf_dir))

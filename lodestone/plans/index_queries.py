"""Queries over an index of artifacts, runs, snapshots and pins in bucketed tables, over sinks, and over checks that must fail."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import integrity as I
from lodestone.operators import proofs as P
from lodestone.operators import rules as R
from lodestone.plans import file_queries, proof_queries, rule_queries
from lodestone.plans.adapters import ARTIFACTS_SQL, NETWORK_SQL, RUNS_SQL, artifacts, candidates, networks, runs
from lodestone.plans.registry import query, table
from lodestone.plans.session import new_folder
from lodestone.sources import buckets, choice, touchstone
from lodestone.sources import documents as J
from lodestone.sources import snapshots as S

_KEYS = {"artifacts": "artifact_id", "runs": "run_id", "datasets": "dataset_id", "pins": "pin_id"}


def _index(spark: SparkSession, sf_dir: str) -> str:
    """An index of orders as artifacts, customers as runs, parts' brands as datasets, and pins that name runs; its folder."""
    root = new_folder(spark, "index")
    pins = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("pin"), F.col("c_custkey").cast("string")).alias("pin_id"), F.col("c_custkey").cast("string").alias("run_id"))
    datasets = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset_id")).agg(F.count("*").alias("members"))
    for name, frame in (("artifacts", artifacts(spark, sf_dir)), ("runs", runs(spark, sf_dir)), ("datasets", datasets), ("pins", pins)):
        buckets.create(frame, f"{root}/{name}", [_KEYS[name]], 32)
    return root


def _left(spark: SparkSession, root: str) -> DataFrame:
    """(kind, id) of all that the index holds."""
    out = None
    for name, key in _KEYS.items():
        own = buckets.read(spark, f"{root}/{name}").select(F.lit(name).alias("kind"), F.col(key).alias("id"))
        out = own if out is None else out.union(own)
    return out


_LEFT_SQL = f"""WITH {ARTIFACTS_SQL}, {RUNS_SQL}, pins AS (SELECT 'pin' || c_custkey AS pin_id, CAST(c_custkey AS VARCHAR) AS run_id FROM customer WHERE c_custkey % 4 = 0), datasets AS (SELECT p_brand AS dataset_id, sum(p_size) AS size FROM part GROUP BY 1)"""


@query(_LEFT_SQL + """ SELECT 'artifacts' AS kind, artifact_id AS id FROM artifacts WHERE artifact_type <> '1-URGENT' UNION ALL SELECT 'runs', run_id FROM runs WHERE status <> 'failed'
    UNION ALL SELECT 'datasets', dataset_id FROM datasets WHERE dataset_id NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT 'pins', pin_id FROM pins WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'failed')""")
def index_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent artifacts, failed runs, two datasets and the pins of failed runs go from the index, each by its key; entries that name them stay."""
    root = _index(spark, sf_dir)
    failed = runs(spark, sf_dir).where("status = 'failed'").select("run_id")
    buckets.delete(artifacts(spark, sf_dir).where("artifact_type = '1-URGENT'").select("artifact_id"), f"{root}/artifacts")
    buckets.delete(failed, f"{root}/runs")
    buckets.delete(spark.createDataFrame([("Brand#1",), ("Brand#2",), ("none",)], "dataset_id string"), f"{root}/datasets")
    buckets.delete(buckets.read(spark, f"{root}/pins").join(failed, "run_id", "left_semi").select("pin_id"), f"{root}/pins")
    return _left(spark, root)


@query(_LEFT_SQL + """ SELECT artifact_id, run_id, CAST(run_id IN (SELECT run_id FROM pins) AS BOOLEAN) AS pinned FROM artifacts WHERE NOT (run_id IN (SELECT run_id FROM runs WHERE status = 'failed') AND run_id NOT IN (SELECT run_id FROM pins))""")
def index_deletes_with_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of failed runs go, but those that a pin holds by their run."""
    root = _index(spark, sf_dir)
    own = buckets.read(spark, f"{root}/artifacts")
    held = I.pinned_ids(own.select("artifact_id", "run_id"), buckets.read(spark, f"{root}/pins").select("run_id"))
    failed = buckets.read(spark, f"{root}/runs").where("status = 'failed'").select("run_id")
    buckets.delete(own.join(failed, "run_id", "left_semi").join(held, "artifact_id", "left_anti").select("artifact_id"), f"{root}/artifacts")
    left = buckets.read(spark, f"{root}/artifacts").select("artifact_id", "run_id")
    return left.join(held.withColumn("pinned", F.lit(True)), "artifact_id", "left").select("artifact_id", "run_id", F.coalesce("pinned", F.lit(False)).alias("pinned"))


@query(rule_queries._filter_sql(R.ROUNDS))
def batch_filter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's result as the sink leaves it."""
    path = new_folder(spark, "filtered")
    S.write_filtered(R.batch_filter(candidates(spark, sf_dir), rule_queries.TIGHT, True), path)
    return rule_queries._shown(spark.read.parquet(f"{path}/candidates"))


@query(f"SELECT count(*) AS n, count(*) FILTER (feasible) AS n_feasible, CAST(sum(repairs) AS BIGINT) AS repairs, CAST(sum(violations_t0) AS BIGINT) AS violations_t0, CAST(sum(violations_t1) AS BIGINT) AS violations_t1, CAST(sum(violations_t2) AS BIGINT) AS violations_t2 FROM ({rule_queries._filter_sql(R.ROUNDS)})")
def batch_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the sink writes beside it."""
    path = new_folder(spark, "filtered")
    S.write_filtered(R.batch_filter(candidates(spark, sf_dir), rule_queries.TIGHT, True), path)
    return spark.read.json(f"{path}/meta").select("n", "n_feasible", "repairs", *[f"violations_t{i}" for i in range(3)])


@query(f"WITH {NETWORK_SQL} SELECT kind, network_id, count(*) AS n, round(sum(re), 6) AS re FROM networks, (VALUES ('touchstone'), ('csv')) v(kind) WHERE kind = 'touchstone' OR network_id = '3' GROUP BY 1, 2")
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders: one holds network files and a table, the other a table alone; each is read by what is chosen there."""
    own = networks(spark, sf_dir)
    root = new_folder(spark, "chosen")
    one = own.where("network_id = '3'")
    touchstone.write(own, f"{root}/both").count()
    for name in ("both", "table"):
        J.sparameter_wide(one).drop("network_id").write.option("header", True).mode("append").csv(f"{root}/{name}")
    out = None
    for name in ("both", "table"):
        kind, pattern = choice.choose(spark, f"{root}/{name}")
        got = touchstone.read(spark, pattern) if kind == "touchstone" else J.sparameter_csv(spark, pattern, "3")
        part = got.groupBy("network_id").agg(F.count("*").alias("n"), F.round(F.sum("re"), 6).alias("re")).select(F.lit(kind).alias("kind"), "network_id", "n", "re")
        out = part if out is None else out.union(part)
    return out


@query("SELECT step, CASE step WHEN 'damaged' THEN NOT EXISTS (SELECT 1 FROM part WHERE p_size = 7) WHEN 'shortened' THEN NOT EXISTS (SELECT 1 FROM part WHERE p_size = 9) ELSE true END AS intact FROM (VALUES ('written'), ('damaged'), ('shortened')) v(step)")
def snapshot_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot as written, with some members' digests changed, and with some members gone, each verified."""
    path = file_queries._snapshot(spark, sf_dir)
    manifest = spark.read.json(f"{path}/manifest")
    index = S.read_index(spark, path)
    harmed = {"damaged": index.withColumn("digest", F.when(F.col("byte_size") == 7, F.reverse("digest")).otherwise(F.col("digest"))), "shortened": index.where("byte_size <> 9")}
    out = S.verify_snapshot(spark, path).select(F.lit("written").alias("step"), "intact")
    for step, frame in harmed.items():
        other = new_folder(spark, "snapshot")
        frame.write.parquet(f"{other}/index")
        manifest.write.json(f"{other}/manifest")
        out = out.union(S.verify_snapshot(spark, other).select(F.lit(step).alias("step"), "intact"))
    return out


@query(f"WITH {proof_queries._LONG} SELECT constraint_id, bool_and(passed) AS enforced FROM r GROUP BY constraint_id")
def enforced_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which constraints all parts pass when they are enforced: the others end the action on them, with their name."""
    long = proof_queries._long(spark, sf_dir)
    found = []
    for name in ("SIZE_MIN", "PRICE_MAX", "SIZE_CENTRED", "BRANDED"):
        try:
            P.enforce(long.where(F.col("constraint_id") == name), "p_partkey").agg(F.count("*"), F.max("passed")).collect()
            found.append((name, True))
        except PySparkException as failed:
            if f"constraint {name} failed" not in str(failed):
                raise
            found.append((name, False))
    return spark.createDataFrame(found, "constraint_id string, enforced boolean")

"""Records, snapshots and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import catalogue as C
from lodestone.operators import integrity as I
from lodestone.plans.adapters import ARTIFACTS_SQL, RUNS_SQL, artifacts, runs
from lodestone.plans.registry import query, table


@query("""SELECT o_orderpriority AS artifact_type, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) AS bytes, count(DISTINCT o_custkey) AS unique_contents,
    CAST(count(*) AS DOUBLE) / count(DISTINCT o_custkey) AS dedup_ratio FROM orders GROUP BY o_orderpriority""")
def storage_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.storage_stats(artifacts(spark, sf_dir), ["artifact_type"])


@query(f"""WITH {ARTIFACTS_SQL} SELECT count(*) AS n, coalesce(sum(byte_size), 0) AS bytes, count(DISTINCT digest) AS unique_contents,
    CAST(count(*) AS DOUBLE) / count(DISTINCT digest) AS dedup_ratio FROM artifacts""")
def storage_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.storage_stats(artifacts(spark, sf_dir))


@query("""SELECT count(*) AS n, sum(n_chars) AS bytes, count(DISTINCT text) AS unique_contents, CAST(count(*) AS DOUBLE) / count(DISTINCT text) AS dedup_ratio, source AS artifact_type FROM documents GROUP BY source""")
def storage_stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("artifact_type"), F.col("n_chars").alias("byte_size"), F.sha2("text", 256).alias("digest"))
    return C.storage_stats(docs, ["artifact_type"])


@query(f"""WITH {ARTIFACTS_SQL} SELECT artifact_id, artifact_type, created_utc, byte_size FROM artifacts WHERE artifact_type = '1-URGENT'
    AND created_utc >= '1995-01-01' AND created_utc <= '2100-01-01' AND list_has_any(roles, ['final_output', 'cache']) ORDER BY created_utc DESC, artifact_id LIMIT 50 OFFSET 10""")
def artifact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.select_records(artifacts(spark, sf_dir), {"artifact_type": "1-URGENT"}, {"created_utc": ("1995-01-01", "2100-01-01")}, ["final_output", "cache"], "created_utc", limit=50, offset=10)
    return found.select("artifact_id", "artifact_type", "created_utc", "byte_size")


@query(f"WITH {ARTIFACTS_SQL} SELECT artifact_id, byte_size FROM artifacts ORDER BY byte_size, artifact_id LIMIT 25")
def artifact_order_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_records(artifacts(spark, sf_dir), order_by="byte_size", descending=False, limit=25, offset=0).select("artifact_id", "byte_size")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS dataset_id, n_name AS name FROM nation WHERE n_name >= 'C' AND n_name <= 'S' ORDER BY n_name LIMIT 10")
def dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("dataset_id"), F.col("n_name").alias("name"))
    return C.select_records(sets, between={"name": ("C", "S")}, order_by="name", descending=False, tie="dataset_id", limit=10)


@query(f"WITH {RUNS_SQL} SELECT run_id, stage_name, status FROM runs WHERE status = 'failed'")
def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_records(runs(spark, sf_dir), {"status": "failed"})


@query("SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, p_size, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice >= 950 ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 80 OFFSET 20")
def member_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("artifact_id"), "p_size", "p_retailprice")
    return C.slice_members(members, None, {"p_size": (5, 30), "p_retailprice": (950, None)}, 20, 100)


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#1' OR p_size > 45")
def feature_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#1") | (F.col("p_size") > 45)).select("p_partkey", "p_size")


@query(f"WITH {ARTIFACTS_SQL} SELECT artifact_id, artifact_type, run_id FROM artifacts WHERE artifact_id = '7'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).where("artifact_id = '7'").limit(1).select("artifact_id", "artifact_type", "run_id")


@query(f"WITH {ARTIFACTS_SQL} SELECT artifact_id FROM artifacts WHERE digest = sha256('37')")
def lookup_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).where(F.col("digest") == F.sha2(F.lit("37"), 256)).select("artifact_id")


@query("""SELECT source AS name, lang AS version, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY lang DESC) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def latest_dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name"), F.col("lang").alias("version")).agg(F.count("*").alias("n"))
    return C.latest_versions(sets, "name", "version")


@query(f"WITH {RUNS_SQL} SELECT status, count(*) AS n FROM runs GROUP BY status")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {ARTIFACTS_SQL}, {RUNS_SQL} SELECT r.run_id, count(a.artifact_id) AS artifact_count FROM runs r LEFT JOIN artifacts a USING (run_id) GROUP BY r.run_id""")
def run_artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = artifacts(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("c"))
    return runs(spark, sf_dir).join(counted, "run_id", "left").select("run_id", F.coalesce("c", F.lit(0)).alias("artifact_count"))


@query(f"""WITH {ARTIFACTS_SQL} SELECT 'artifact_type' AS grouping_column, artifact_type AS value, count(*) AS n, sum(byte_size) AS bytes FROM artifacts GROUP BY artifact_type
    UNION ALL SELECT 'role', roles[1], count(*), sum(byte_size) FROM artifacts GROUP BY roles[1]""")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grouped_stats(artifacts(spark, sf_dir).withColumn("role", F.col("roles")[0]), "artifact_type", "role")


@query("""SELECT 'p_size' AS feature, CAST(min(p_size) AS DOUBLE) AS min_value, CAST(max(p_size) AS DOUBLE) AS max_value FROM part
    UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part""")
def feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.feature_ranges(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query(f"WITH {ARTIFACTS_SQL} SELECT run_id, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS manifest_hash FROM artifacts GROUP BY run_id")
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.manifest_hash(artifacts(spark, sf_dir), ["run_id"])


_VERSIONS_SQL = """a AS (SELECT o_orderkey AS k, sha256(o_orderstatus || o_custkey) AS d FROM orders WHERE o_orderkey % 5 <> 0),
    b AS (SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END || o_custkey) AS d FROM orders WHERE o_orderkey % 3 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    key, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    a = orders.where(key % 5 != 0).select(key.alias("k"), F.sha2(F.concat("o_orderstatus", who), 256).alias("d"))
    b = orders.where(key % 3 != 0).select(key.alias("k"), F.sha2(F.concat(F.when(key % 7 == 0, "x").otherwise(F.col("o_orderstatus")), who), 256).alias("d"))
    return a, b


@query(f"""WITH {_VERSIONS_SQL} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'modified' ELSE 'unchanged' END AS change
    FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diff(*_versions(spark, sf_dir), "k", "d")


@query(f"WITH {_VERSIONS_SQL} SELECT k, d FROM b WHERE k % 11 = 0 UNION ALL SELECT k, d FROM a WHERE k NOT IN (SELECT k FROM b WHERE k % 11 = 0) AND k % 13 <> 0")
def snapshot_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _versions(spark, sf_dir)
    added = b.where("k % 11 = 0")
    return C.advance(a, a.where("k % 13 = 0").select("k").join(added.select("k"), "k", "left_anti"), added, "k")


@query(f"""WITH {_VERSIONS_SQL}, h AS (SELECT k % 10 AS g, sha256(string_agg(d, chr(10) ORDER BY d)) AS x FROM a GROUP BY 1), i AS (SELECT k % 10 AS g, sha256(string_agg(d, chr(10) ORDER BY d)) AS x FROM b GROUP BY 1)
    SELECT g, h.x = i.x AS intact FROM h JOIN i USING (g)""")
def snapshot_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (f.withColumn("g", F.col("k") % 10) for f in _versions(spark, sf_dir))
    return C.same_members(a, b, ["g"], "d")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS size, p_retailprice AS price, CASE WHEN p_size > 25 THEN 1 END AS fresh FROM part")
def feature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))
    new = F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.col("p_size") + F.lit(100.0), F.lit("fresh"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    merged = table(spark, sf_dir, "part").select("p_partkey", I.merge_features(old, new).alias("m"))
    return merged.select("p_partkey", F.col("m")["size"].cast("int").alias("size"), F.col("m")["price"].alias("price"), F.col("m")["fresh"].cast("int").alias("fresh"))


@query("SELECT o_orderkey AS artifact_id, o_custkey AS input_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.array("o_custkey").alias("inputs"))
    return I.missing_inputs(inputs, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("artifact_id")))


@query("""SELECT o_orderkey AS artifact_id, c_custkey IS NULL AS not_indexed, coalesce(c_nationkey % 5 <> o_orderkey % 5, false) AS type_mismatch FROM orders LEFT JOIN customer ON c_custkey = o_orderkey
    WHERE c_custkey IS NULL OR c_nationkey % 5 <> o_orderkey % 5""")
def registry_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id"), (F.col("o_orderkey") % 5).alias("artifact_type"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact_id"), (F.col("c_nationkey") % 5).cast("bigint").alias("artifact_type"))
    return I.mismatches(manifests, records, "artifact_id", {"type_mismatch": "artifact_type"})


@query("""SELECT l.l_orderkey AS artifact_id, o.o_orderkey IS NULL AS object_missing, coalesce(n <> CAST(floor(o_totalprice) AS BIGINT) % 7, false) AS size_mismatch
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderkey IS NULL OR n <> CAST(floor(o_totalprice) AS BIGINT) % 7""")
def store_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("artifact_id")).agg(F.count("*").alias("byte_size"))
    objects = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("artifact_id"), (F.floor("o_totalprice").cast("bigint") % 7).alias("byte_size"))
    return I.mismatches(manifests, objects, "artifact_id", {"size_mismatch": "byte_size"}, "object_missing")


@query(f"WITH {ARTIFACTS_SQL} SELECT DISTINCT digest FROM artifacts WHERE byte_size > 200000 AND digest NOT IN (SELECT digest FROM artifacts WHERE byte_size <= 200000)")
def unreferenced_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = artifacts(spark, sf_dir)
    return I.unreferenced(own.where("byte_size > 200000"), own.where("byte_size <= 200000"))


@query("""SELECT o_orderkey AS artifact_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    AND o_orderkey NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id"), "o_custkey")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact_id"))
    pinned = orders.join(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("artifact_id")
    sources = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("artifact_id"))
    return I.orphans(orders.select("artifact_id"), members, pinned, sources)


@query("""SELECT n_name AS name, coalesce(CASE WHEN n_regionkey = 1 THEN 99 END, n_nationkey) AS value FROM nation""")
def limits_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    base = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value"))
    return C.overlay(base, nation.where("n_regionkey = 1").select(F.col("n_name").alias("name"), F.lit(99).alias("value")), "name", "value")


@query("""SELECT d.doc_id, sha256(coalesce(d.lang, '') || ':' || coalesce(d.source, '')) AS cache_key FROM documents d WHERE sha256(coalesce(d.lang, '') || ':' || coalesce(d.source, '')) NOT IN
    (SELECT sha256('en' || ':' || source) FROM documents WHERE source IS NOT NULL)""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select("doc_id", I.cache_key(F.col("lang"), F.col("source")).alias("cache_key"))
    have = docs.where("source is not null").select(I.cache_key(F.lit("en"), F.col("source")).alias("cache_key")).distinct()
    return wanted.join(have, "cache_key", "left_anti").select("doc_id", "cache_key")


@query("""SELECT c_mktsegment AS level, count(*) AS entries, sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) AS bytes, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS hit_rate FROM customer GROUP BY c_mktsegment""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer")
    return own.groupBy(F.col("c_mktsegment").alias("level")).agg(F.count("*").alias("entries"), F.sum(F.floor(F.abs("c_acctbal")).cast("bigint")).alias("bytes"), (F.count_if(F.col("c_acctbal") > 0).cast("double") / F.count("*")).alias("hit_rate"))


@query("""SELECT p_brand AS name, list_sort(list_distinct(list(p_size))) AS provided, len(list_filter(list_distinct(list(p_size)), lambda x: x > 25)) AS n_unused FROM part GROUP BY p_brand""")
def spec_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set("p_size")).alias("provided"))
    used = F.filter("provided", lambda x: x <= 25)
    return own.select("name", "provided", F.size(C.coverage(F.col("provided"), F.col("provided"), used)["unused"]).cast("bigint").alias("n_unused"))


@query("""SELECT 'job_' || printf('%06d', row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) AS job_id, o_orderkey FROM orders""")
def batch_job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("priority"))
    return I.numbered(jobs, [F.col("priority").desc(), F.col("o_orderkey")]).select(F.format_string("job_%06d", "n").alias("job_id"), "o_orderkey")


@query("""SELECT o_orderpriority AS batch, o_orderstatus AS status, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share FROM orders GROUP BY 1, 2""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.status_shares(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("status")))


@query("""SELECT c_custkey, c_acctbal AS value, CAST(0 AS BIGINT) AS version FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, arg_max(o_totalprice, (o_orderkey, o_totalprice)), max(o_orderkey) FROM orders GROUP BY o_custkey""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value"), F.lit(0).cast("bigint").alias("version"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("version"))
    return C.upsert(base, new, ["c_custkey"], "version")


@query(f"""WITH {RUNS_SQL}, c AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000) SELECT run_id, stage_name, CASE WHEN run_id IN (SELECT run_id FROM c) THEN 'archived' ELSE status END AS status FROM runs""")
def run_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(F.max("o_totalprice").alias("m")).where("m > 400000")
    return C.set_status(runs(spark, sf_dir), large.select("run_id", F.lit("archived").alias("status")), "run_id")

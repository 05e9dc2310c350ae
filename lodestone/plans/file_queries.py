"""Queries over files: each writes a table's rows as files of some format into the shared folder, reads them with the source under test, and answers from that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import catalogue as C
from lodestone.operators import lineage as G
from lodestone.operators import meshes as M
from lodestone.operators import proofs as P
from lodestone.operators import verification as V
from lodestone.plans.adapters import ARTIFACTS_SQL, GRAPH_SQL, NETWORK_SQL, WHOLE_NETWORK_SQL, artifacts, graph, networks, whole_networks
from lodestone.plans.registry import query, table
from lodestone.plans.session import new_folder
from lodestone.sources import contents
from lodestone.sources import documents as J
from lodestone.sources import snapshots as S
from lodestone.sources import touchstone


def _documents(frame: DataFrame, line: str, folder: str) -> str:
    """One file for each row."""
    frame.select(line).repartition(1).write.option("maxRecordsPerFile", 1).text(folder)  # a few rows: nations, regions
    return folder


_MANIFESTS_SQL = """manifests AS (SELECT 'n' || n_nationkey AS artifact_id, 'type' || n_regionkey AS artifact_type, CAST(length(n_name) AS BIGINT) AS byte_size, sha256(n_name) AS digest,
    'run' || n_regionkey AS run_id, 'r' || n_regionkey AS input FROM nation)"""


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as manifest files, besides a broken one."""
    name, region = F.col("n_name"), F.col("n_regionkey").cast("string")
    inputs = F.array(F.struct(F.concat(F.lit("r"), region).alias("artifact_id"), F.lit("derived_from").alias("relation")))
    doc = F.struct(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("artifact_id"), F.concat(F.lit("type"), region).alias("artifact_type"), F.length(name).alias("byte_size"), F.lit("2024-01-01").alias("created_utc"),
        F.struct(F.lit("sha256").alias("algorithm"), F.sha2(name, 256).alias("digest")).alias("content_hash"), F.struct(F.concat(F.lit("run"), region).alias("run_id"), inputs.alias("inputs")).alias("lineage"),
    )
    own = table(spark, sf_dir, "nation").select(F.to_json(doc).alias("line")).union(spark.createDataFrame([("{broken",)], "line string"))
    return J.manifests(spark, _documents(own, "line", new_folder(spark, "manifests")))


@query(f"WITH {_MANIFESTS_SQL} SELECT artifact_id, artifact_type, byte_size, digest FROM manifests")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir).select("artifact_id", "artifact_type", "byte_size", F.col("content_hash.digest").alias("digest"))


@query(f"WITH {_MANIFESTS_SQL} SELECT artifact_id, digest, run_id FROM manifests")
def registry_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.registry(_manifests(spark, sf_dir)).select("artifact_id", "digest", "run_id")


@query(f"WITH {_MANIFESTS_SQL} SELECT input AS source_id, artifact_id AS target_id, 'derived_from' AS relation FROM manifests")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lineage(_manifests(spark, sf_dir))[1]


@query("SELECT sha256(r_name) AS digest, CAST(length(r_name) AS BIGINT) AS length, true AS intact FROM region WHERE r_regionkey = 2")
def object_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One content, by its digest, of a store of all regions' names."""
    names = table(spark, sf_dir, "region")
    root = new_folder(spark, "objects")
    contents.put(names, root, "r_name")
    digest = names.where("r_regionkey = 2").select(F.sha2("r_name", 256)).first()[0]
    return contents.read(spark, root, digest).select("digest", F.octet_length("content").cast("bigint").alias("length"), "intact")


_MEMBERS_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, p_brand AS artifact_type, sha256(p_name) AS digest, CAST(p_size AS BIGINT) AS byte_size,
    CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS feature_size, p_retailprice AS feature_price FROM part"""


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    price = F.create_map(F.lit("price"), F.col("p_retailprice"))
    features = F.when(F.col("p_size") > 10, F.map_concat(price, F.create_map(F.lit("size"), F.col("p_size").cast("double")))).otherwise(price)
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("artifact_id"), F.col("p_brand").alias("artifact_type"), F.lit("member").alias("role"), F.sha2("p_name", 256).alias("digest"), F.col("p_size").cast("bigint").alias("byte_size"), F.lit("p").alias("storage_path"), features.alias("features"))
    path = new_folder(spark, "snapshot")
    S.write_snapshot(members, path, "parts", "v1")
    return path


@query(_MEMBERS_SQL)
def snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_index(spark, _snapshot(spark, sf_dir)).select("artifact_id", "artifact_type", "digest", "byte_size", "feature_size", "feature_price")


@query("SELECT 'parts' AS dataset_id, true AS intact")
def snapshot_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.verify_snapshot(spark, _snapshot(spark, sf_dir))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 20 AND p_brand IN ('Brand#1', 'Brand#2')")
def index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_slice(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_size"], [("p_size", ">", 20), ("p_brand", "in", ["Brand#1", "Brand#2"])])


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def row_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.row_groups(spark, f"{sf_dir}/lineitem.parquet").agg(F.sum("n_rows").alias("n_rows"), F.max("columns").cast("bigint").alias("columns"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def row_group_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All row groups of a table, by their numbers."""
    path = f"{sf_dir}/orders.parquet"
    return S.read_row_groups(S.row_groups(spark, path), ["o_orderkey", "o_custkey"], path)


@query(f"WITH {NETWORK_SQL} SELECT network_id, count(*) AS n, count(DISTINCT f_idx) AS points, round(sum(re), 6) AS re, round(sum(im), 6) AS im, 75.0::DOUBLE AS z0 FROM networks GROUP BY network_id")
def touchstone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks written as one file each, with their ports' impedances in comments, and read back."""
    own, folder = networks(spark, sf_dir), new_folder(spark, "touchstone")
    ports = own.select("network_id", F.col("i").alias("port"), F.lit(75.0).alias("z0")).distinct()
    touchstone.write(own, folder, 75.0, ports).count()
    back = touchstone.read(spark, f"{folder}/*.s2p")
    return back.groupBy("network_id").agg(F.count("*").alias("n"), F.count_distinct("f_idx").alias("points"), F.round(F.sum("re"), 6).alias("re"), F.round(F.sum("im"), 6).alias("im"), F.max("z0").alias("z0"))


@query(f"WITH {WHOLE_NETWORK_SQL} SELECT f_idx, i, j, re, im FROM networks WHERE network_id = '3'")
def sparameter_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    J.sparameter_wide(whole_networks(spark, sf_dir).where("network_id = '3'")).drop("network_id").write.option("header", True).csv(folder)
    return J.sparameter_csv(spark, folder, "3").select(F.col("f_idx").cast("int").alias("f_idx"), "i", "j", "re", "im")


@query("""SELECT 'P' || n_regionkey AS port, CAST(k AS INT) AS k, k * 1e-12 AS t_s, n_nationkey + k * 0.5::DOUBLE AS v, n_nationkey * 2.0::DOUBLE AS i
    FROM (SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1), (SELECT unnest(range(0, 4)) AS k)""")
def port_signal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.struct(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("m") + k * F.lit(0.5)).alias("voltage_v"), F.array_repeat(F.col("m") * 2.0, 4).alias("current_a"))
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("m"))
    doc = F.to_json(F.struct(F.array(*[F.lit(float(k)) for k in range(4)]).alias("time_ps"), F.create_map(F.concat(F.lit("P"), F.col("n_regionkey").cast("string")), series).alias("ports")))
    return J.port_signals(spark, _documents(own.select(doc.alias("line")), "line", new_folder(spark, "signals"))).select("port", F.col("k").cast("int").alias("k"), "t_s", "v", "i")


@query("SELECT CAST(k AS INT) AS k, k * 10.0::DOUBLE AS time_ps, -(n_nationkey + k) * 1.0::DOUBLE AS energy_db FROM nation, (SELECT unnest(range(0, 3)) AS k)")
def energy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = F.array(*[F.lit(k) for k in range(3)])
    doc = F.to_json(F.struct(F.transform(ks, lambda k: k * F.lit(10.0)).alias("time_ps"), F.transform(ks, lambda k: -(F.col("n_nationkey") + k) * F.lit(1.0)).alias("energy_db")))
    return J.energy_series(spark, _documents(table(spark, sf_dir, "nation").select(doc.alias("line")), "line", new_folder(spark, "energy"))).select(F.col("k").cast("int").alias("k"), "time_ps", "energy_db")


@query("SELECT CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 1000 AS BIGINT) AS total, count(*) AS n FROM embeddings GROUP BY 1")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as lines of JSON, read back; sums in thousandths, rounded, and how many vectors have them."""
    folder = new_folder(spark, "vectors")
    table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("u")).select(F.concat(F.lit("["), F.array_join(F.transform("u", lambda x: x.cast("string")), ","), F.lit("]")).alias("line")).write.text(folder)
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return J.candidate_vectors(spark, folder).select(F.bround(total * 1000, 0).cast("bigint").alias("total")).groupBy("total").agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey, sum(CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN n_nationkey % 7 <> 0 THEN 1 ELSE 0 END)::BIGINT AS warnings,
    CASE WHEN sum(CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END) > 0 THEN 'FAILED' ELSE 'WARNING' END AS status FROM nation GROUP BY 1""")
def drc_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule reports, one file for a region, and the verdict on each."""
    severity = F.when(F.col("n_nationkey") % 7 == 0, "error").otherwise("warning")
    found = F.struct(F.lit("clearance").alias("type"), severity.alias("severity"), F.col("n_regionkey").cast("string").alias("description"))
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(found).alias("violations"))  # five regions
    report = J.drc_report(spark, _documents(own.select(F.to_json(F.struct("violations")).alias("line")), "line", new_folder(spark, "drc")))
    return V.drc_tier(report.withColumn("n_regionkey", F.col("description").cast("int")), "n_regionkey")


@query("SELECT n_name AS name, 'suite' || n_regionkey AS classname, CASE n_nationkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'passed' END AS status FROM nation")
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("n_nationkey") % 3 == 0, "<failure>no</failure>").when(F.col("n_nationkey") % 3 == 1, "<skipped>later</skipped>").otherwise("<system-out>x</system-out>")
    case = F.concat(F.lit("<testcase name='"), F.col("n_name"), F.lit("' classname='suite"), F.col("n_regionkey").cast("string"), F.lit("'>"), body, F.lit("</testcase>"))
    return J.junit(spark, _documents(table(spark, sf_dir, "nation").select(case.alias("line")), "line", new_folder(spark, "junit")))


@query(f"""WITH {GRAPH_SQL} SELECT '{{"artifact_id":"' || artifact_id || '","artifact_type":"' || artifact_type || '"}}' AS line FROM nodes
    UNION ALL SELECT '{{"source_id":"' || source_id || '","target_id":"' || target_id || '","relation":"' || relation || '"}}' FROM edges""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.export_graph(*graph(spark, sf_dir))


@query("SELECT p_partkey, 'T0_SIZE' AS constraint_id, true AS passed FROM part")
def enforced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that all pass, through the check that fails at the first that doesn't."""
    return P.enforce(table(spark, sf_dir, "part").select("p_partkey", F.lit("T0_SIZE").alias("constraint_id"), (F.col("p_size") > 0).alias("passed")), "p_partkey")


@query(f"WITH {ARTIFACTS_SQL} SELECT artifact_id, artifact_type FROM artifacts WHERE run_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)")
def registry_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("run_id"))
    return C.delete(artifacts(spark, sf_dir), gone, "run_id").select("artifact_id", "artifact_type")


_UP = "SELECT w.origin, e.source_id FROM walk w JOIN edges e ON e.target_id = w.artifact_id"
_AUDITED_SQL = f"""{GRAPH_SQL}, walk AS (SELECT artifact_id AS origin, artifact_id FROM nodes WHERE artifact_type = '1-URGENT' UNION {_UP}), known AS (SELECT origin, artifact_id, artifact_type FROM walk JOIN nodes USING (artifact_id))"""


def _urgent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = graph(spark, sf_dir)
    return nodes, edges, nodes.where("artifact_type = '1-URGENT'").select("artifact_id")


@query(f"WITH RECURSIVE {_AUDITED_SQL} SELECT origin, artifact_type, count(*) AS n FROM known WHERE origin <> artifact_id GROUP BY 1, 2")
def lineage_audit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestor types of all urgent orders."""
    return G.audit_types(*_urgent(spark, sf_dir))


@query(f"WITH RECURSIVE {_AUDITED_SQL} SELECT origin, artifact_id FROM known WHERE artifact_id NOT IN (SELECT target_id FROM edges)")
def lineage_audit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit_roots(*_urgent(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS listed,
    CASE WHEN b < 1024 THEN b || '.0 B' WHEN b < 1048576 THEN (b // 1024) || '.0 KB' WHEN b < 1073741824 THEN (b // 1048576) || '.0 MB' ELSE (b // 1073741824) || '.0 GB' END AS reported
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 128 ELSE 65536 END // CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 1 END AS b FROM orders)""")
def byte_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    size = F.floor("o_totalprice").cast("bigint") * F.when(key % 3 == 0, 1).when(key % 3 == 1, 128).otherwise(65536)
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 5 == 0, F.floor(size / 1000)).otherwise(size).cast("bigint").alias("b"))
    return own.select("o_orderkey", X.format_bytes_listing(F.col("b")).alias("listed"), X.format_bytes_report(F.col("b")).alias("reported"))


_TRIMMED = r"list_filter(list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[ \t\f\x0B]+', ''), '[ \t\f\x0B]+$', '')), lambda x: x <> '')"


@query(rf"""WITH d AS (SELECT doc_id, '  G04 made today' || chr(13) || chr(10) || coalesce(text, '') || chr(10) || '; tool 1' || chr(10) || '%TF.Creation Date,2024*%' || chr(13) || '(net 1 (uuid ' || doc_id || '-a) (tstamp 5))  ' AS t FROM documents),
    l AS (SELECT doc_id, t, {_TRIMMED} AS ls FROM d)
    SELECT doc_id, sha256(array_to_string(list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '^G04|(?i:creation\s*date|creation\s*time)')), lambda x: x || chr(10)), '')) AS layers,
    sha256(array_to_string(list_transform(list_filter(ls, lambda x: NOT x LIKE ';%'), lambda x: x || chr(10)), '')) AS drills,
    sha256(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\((tstamp|uuid)\s+[^)]+\)', '(\1)', 'g')) AS boards FROM l""")
def canonical_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed up as layer plots, drill files and boards."""
    text = F.concat(F.lit("  G04 made today\r\n"), F.coalesce("text", F.lit("")), F.lit("\n; tool 1\n%TF.Creation Date,2024*%\r(net 1 (uuid "), F.col("doc_id").cast("string"), F.lit("-a) (tstamp 5))  "))
    own = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return own.select("doc_id", *[F.sha2(f(F.col("t")), 256).alias(n) for n, f in (("layers", X.canonical_layers), ("drills", X.canonical_drills), ("boards", X.canonical_boards))])


@query("""WITH s AS (SELECT p_partkey, 1.0::DOUBLE + p_size / 10.0::DOUBLE AS er, p_size * 4000 AS w, p_size * 3000 AS gap, CASE WHEN p_size % 4 > 0 THEN p_size * 9000 ELSE 0 END AS drill, CASE WHEN p_size % 3 > 0 THEN p_size * 17000 END AS pad,
        list_filter([p_size * 20000, 300000, 0], lambda x: x > 0) AS layers FROM part),
    m AS (SELECT *, CAST(floor(299792458.0 / (20e9::DOUBLE * sqrt(er)) * 1e9) AS BIGINT) AS wave FROM s), b AS (SELECT *, greatest(5000, least(CAST(floor(wave * 0.05::DOUBLE) AS BIGINT), 500000)) AS base FROM m)
    SELECT p_partkey, wave AS min_wavelength, base AS base_cell, greatest(5000, least(25000, w // 4, gap // 3, base)) AS trace_cell,
    greatest(5000, least(greatest(5000, least(25000, base)), CASE WHEN drill > 0 THEN drill // 4 END, CASE WHEN pad > 0 THEN pad // 6 END)) AS via_cell,
    greatest(5000, least(greatest(5000, least(50000, base)), list_min(list_transform(layers, lambda x: x // 3)))) AS substrate_cell FROM b""")
def mesh_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    specs = table(spark, sf_dir, "part").select(
        "p_partkey", (F.lit(1.0) + size / 10.0).alias("er"), (size * 4000).alias("w"), (size * 3000).alias("gap"), F.when(size % 4 > 0, size * 9000).otherwise(0).alias("drill"), F.when(size % 3 > 0, size * 17000).alias("pad"), F.array(size * 20000, F.lit(300_000), F.lit(0)).alias("layers")
    )
    return M.densities(specs, 20e9, "drill", "pad", "layers").select("p_partkey", "min_wavelength", "base_cell", "trace_cell", "via_cell", "substrate_cell")

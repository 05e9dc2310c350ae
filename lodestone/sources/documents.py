"""Readers and writers of the platform's JSON, CSV, XML and array files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.integrity import placed

MANIFEST = """artifact_id string, artifact_type string, byte_size bigint, created_utc string, content_hash struct<algorithm:string,digest:string>,
    lineage struct<run_id:string,inputs:array<struct<artifact_id:string,relation:string>>>, roles array<string>, tags map<string,string>, _corrupt string"""


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Artifact manifests, one JSON document for each file; unreadable ones, and those without an id, are left out."""
    own = spark.read.schema(MANIFEST).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return own.where("_corrupt IS NULL AND artifact_id IS NOT NULL").drop("_corrupt")


def registry(manifests_: DataFrame) -> DataFrame:
    """Artifact records of manifests; the last of an id by creation time wins."""
    own = manifests_.select("artifact_id", "artifact_type", F.col("content_hash.algorithm").alias("hash_alg"), F.col("content_hash.digest").alias("digest"), "byte_size", "created_utc", F.col("lineage.run_id").alias("run_id"), "roles", "tags")
    newest = own.groupBy("artifact_id").agg(F.max_by(F.struct(*own.columns), F.struct("created_utc", "digest")).alias("r"))
    return newest.select("r.*")


def lineage(manifests_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of manifests."""
    nodes = manifests_.select("artifact_id", "artifact_type").distinct()
    edges = manifests_.select(F.explode("lineage.inputs").alias("input"), F.col("artifact_id").alias("target_id")).select(F.col("input.artifact_id").alias("source_id"), "target_id", F.col("input.relation").alias("relation")).distinct()
    return nodes, edges


def put(new: DataFrame, have: DataFrame, digest: str = "digest") -> DataFrame:
    """Rows whose content isn't stored yet, one for each content: what an append has to write."""
    return new.dropDuplicates([digest]).join(have.select(digest), digest, "left_anti")


def sparameter_csv(spark: SparkSession, path: str, network_id: str) -> DataFrame:
    """freq_hz, s11_re, s11_im, .. as long rows."""
    own = placed(spark.read.option("header", True).option("inferSchema", True).csv(path), [], ["freq_hz"], "f_idx", dense=True)
    cells = [c[:-3] for c in own.columns if c.endswith("_re")]
    long = F.array(*[F.struct(F.lit(int(c[1])).alias("i"), F.lit(int(c[2])).alias("j"), F.col(f"{c}_re").cast("double").alias("re"), F.col(f"{c}_im").cast("double").alias("im")) for c in cells])
    return own.select(F.lit(network_id).alias("network_id"), F.col("freq_hz").cast("double").alias("freq_hz"), F.inline(long), "f_idx").select("network_id", "freq_hz", "i", "j", "re", "im", "f_idx")


def sparameter_wide(long: DataFrame) -> DataFrame:
    """Long rows as freq_hz, s11_re, s11_im, ..: what a CSV file holds."""
    cell = F.concat(F.lit("s"), F.col("i"), F.col("j"))
    wide = long.withColumn("cell", cell).groupBy("network_id", "freq_hz").pivot("cell").agg(F.first("re").alias("re"), F.first("im").alias("im"))
    return wide.orderBy("network_id", "freq_hz")


def port_signals(spark: SparkSession, path: str) -> DataFrame:
    """Port series of JSON documents {time_ps, ports: {name: {voltage_v, current_a}}} as (file, port, k, t_s, v, i)."""
    schema = "time_ps array<double>, ports map<string, struct<voltage_v:array<double>, current_a:array<double>>>"
    own = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), "time_ps", F.explode("ports").alias("port", "p"))
    zipped = own.select("file", "port", F.posexplode(F.arrays_zip("time_ps", "p.voltage_v", "p.current_a")).alias("k", "z"))
    return zipped.select("file", "port", "k", (F.col("z.time_ps") * 1e-12).alias("t_s"), F.col("z.voltage_v").alias("v"), F.col("z.current_a").alias("i"))


def energy_series(spark: SparkSession, path: str) -> DataFrame:
    """{time_ps, energy_db} documents as (sim_id, k, time_ps, energy_db)."""
    own = spark.read.schema("time_ps array<double>, energy_db array<double>").option("multiLine", True).json(path)
    return own.select(F.input_file_name().alias("sim_id"), F.posexplode(F.arrays_zip("time_ps", "energy_db")).alias("k", "z")).select("sim_id", "k", "z.time_ps", "z.energy_db")


def candidate_vectors(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of number arrays as (cand_id, u); ids follow the places of lines within files, without a global order."""
    own = spark.read.text(path).where("length(trim(value)) > 0").withColumn("cand_id", F.monotonically_increasing_id())
    return own.select("cand_id", F.from_json("value", "array<double>").alias("u"))


def candidate_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional .npy arrays as (file, row, u)."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                if data.ndim != 2:
                    raise ValueError(f"{name} is not two-dimensional")
                yield pd.DataFrame({"file": name, "row": range(len(data)), "u": list(data.astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row bigint, u array<double>")


def junit(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of JUnit XML files: name, classname, status."""
    own = spark.read.format("xml").option("rowTag", "testcase").schema("_name string, _classname string, failure string, error string, skipped string").load(path)
    status = F.when(F.coalesce("failure", "error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return own.select(F.col("_name").alias("name"), F.col("_classname").alias("classname"), status.alias("status"))


def gate_status(cases: DataFrame, gate: str = "gate") -> DataFrame:
    """FAILED if a case failed, SKIPPED if all were, else PASSED, by gate."""
    return cases.groupBy(gate).agg(F.when(F.bool_or(F.col("status") == "failed"), "FAILED").when(F.every(F.col("status") == "skipped"), "SKIPPED").otherwise("PASSED").alias("status"), F.count("*").alias("n"))


def drc_report(spark: SparkSession, path: str) -> DataFrame:
    """Violations of design-rule reports {violations: [{type, severity, description}]}."""
    own = spark.read.schema("violations array<struct<type:string,severity:string,description:string>>").option("multiLine", True).json(path)
    return own.select(F.input_file_name().alias("file"), F.inline("violations"))


def leaf_paths(spark: SparkSession, text: DataFrame, column: str, key: str) -> DataFrame:
    """(key, path) of all leaves of JSON documents that aren't null: names joined by dots, list items as [i]."""

    def run(batches):
        import json

        import pandas as pd

        def walk(value, path: str):
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from walk(v, f"{path}.{k}" if path else k)
            elif isinstance(value, list):
                for n, v in enumerate(value):
                    yield from walk(v, f"{path}[{n}]")
            elif value is not None:
                yield path

        for batch in batches:
            rows = [(k, p) for k, t in zip(batch[key], batch[column], strict=True) if t for p in walk(json.loads(t), "")]
            yield pd.DataFrame(rows, columns=[key, "path"])

    from pyspark.sql import types as T

    return text.select(key, column).mapInPandas(run, T.StructType([text.schema[key], T.StructField("path", T.StringType())]))

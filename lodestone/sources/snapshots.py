"""Snapshots, objects and exports: what the platform writes and reads beside tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.catalogue import fingerprint, manifest_hash
from lodestone.sources.stores import opened_store

MEMBER = ["artifact_id", "artifact_type", "role", "digest", "byte_size", "storage_path"]


def wide_features(members: DataFrame, features: str = "features") -> DataFrame:
    """Members with one column feature_<name> for each name that any member has; null where a member lacks it. The names are collected: they are columns, a bounded set."""
    names = [r[0] for r in members.select(F.explode(F.map_keys(features)).alias("n")).distinct().orderBy("n").collect()]
    return members.select(*[c for c in members.columns if c != features], *[F.col(features)[n].alias(f"feature_{n}") for n in names])


def write_snapshot(members: DataFrame, path: str, dataset_id: str, version: str, features: str = "features") -> None:
    """A Parquet index of the members and a one-row JSON manifest with count, bytes and the manifest hash."""
    wide_features(members, features).write.mode("errorifexists").parquet(f"{path}/index")
    own = members.sparkSession.read.parquet(f"{path}/index").withColumn("dataset_id", F.lit(dataset_id))
    totals = own.groupBy("dataset_id").agg(F.count("*").alias("count"), F.sum("byte_size").alias("total_bytes"))
    marks = fingerprint(own, ["dataset_id"]).select("dataset_id", F.col("sum_a").cast("string").alias("sum_a"), F.col("sum_b").cast("string").alias("sum_b"))
    totals.join(marks, "dataset_id").join(manifest_hash(own, ["dataset_id"]), "dataset_id").withColumn("version", F.lit(version)).coalesce(1).write.json(f"{path}/manifest")  # one row


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id, intact: whether the index still has the manifest's count, bytes and sums of the digests' hashes; nothing is gathered."""
    manifest = spark.read.json(f"{path}/manifest")
    own = read_index(spark, path).withColumn("dataset_id", F.lit(manifest.first()["dataset_id"]))
    now = fingerprint(own, ["dataset_id"]).toDF("dataset_id", "n", "a", "b").join(own.groupBy("dataset_id").agg(F.sum("byte_size").alias("bytes")), "dataset_id")
    same = (F.col("count") == F.col("n")) & (F.col("total_bytes") == F.col("bytes")) & (F.col("sum_a") == F.col("a").cast("string")) & (F.col("sum_b") == F.col("b").cast("string"))
    return manifest.join(now, "dataset_id").select("dataset_id", same.alias("intact"))


def read_slice(spark: SparkSession, path: str, columns: list[str], filters: list[tuple[str, str, object]]) -> DataFrame:
    """Columns of an index under conditions (column, operator, value) that all hold; both reach the Parquet scan."""
    own = spark.read.parquet(path)
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a.isin(*b), "not in": lambda a, b: ~a.isin(*b)}
    for column, op, value in filters:
        own = own.where(ops[op](F.col(column), value))
    return own.select(*columns)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, n_rows, n_bytes, columns) of Parquet files: tasks get paths and read the footers alone."""

    def run(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch["path"]:
                with _opened(name) as file:
                    meta = pq.ParquetFile(file).metadata
                yield pd.DataFrame([(name, g, meta.row_group(g).num_rows, meta.row_group(g).total_byte_size, meta.num_columns) for g in range(meta.num_row_groups)], columns=["file", "row_group", "n_rows", "n_bytes", "columns"])

    return _files(spark, path).mapInPandas(run, "file string, row_group int, n_rows bigint, n_bytes bigint, columns int")


def read_row_groups(chosen: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Columns of the row groups that chosen (file, row_group) names, of the files under the path; each is one piece of work."""
    schema = chosen.sparkSession.read.parquet(path).select(*columns).schema

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for name, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(name) as file:
                    yield from pq.ParquetFile(file).read_row_group(group, columns=columns).select(columns).to_batches()

    return chosen.select("file", "row_group").distinct().mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")


def _opened(name: str):
    store, path = opened_store(name)
    return store.open_input_file(path)


def object_path(root: str, digest: str) -> str:
    return f"{root}/objects/{digest[:2]}/{digest}"


def read_object(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """(path, length, content, intact) of one stored content."""
    own = spark.read.format("binaryFile").load(object_path(root, digest))
    return own.select("path", "length", "content", (F.sha2("content", 256) == digest).alias("intact"))


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line of JSON for each node and edge, nodes by id first, edges by (source, target, relation): sorted rows, not one document in one task."""
    a = nodes.select(F.lit(0).alias("part"), F.col("artifact_id").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), F.to_json(F.struct("artifact_id", "artifact_type")).alias("line"))
    b = edges.select(F.lit(1).alias("part"), F.col("source_id").alias("k1"), F.col("target_id").alias("k2"), F.col("relation").alias("k3"), F.to_json(F.struct("source_id", "target_id", "relation")).alias("line"))
    return a.union(b).orderBy("part", "k1", "k2", "k3").select("line")


def write_filtered(filtered: DataFrame, path: str) -> None:
    """Result of a batch filter: masks and repaired vectors as Parquet, and one row of JSON with the counts."""
    filtered.write.parquet(f"{path}/candidates")
    own = filtered.sparkSession.read.parquet(f"{path}/candidates")
    own.agg(F.count("*").alias("n"), F.count_if("feasible").alias("n_feasible"), F.sum("repairs").alias("repairs"), *[F.sum(f"violations_t{i}").alias(f"violations_t{i}") for i in range(3)]).coalesce(1).write.json(f"{path}/meta")


def load_spec(spark: SparkSession, text: str, known: Mapping[str, object]) -> DataFrame:
    """A specification document of JSON, or YAML where that is at hand, as one row.

    known gives each key's type, or the known keys of a document within it, or a list of one such entry for a list.
    Unknown and missing keys raise ValueError, at whatever depth, with their path.
    """
    return spark.createDataFrame([_strict(_document(text), known, "")])


def _document(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("not a JSON document, and no YAML reader is installed") from None
        return yaml.safe_load(text)


def _strict(value: object, known: object, path: str) -> object:
    if isinstance(known, Mapping):
        if not isinstance(value, Mapping):
            raise ValueError(f"{path or 'the document'} has no keys")
        wrong = sorted(set(value) ^ set(known), key=str)
        if wrong:
            raise ValueError(f"unknown or missing keys: {', '.join(f'{path}.{k}' if path else str(k) for k in wrong)}")
        return Row(**{k: _strict(v, known[k], f"{path}.{k}" if path else k) for k, v in value.items()})
    if isinstance(known, list):
        return [_strict(v, known[0], f"{path}[{i}]") for i, v in enumerate(value)]
    return None if value is None else known(value)

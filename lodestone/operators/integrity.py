"""Checks between manifests, records, objects and snapshots, and small helpers of batches and caches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.session import cut


def missing_inputs(manifests: DataFrame, known: DataFrame) -> DataFrame:
    """(artifact_id, input_id) of inputs that have no record."""
    inputs = manifests.select("artifact_id", F.explode("inputs").alias("input_id"))
    return inputs.join(known.select(F.col("artifact_id").alias("input_id")), "input_id", "left_anti").select("artifact_id", "input_id")


def mismatches(manifests: DataFrame, records: DataFrame, key: str, checks: Mapping[str, str], absent: str = "not_indexed") -> DataFrame:
    """Keys without a record, or whose record differs in a checked column; one flag each."""
    other = records.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in checks.values()])
    flags = {name: F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(False)) for name, c in checks.items()}
    joined = manifests.join(other, key, "left").withColumns({absent: F.col("_there").isNull(), **flags})
    wrong = F.col(absent)
    for name in checks:
        wrong = wrong | F.col(name)
    return joined.where(wrong).select(key, absent, *checks)


def unreferenced(deleted: DataFrame, left: DataFrame, digest: str = "digest") -> DataFrame:
    """Contents of deleted artifacts that no other artifact holds."""
    return deleted.select(digest).distinct().join(left.select(digest), digest, "left_anti")


def orphans(artifacts: DataFrame, members: DataFrame, pinned: DataFrame, sources: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Artifacts in no dataset, not pinned, and no input of anything."""
    for other in (members, pinned, sources):
        artifacts = artifacts.join(other.select(key), key, "left_anti")
    return artifacts


def pinned_ids(artifacts: DataFrame, pins: DataFrame) -> DataFrame:
    """Artifacts that pins name by id, run or dataset."""
    named = [artifacts.join(pins.where(F.col(c).isNotNull()).select(c).distinct(), c, "left_semi").select("artifact_id") for c in ("artifact_id", "run_id", "dataset_id") if c in artifacts.columns and c in pins.columns]
    out = named[0]
    for n in named[1:]:
        out = out.union(n)
    return out.distinct()


def merge_features(old: Column, new: Column) -> Column:
    """Both maps' entries; where they share a key, the new value."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons; a null part counts as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def invalidation_reasons(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def numbered(frame: DataFrame, order: list[Column]) -> DataFrame:
    """Adds n, the position in the order from 0, without bringing all rows to one task: parts are counted first."""
    part = cut(frame.orderBy(*order).withColumn("_p", F.spark_partition_id()))
    placed = part.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = part.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")  # one row for each partition
    return placed.join(F.broadcast(before), "_p").withColumn("n", F.col("_r") - 1 + F.col("_before")).drop("_p", "_r", "_before")


def placed(frame: DataFrame, by: list[str], order: list[str], name: str, dense: bool = False) -> DataFrame:
    """Adds a row's place in its group from 1, for groups of any size: ranges of (by, order) are counted first, and a group's later ranges shifted by those before. Rows of equal order lie in one range; they have one place if dense."""
    part = cut(frame.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    inner = (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy(*by, "_p").orderBy(*order))
    heads = (part.select(*by, *order, "_p").distinct() if dense else part).groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    shift = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), shift.alias("_shift"))  # a row for each range and group
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_q"))
    return part.withColumn("_r", inner).join(heads, same).withColumn(name, (F.col("_r") + F.col("_shift")).cast("int")).select(*frame.columns, name)


def status_shares(frame: DataFrame) -> DataFrame:
    """(batch, status, n, share of the batch)."""
    counted = frame.groupBy("batch", "status").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("batch")))

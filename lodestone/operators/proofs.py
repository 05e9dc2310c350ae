"""Constraint results built one by one, proofs made of them, and verification reports made of checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _result(name: str, tier: str, value: Column, limit: Column, margin: Column, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("constraint_id"), F.lit(tier).alias("tier"), value.cast("double").alias("value"), limit.cast("double").alias("limit"), margin.cast("double").alias("margin"), passed.alias("passed"))


def at_least(name: str, tier: str, value: Column, limit: Column) -> Column:
    return _result(name, tier, value, limit, value - limit, value >= limit)


def at_most(name: str, tier: str, value: Column, limit: Column) -> Column:
    return _result(name, tier, value, limit, limit - value, value <= limit)


def equals(name: str, tier: str, value: Column, wanted: Column, tolerance: float = 0) -> Column:
    """The margin is what is left of the tolerance."""
    return _result(name, tier, value, wanted, F.lit(tolerance) - F.abs(value - wanted), F.abs(value - wanted) <= tolerance)


def holds(name: str, tier: str, condition: Column) -> Column:
    """The margin is 0 or -1."""
    return _result(name, tier, condition.cast("int"), F.lit(1), condition.cast("int") - 1, condition)


def evaluate(frame: DataFrame, key: str, results: list[Column]) -> DataFrame:
    """Long form: key, constraint_id, tier, value, limit, margin, passed. Results of null are left out."""
    return frame.select(key, F.inline(F.array(*results))).where("passed IS NOT NULL")


def proof(long: DataFrame, key: str) -> DataFrame:
    """key, passed, n_failed, failures (names in order), first_failing_tier."""
    failed = ~F.col("passed")
    return long.groupBy(key).agg(F.every("passed").alias("passed"), F.count_if(failed).alias("n_failed"), F.array_sort(F.collect_list(F.when(failed, F.col("constraint_id")))).alias("failures"), F.min(F.when(failed, F.col("tier"))).alias("first_failing_tier"))


def enforce(long: DataFrame, key: str) -> DataFrame:
    """The results unchanged; an action on them fails at the first that didn't pass, with its name and key."""
    message = F.concat(F.lit("constraint "), F.col("constraint_id"), F.lit(" failed for "), F.col(key).cast("string"))
    return long.where(F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def antipads(layers: DataFrame, key: str, clearance: int) -> DataFrame:
    """Of (key, layer, pad, size_x, size_y, drill): margins of coverage and of both directions, long."""
    own = F.array(
        F.struct(F.lit("COVERAGE").alias("check"), (F.least("size_x", "size_y") - F.col("pad")).alias("margin")),
        F.struct(F.lit("X").alias("check"), (F.floor((F.col("size_x") - F.col("drill")) / 2) - clearance).cast("bigint").alias("margin")),
        F.struct(F.lit("Y").alias("check"), (F.floor((F.col("size_y") - F.col("drill")) / 2) - clearance).cast("bigint").alias("margin")),
    )
    return layers.select(key, "layer", F.inline(own)).select(key, F.concat(F.lit("T3_ANTIPAD_"), F.col("layer"), F.lit("_"), F.col("check")).alias("constraint_id"), "margin", (F.col("margin") >= 0).alias("passed"))


def verify(artifacts: DataFrame, inputs: DataFrame, objects: DataFrame, types: list[str], roles: list[str]) -> DataFrame:
    """(artifact_id, check) of every check that an artifact fails: type and role known, digest well formed, size not negative, inputs there, content there, content of that size."""
    rules: Mapping[str, Column] = {
        "unknown_type": ~F.col("artifact_type").isin(*types),
        "unknown_role": F.size(F.array_except("roles", F.array(*[F.lit(r) for r in roles]))) > 0,
        "malformed_digest": ~F.col("digest").rlike("^[0-9a-f]{64}$"),
        "negative_size": F.col("byte_size") < 0,
    }
    own = artifacts.select("artifact_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("check"))
    missing = inputs.join(artifacts.select(F.col("artifact_id").alias("input_id")), "input_id", "left_anti").select("artifact_id", F.lit("missing_input").alias("check")).distinct()
    stored = artifacts.join(objects.select("digest", F.col("length").alias("_length")), "digest", "left")
    content = stored.select("artifact_id", F.when(F.col("_length").isNull(), "missing_object").when(F.col("_length") != F.col("byte_size"), "size_mismatch").alias("check")).where("check IS NOT NULL")
    return own.union(missing).union(content)


def missing_roles(reached: DataFrame, required: list[str]) -> DataFrame:
    """(origin, missing): required roles that none of an origin's ancestors has, of (origin, roles)."""
    have = reached.select("origin", F.explode_outer("roles").alias("r")).groupBy("origin").agg(F.collect_set("r").alias("have"))
    return have.select("origin", F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "have")).alias("missing"))


def utilisation(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and largest sample of each device."""
    return samples.groupBy(by).agg(F.count("*").alias("samples"), F.avg(value).alias("mean"), F.max(value).alias("largest"))

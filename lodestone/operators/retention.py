"""Retention: which artifacts a policy keeps and why, and what a space budget deletes besides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    keep_min_age_days: float = 0
    keep_min_count: int = 0
    keep_types: tuple[str, ...] = ()
    keep_roles: tuple[str, ...] = ()
    keep_pinned: bool = True
    keep_ancestors_of_pinned: bool = True
    keep_with_descendants: bool = True
    budget_bytes: int | None = None
    #: Reasons that a space budget never overrides.
    firm: tuple[str, ...] = field(default=("pinned", "ancestor_of_pinned", "protected_type", "protected_role"))


def evaluate(artifacts: DataFrame, policy: Policy, as_of: str, pinned: DataFrame, pinned_ancestors: DataFrame, with_descendants: DataFrame) -> DataFrame:
    """Adds reason, the first that holds: pinned, ancestor_of_pinned, has_descendants, protected_type, protected_role, age, min_count, delete.

    min_count keeps the oldest of each type: as long as fewer of them are kept than the policy asks for.
    """
    flag = lambda f, name: f.select("artifact_id", F.lit(True).alias(name)).distinct()
    oldest = Window.partitionBy("artifact_type").orderBy("created_utc", "artifact_id")
    first = artifacts.select("artifact_type", "created_utc", "artifact_id", F.row_number().over(oldest).alias("_r")).where(F.col("_r") <= policy.keep_min_count)  # each task keeps no more of a type
    joined = artifacts.join(flag(pinned, "_pin"), "artifact_id", "left").join(flag(pinned_ancestors, "_anc"), "artifact_id", "left").join(flag(with_descendants, "_desc"), "artifact_id", "left").join(flag(first, "_old"), "artifact_id", "left")
    age = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.to_timestamp("created_utc"))) / 86_400_000_000
    rules = [
        ("pinned", F.lit(policy.keep_pinned) & F.col("_pin").isNotNull()),
        ("ancestor_of_pinned", F.lit(policy.keep_ancestors_of_pinned) & F.col("_anc").isNotNull()),
        ("has_descendants", F.lit(policy.keep_with_descendants) & F.col("_desc").isNotNull()),
        ("protected_type", F.col("artifact_type").isin(*policy.keep_types) if policy.keep_types else F.lit(False)),
        ("protected_role", F.arrays_overlap("roles", F.array(*[F.lit(r) for r in policy.keep_roles])) if policy.keep_roles else F.lit(False)),
        ("age", age < policy.keep_min_age_days),
        ("min_count", F.col("_old").isNotNull()),
    ]
    reason = F.lit("delete")
    for name, rule in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    return joined.withColumn("reason", reason).drop("_pin", "_anc", "_desc", "_old")


def with_budget(evaluated: DataFrame, policy: Policy, buckets: int = 64) -> DataFrame:
    """Adds delete: what the policy deletes, and, oldest first, what else must go until the rest fits the budget.

    The running sum over all artifacts is taken within ranges of creation time and shifted by the ranges before, so that
    no task holds all rows.
    """
    if policy.budget_bytes is None:
        return evaluated.withColumn("delete", F.col("reason") == "delete")
    kept = evaluated.where("reason <> 'delete'")
    soft = kept.where(~F.col("reason").isin(*policy.firm))
    total = kept.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total")).withColumn("_one", F.lit(1))
    day = soft.withColumn("_day", F.substring("created_utc", 1, 10))
    sums = day.groupBy("_day").agg(F.sum("byte_size").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_day", "_before")  # one row for each day
    inner = Window.partitionBy("_day").orderBy("created_utc", "artifact_id").rowsBetween(Window.unboundedPreceding, -1)
    running = day.withColumn("_run", F.coalesce(F.sum("byte_size").over(inner), F.lit(0))).join(before, "_day")
    over = running.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").where(F.col("_run") + F.col("_before") < F.col("total") - policy.budget_bytes).select("artifact_id", F.lit(True).alias("_over"))  # total is one row
    return evaluated.join(over, "artifact_id", "left").withColumn("delete", (F.col("reason") == "delete") | F.col("_over").isNotNull()).drop("_over")


def totals(decided: DataFrame) -> DataFrame:
    """One row for each reason: n, deleted, bytes_freed (logical, whether or not content is shared)."""
    return decided.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("delete").alias("deleted"), F.coalesce(F.sum(F.when(F.col("delete"), F.col("byte_size"))), F.lit(0)).alias("bytes_freed"))

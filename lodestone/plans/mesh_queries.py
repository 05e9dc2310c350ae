"""Mesh plans of boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import mesh_plans as M
from lodestone.plans.registry import query, table


@query("""SELECT p_partkey, -200000::BIGINT AS first, CAST(1200000 + p_size * 100000 AS BIGINT) AS last, true AS within_cap, true AS within_ratio FROM part""")
def mesh_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis for each part, with a round feature: where it begins and ends, and whether cap and ratio hold. Tests hold the lines themselves."""
    size = F.col("p_size") * 100_000
    feature = F.array(F.struct((F.floor(size / 2) + 500_000).cast("bigint").alias("centre"), (300_000 + F.col("p_size") * 1000).cast("bigint").alias("radius")))
    cap = M.largest_cell(F.lit(2e10) + F.col("p_size") * 1e9, F.lit(4.2), F.lit(20), F.lit(250_000))
    fixed = M.fixed_lines(F.lit(0).cast("bigint"), (size + 1_000_000).cast("bigint"), F.lit(200_000).cast("bigint"), feature)
    axes = table(spark, sf_dir, "part").select("p_partkey", fixed.alias("fixed"), cap.alias("cap"))
    got = M.summary(M.plans(axes, "p_partkey", 1.5), "p_partkey").join(axes.select("p_partkey", "cap"), "p_partkey")
    return got.select("p_partkey", "first", "last", (F.col("largest_cell") <= F.col("cap")).alias("within_cap"), (F.col("worst_ratio") <= 1.5).alias("within_ratio"))

"""Exact percentiles of groups of any size, without holding a group's values: ranks are found by refined histograms.

A percentile lies between two ranks. Each round counts the values that are left for a rank in BINS bins between the least
and the greatest of them, and goes on with the bin that holds the rank, narrowed to the values that it has; a rank is
settled when its bin has one value. Bins are counted with partial sums, so a task holds BINS counts for each rank at most,
and each round takes the span of values down by BINS or to what is there: about six rounds for doubles of any spread.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.session import cut

BINS = 1024
#: Ranks that are sent to all tasks; beyond, only those of groups of more values than MANY are.
FEW, MANY = 50_000, 100_000


def percentiles(frame: DataFrame, by: list[str], value: str, shares: Iterable[float]) -> DataFrame:
    """(by.., share, n, percentile): linear between the two nearest ranks, as SQL's percentile. Nulls don't count, NaN is the greatest value; a group of nulls has no row."""
    shares = sorted(set(shares))
    if not shares or not 0 <= shares[0] <= shares[-1] <= 1:
        raise ValueError("shares are from 0 to 1")
    own = frame.select(F.struct(*[F.col(c) for c in by]).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    each = cut(own.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    place = each.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    ranks = place.select("g", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"), "lo", "hi", "n").distinct()
    many = (F.col("n") > MANY).alias("many")
    state = cut(ranks.select("g", "rank", F.col("rank").alias("k"), "lo", "hi", many))
    settled = state.where("lo = hi")
    open_ = state.where("lo <> hi")
    before = Window.partitionBy("g", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not open_.isEmpty():
        ratio = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inner = F.when(F.isnan(ratio), 1).otherwise(1 + F.floor(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * (BINS - 1)))
        bin_ = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS + 1).otherwise(inner).cast("int")
        to = open_.withColumnRenamed("g", "h")
        near = lambda side: own.join(side, F.col("g").eqNullSafe(F.col("h"))).where("v >= lo AND v <= hi")  # noqa: B023, E731
        if open_.count() <= FEW:
            here = near(F.broadcast(to))
        else:  # groups of many values are few, and shuffled by their group they would fill one task
            here = near(F.broadcast(to.where("many"))).union(near(to.where("NOT many").hint("merge")))
        here = here.select("g", "rank", "k", "many", "v", bin_.alias("bin"))
        counted = here.groupBy("g", "rank", "k", "many", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("upto", F.sum("c").over(before))
        state = cut(counted.where("upto > k AND upto - c <= k").select("g", "rank", (F.col("k") - F.col("upto") + F.col("c")).alias("k"), "lo", "hi", "many"))
        settled, open_ = settled.union(state.where("lo = hi")), state.where("lo <> hi")
    found = cut(settled.select(F.col("g").alias("h"), "rank", F.col("lo").alias("x")))
    low, high = found.toDF("h1", "r1", "x1"), found.toDF("h2", "r2", "x2")
    joined = place.join(low, F.col("g").eqNullSafe(F.col("h1")) & (F.floor("at") == F.col("r1"))).join(high, F.col("g").eqNullSafe(F.col("h2")) & (F.ceil("at") == F.col("r2")))
    between = F.when(F.floor("at") == F.ceil("at"), F.col("x1")).otherwise((F.ceil("at") - F.col("at")) * F.col("x1") + (F.col("at") - F.floor("at")) * F.col("x2"))
    return joined.select(*[F.col("g")[c].alias(c) for c in by], "share", "n", between.alias("percentile"))


def network_differences(base: DataFrame, other: DataFrame) -> DataFrame:
    """(network_id, delta) of the cells that both have: the size of their difference."""
    keys = ["network_id", "f_idx", "i", "j"]
    b = other.select(*keys, F.col("re").alias("rb"), F.col("im").alias("ib"))
    return base.join(b, keys).select("network_id", F.hypot(F.col("re") - F.col("rb"), F.col("im") - F.col("ib")).alias("delta"))


def invariance(base: DataFrame, other: DataFrame, share: float = 0.95, limit: float = 0.01) -> DataFrame:
    """Whether networks are the same on two meshes: network_id, largest, root-mean-square and percentile of the difference, and whether the percentile is within the limit."""
    delta = cut(network_differences(base, other))
    sums = delta.groupBy("network_id").agg(F.max("delta").alias("max_delta"), F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rms_delta"))
    own = percentiles(delta, ["network_id"], "delta", [share]).select("network_id", F.col("percentile").alias("percentile_delta"))
    return sums.join(own, "network_id").withColumn("invariant", F.col("percentile_delta") <= limit)

"""Connected components of very many small groups and some very large ones, without gathering any at one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import cut


#: Edges that a task takes at least, where there are that many: rounds over a few thousand edges don't fill hundreds of files.
TASK_EDGES = 10_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (a, b); component is the smallest id. Edges in null count for nothing.

    Alternates two star contractions: every vertex hands the smallest vertex it sees to its larger neighbours, then to
    its smaller ones. Hubs are never collected: the minimum is an aggregate with partial sums, and handing it on is a join.
    """
    own = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while (now := _mark(own)) != before and now[0]:
        before = now
        tasks = -(-now[0] // TASK_EDGES)
        own = own.coalesce(tasks)
        both = own.union(own.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").coalesce(tasks)
        own = cut(joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a > b").distinct().coalesce(tasks))
    return own.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()

"""Reachability labels of lineage graphs: who is an ancestor of whom, for any number of nodes, without walking from each.

Cycles are condensed first. Of the graph that is left, each node's least parent makes a forest, whose nodes are numbered in
preorder, so that a node's descendants in the forest are an interval. Edges outside the forest hand the intervals of their
targets to their sources and to all above, where they aren't covered already; lineage has few such edges. A node is then an
ancestor of another, or itself, if one of its intervals holds the other's number: a join on the node. All ancestors of
many nodes come from a join of numbers with intervals cut into blocks of powers of 16, on (size, block).

Edges (source_id, target_id): the source is an input of the target. Every loop keeps its state in the shared folder; its
rounds are as many as the graph is deep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.session import cut


#: Bits between the sizes of blocks; blocks of more bits than LARGE are sent to all tasks while they are at most FEW, as ids asked of others are.
STEP, LARGE, FEW = 4, 8, 200_000


@dataclass
class Labels:
    """(id, comp) of all ids; (comp, start) of components; (comp, lo, hi) of all their intervals; how many numbers there are."""

    of: DataFrame
    starts: DataFrame
    intervals: DataFrame
    n: int


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that have both inputs and outputs, as all on cycles have."""
    before = None
    while (now := edges.count()) and now != before:
        before = now
        edges = cut(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    return edges


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, c): the least colour that reaches each node; colours go on from nodes whose own has just become less."""
    news = colour
    while not news.isEmpty():
        got = news.join(edges.select(F.col("a").alias("id"), "b"), "id").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("g"))
        both = cut(colour.join(got, "id", "left").select("id", F.least("c", "g").alias("c"), (F.col("g") < F.col("c")).alias("new")))
        colour, news = both.select("id", "c"), both.where("new").select("id", "c")
    return colour


def condense(edges: DataFrame) -> DataFrame:
    """(id, comp) of the nodes of edges (a, b) that lie on cycles; comp is one of the cycle's ids, the same for all that reach each other."""
    own = cut(edges.where("a <> b").distinct())
    out = own.select(F.col("a").alias("id"), F.col("a").alias("comp")).limit(0)
    left = _trimmed(own)
    while not left.isEmpty():
        ids = left.select(F.col("a").alias("id")).distinct()
        colour = _spread(cut(ids.withColumn("c", F.col("id"))), left)
        inside = left.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c"))
        found = frontier = cut(colour.where("id = c"))
        while not frontier.isEmpty():  # backwards from each colour's first node, within the colour
            back = frontier.join(inside.select(F.col("b").alias("id"), "a", "c"), ["id", "c"]).select(F.col("a").alias("id"), "c").distinct()
            frontier = cut(back.join(found, "id", "left_anti"))
            found = cut(found.union(frontier))
        out = out.union(found.select("id", F.col("c").alias("comp")))
        gone = found.select("id")
        left = _trimmed(cut(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")))
    return cut(out)


def _before(frame: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds before: the sum of value over all earlier rows; taken within ranges and shifted by the ranges before."""
    ranged = cut(frame.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    heads = ranged.groupBy("_p").agg(F.sum(value).alias("_s"))  # one row for each range
    shift = heads.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(shift, "_p").withColumn("before", F.col("_own") + F.col("_shift")).drop("_p", "_own", "_shift")


def _forest(comps: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(comp, parent, lo, hi) of a forest over acyclic edges, and how many nodes it has."""
    parents = cut(comps.join(edges.groupBy(F.col("b").alias("comp")).agg(F.min("a").alias("parent")), "comp", "left"))
    levels = [cut(parents.where("parent is null"))]
    while not levels[-1].isEmpty():
        levels.append(cut(parents.join(levels[-1].select(F.col("comp").alias("parent")), "parent", "left_semi").select("comp", "parent")))
    levels.pop()
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if not sized:
            sized.append(cut(level.withColumn("size", F.lit(1).cast("long"))))
            continue
        below = sized[-1].groupBy("parent").agg(F.sum("size").alias("s")).withColumnRenamed("parent", "comp")
        sized.append(cut(level.join(below, "comp", "left").select("comp", "parent", (F.coalesce("s", F.lit(0)) + 1).alias("size"))))
    sized.reverse()
    if not sized:
        return parents.select("comp", "parent", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")), 0
    n = sized[0].agg(F.sum("size")).first()[0]
    placed = [cut(_before(sized[0], ["comp"], "size").select("comp", "parent", F.col("before").alias("lo"), (F.col("before") + F.col("size")).alias("hi")))]
    for level in sized[1:]:
        run = cut(_before(level, ["parent", "comp"], "size"))
        first = run.groupBy("parent").agg(F.min("before").alias("first"))
        above = placed[-1].select(F.col("comp").alias("parent"), (F.col("lo") + 1).alias("base"))
        start = F.col("base") + F.col("before") - F.col("first")
        placed.append(cut(run.join(first, "parent").join(above, "parent").select("comp", "parent", start.alias("lo"), (start + F.col("size")).alias("hi"))))
    out = placed[0]
    for level in placed[1:]:
        out = out.union(level)
    return cut(out), n


def labels(nodes: DataFrame, edges: DataFrame) -> Labels:
    """Of nodes (artifact_id) and all ids that edges name."""
    raw = cut(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a is not null and b is not null").distinct())
    cyclic = condense(raw)
    ids = nodes.select(F.col("artifact_id").alias("id")).union(raw.select("a")).union(raw.select("b")).where("id is not null").distinct()
    of = cut(ids.join(cyclic, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    dag = cut(raw.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    forest, n = _forest(of.select("comp").distinct(), dag)
    own = forest.select("comp", "lo", "hi")
    extra = dag.join(forest.select(F.col("comp").alias("b"), "parent", "lo", "hi"), "b").where("a <> parent").select(F.col("a").alias("comp"), "lo", "hi")
    mine = own.toDF("comp", "l", "h")
    uncovered = lambda f: f.distinct().join(mine, "comp").where("NOT (l <= lo AND hi <= h)").select("comp", "lo", "hi")
    frontier = cut(uncovered(extra))
    have = frontier
    while not frontier.isEmpty():
        up = frontier.join(dag.select(F.col("b").alias("comp"), "a"), "comp").select(F.col("a").alias("comp"), "lo", "hi")
        frontier = cut(uncovered(up).join(have, ["comp", "lo", "hi"], "left_anti"))
        have = cut(have.union(frontier))
    return Labels(of, own.select("comp", F.col("lo").alias("start")), cut(own.union(have)), n)


def reaches(pairs: DataFrame, made: Labels) -> DataFrame:
    """Distinct (a, b) with `reaches`: whether a is an ancestor of b, or b itself; ids that the labels don't know reach nothing."""
    own = pairs.select("a", "b").distinct()
    held = cut(own.select("a").distinct().join(made.of.toDF("a", "ca"), "a").join(made.intervals.toDF("ca", "lo", "hi"), "ca").select("a", "lo", "hi"))
    held = F.broadcast(held) if held.count() <= FEW else held  # few ids asked of many fill few tasks otherwise
    ends = own.join(made.of.toDF("b", "cb").join(made.starts.toDF("cb", "start"), "cb").select("b", "start"), "b", "left")
    return ends.join(held, "a", "left").groupBy("a", "b").agg(F.coalesce(F.bool_or(F.expr("lo <= start AND start < hi")), F.lit(False)).alias("reaches"))


def _sizes(made: Labels) -> list[int]:
    """Exponents of the blocks' sizes: powers of 16."""
    return list(range(0, max(made.n, 1).bit_length() + STEP, STEP))


def _blocks(made: Labels) -> DataFrame:
    """(comp, size, block) of all intervals as blocks [block << size, (block + 1) << size), at most 30 of each size; none lies in a larger one of the same interval."""
    each = made.intervals.withColumn("size", F.explode(F.array(*[F.lit(x) for x in _sizes(made)])))
    each = each.selectExpr("comp", "size", "shiftright(lo + shiftleft(1L, size) - 1, size) AS first", "shiftright(hi, size) - 1 AS last").where("first <= last")
    each = each.selectExpr("*", f"shiftright(first + {2**STEP - 1}, {STEP}) AS above", f"shiftright(last + 1, {STEP}) AS below")  # the larger blocks inside are above to below - 1
    some = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    first, last, left, right = F.col("first"), F.col("last"), F.col("above") * 2**STEP - 1, F.col("below") * 2**STEP
    return each.select("comp", "size", F.explode(F.when(F.col("above") < F.col("below"), F.concat(some(first, left), some(right, last))).otherwise(some(first, last))).alias("block"))


def _points(comps: DataFrame, made: Labels, sizes: list[int]) -> DataFrame:
    """(comp, size, block) of the blocks of these sizes that hold a component's number."""
    each = comps.join(made.starts, "comp").withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
    return each.select("comp", "size", F.expr("shiftright(start, size)").alias("block"))


def ancestors(starts: DataFrame, made: Labels) -> DataFrame:
    """(origin, artifact_id) of all ancestors of all starts (artifact_id), themselves included."""
    own = starts.select(F.col("artifact_id").alias("id")).distinct().join(made.of, "id")
    comps = cut(own.select("comp").distinct())
    large = cut(_blocks(made).where(F.col("size") > LARGE))
    large = F.broadcast(large) if large.count() <= FEW else large  # a large block holds very many numbers, that would fill one task
    near = lambda f: f.withColumnRenamed("comp", "at")
    small = near(_points(comps, made, [x for x in _sizes(made) if x <= LARGE])).join(_blocks(made).where(F.col("size") <= LARGE).hint("merge"), ["size", "block"])
    great = near(_points(comps, made, [x for x in _sizes(made) if x > LARGE])).join(large, ["size", "block"])
    above = small.union(great).select("at", "comp").distinct()
    return own.toDF("origin", "at").join(above, "at").join(made.of.withColumnRenamed("id", "artifact_id"), "comp").select("origin", "artifact_id")


def closure(starts: DataFrame, made: Labels) -> DataFrame:
    """(artifact_id) of all that are an ancestor of any start, or one; no row for each start and ancestor."""
    own = starts.select(F.col("artifact_id").alias("id")).distinct().join(made.of, "id").select("comp").distinct()
    held = _points(own, made, _sizes(made)).select("size", "block").distinct()
    above = _blocks(made).join(held, ["size", "block"], "left_semi").select("comp").distinct()
    return made.of.join(above, "comp", "left_semi").select(F.col("id").alias("artifact_id"))

"""Lineage graphs: traversal, order, components. Frontier loops whose state is cut into the shared folder each round.

Nodes (artifact_id, artifact_type, ..), edges (source_id, target_id, relation): the source is an input of the target.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import cut


def traverse(starts: DataFrame, edges: DataFrame, upward: bool = True, max_depth: int | None = None, relations: Iterable[str] | None = None) -> DataFrame:
    """(origin, artifact_id, depth) of all that the starts (origin, artifact_id) reach, themselves at depth 0.

    All origins walk together; each round joins the frontier with the edges and drops what an origin has seen, so cycles
    end. Dangling ids are walked through; whoever wants nodes joins the result with them.
    """
    if relations is not None:
        edges = edges.where(F.col("relation").isin(*relations))
    here, there = ("target_id", "source_id") if upward else ("source_id", "target_id")
    steps = edges.select(F.col(here).alias("artifact_id"), F.col(there).alias("next")).distinct()
    frontier = cut(starts.select("origin", "artifact_id").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        found = frontier.join(steps, "artifact_id").select("origin", F.col("next").alias("artifact_id")).distinct()
        frontier = cut(found.join(seen, ["origin", "artifact_id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
    return seen


def ancestors(nodes: DataFrame, edges: DataFrame, starts: DataFrame, **options) -> DataFrame:
    """(origin, artifact_id, artifact_type, depth) of existing ancestors; a start that doesn't exist has none."""
    own = starts.select(F.col("artifact_id").alias("origin"), "artifact_id").join(nodes.select("artifact_id"), "artifact_id", "left_semi")
    return traverse(own, edges, True, **options).join(nodes, "artifact_id").select("origin", "artifact_id", "artifact_type", "depth")


def descendants(nodes: DataFrame, edges: DataFrame, starts: DataFrame, **options) -> DataFrame:
    """(origin, artifact_id, artifact_type, depth) of existing descendants."""
    own = starts.select(F.col("artifact_id").alias("origin"), "artifact_id").join(nodes.select("artifact_id"), "artifact_id", "left_semi")
    return traverse(own, edges, False, **options).join(nodes, "artifact_id").select("origin", "artifact_id", "artifact_type", "depth")


def subgraph_edges(reached: DataFrame, edges: DataFrame, max_depth: int | None = None, upward: bool = True) -> DataFrame:
    """Edges of the nodes that a traversal expanded: all reached, but those at the greatest depth."""
    inner = reached.where(F.col("depth") < max_depth) if max_depth is not None else reached
    end = "target_id" if upward else "source_id"
    return inner.select("origin", F.col("artifact_id").alias(end)).join(edges, end).select("origin", "source_id", "target_id", "relation").distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing went into."""
    return nodes.join(edges.select(F.col("target_id").alias("artifact_id")), "artifact_id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that went into nothing."""
    return nodes.join(edges.select(F.col("source_id").alias("artifact_id")), "artifact_id", "left_anti")


def direct_inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target_id, artifact_id, relation) of inputs that exist."""
    return edges.withColumnRenamed("source_id", "artifact_id").join(nodes.select("artifact_id"), "artifact_id").select("target_id", "artifact_id", "relation")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(statistic, key, n): nodes by type, edges by relation, roots, leaves."""
    by = lambda f, c, name: f.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "key", "n")
    one = lambda f, name: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), F.lit("").alias("key"), "n")
    return by(nodes, "artifact_type", "nodes_by_type").union(by(edges, "relation", "edges_by_relation")).union(one(roots(nodes, edges), "roots")).union(one(leaves(nodes, edges), "leaves"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, level): the longest way from a root; order by (level, artifact_id). Nodes on or behind a cycle have no level.

    Edges are written once. Each round writes only how many inputs of which nodes its frontier has settled; a node is
    ready when these add up to its number of inputs, so all rounds together write no more than the edges. A node that is
    its own input is never ready.
    """
    names = nodes.select("artifact_id").distinct()
    own = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).join(names.withColumnRenamed("artifact_id", "a"), "a", "left_semi").join(names.withColumnRenamed("artifact_id", "b"), "b", "left_semi")
    own = cut(own.distinct())
    inputs = cut(own.groupBy("b").agg(F.count("*").alias("n")))
    ready = cut(names.join(inputs.select(F.col("b").alias("artifact_id")), "artifact_id", "left_anti").withColumn("level", F.lit(0)))
    out, settled, level = ready, None, 0
    while not ready.isEmpty():
        level += 1
        step = cut(own.join(ready.select(F.col("artifact_id").alias("a")), "a", "left_semi").groupBy("b").agg(F.count("*").alias("c")))
        settled = step if settled is None else settled.union(step)
        total = settled.join(step.select("b"), "b", "left_semi").groupBy("b").agg(F.sum("c").alias("c"))
        ready = cut(total.join(inputs, "b").where("c = n").select(F.col("b").alias("artifact_id"), F.lit(level).alias("level")))
        out = out.union(ready)
    return out


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) of undirected edges (a, b) of one orderable type; component is the smallest id. Alternates large-star and small-star steps, so hubs are never gathered. Nodes (id) without edges are their own."""
    own = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = None
    while (now := mark(own)) != before and now[0]:
        before = now
        both = own.union(own.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        own = cut(joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a > b").distinct())
    out = own.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
    if nodes is not None:
        out = out.union(nodes.select("id").distinct().join(out, "id", "left_anti").select("id", F.col("id").alias("component")))
    return out


def ancestors_of_pins(edges: DataFrame, nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """Ids that are an ancestor of some pin; a pin counts only as another pin's ancestor."""
    return ancestors(nodes, edges, pins).where("origin <> artifact_id").select("artifact_id").distinct()


def audit(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(origin, n_ancestors, n_edges, root_ids) of each audited artifact. The roots are one array: audit_roots gives them as rows, for wide graphs."""
    reached = cut(ancestors(nodes, edges, targets))
    tops = reached.join(edges.select(F.col("target_id").alias("artifact_id")), "artifact_id", "left_anti").groupBy("origin").agg(F.array_sort(F.collect_set("artifact_id")).alias("root_ids"))
    counted = reached.groupBy("origin").agg((F.count("*") - 1).alias("n_ancestors"))
    links = subgraph_edges(reached, edges).groupBy("origin").agg(F.count("*").alias("n_edges"))
    return counted.join(links, "origin", "left").join(tops, "origin", "left").select("origin", "n_ancestors", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("root_ids", F.array().cast("array<string>")).alias("root_ids"))


def audit_roots(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(origin, artifact_id): the roots that each audited artifact comes from."""
    reached = ancestors(nodes, edges, targets)
    return reached.join(edges.select(F.col("target_id").alias("artifact_id")), "artifact_id", "left_anti").select("origin", "artifact_id")


def audit_types(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(origin, artifact_type, n): how many ancestors of each type an audited artifact has, itself left out."""
    return ancestors(nodes, edges, targets).where("origin <> artifact_id").groupBy("origin", "artifact_type").agg(F.count("*").alias("n"))

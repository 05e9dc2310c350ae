"""Which round shapes of a net touch, by a grid instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import cut


def touching(points: DataFrame, largest_radius: int) -> DataFrame:
    """(a, b), a < b, of points (id, net, x, y, r) of one net with dist² <= (ra + rb)². Radii are at most largest_radius, so partners lie in neighbouring cells of twice that size."""
    side = 2 * largest_radius
    placed = points.select("id", "net", "x", "y", "r", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    near = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = placed.select(F.col("id").alias("a"), "net", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("r").alias("ar"), near.alias("cell")).select("a", "net", "ax", "ay", "ar", "cell.cx", "cell.cy")
    right = placed.select(F.col("id").alias("b"), "net", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("r").alias("br"), "cx", "cy")
    dx, dy, r = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"), F.col("ar") + F.col("br")
    return left.join(right, ["net", "cx", "cy"]).where((F.col("a") < F.col("b")) & (dx * dx + dy * dy <= r * r)).select("a", "b")


def links(points: DataFrame, largest_radius: int) -> DataFrame:
    """(a, b) that tie what `touching` ties, directly or by way of others, without a row for each pair of shapes of one centre.

    Shapes of one centre touch each other, and the largest of them touches all that any of them does; so they are tied to
    it, and only the largest ones are compared.
    """
    at = ["net", "x", "y"]
    tops = cut(points.dropna(subset=["id", *at, "r"]).groupBy(*at).agg(F.max(F.struct("r", "id")).alias("top")).select(F.col("top.id").alias("id"), *at, F.col("top.r").alias("r")))
    own = points.join(tops.select(*at, F.col("id").alias("top")), at).where("id <> top").select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b"))
    return touching(tops, largest_radius).union(own)

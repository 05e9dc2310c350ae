"""Queries and statistics over artifact, dataset and run records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Members of a snapshot whose sorted digests (64 bytes each) are gathered for a manifest's hash.
MOST_MEMBERS = 2_000_000


def select_records(
    frame: DataFrame,
    equal: Mapping[str, object] | None = None,
    between: Mapping[str, tuple[object | None, object | None]] | None = None,
    any_role: Iterable[str] | None = None,
    order_by: str | None = None,
    descending: bool = True,
    tie: str = "artifact_id",
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """All conditions hold: equal columns, ranges with both ends included and open where None, one of the roles. An offset counts only with a limit; ties in the order go by the last key."""
    for column, value in (equal or {}).items():
        if value is not None:
            frame = frame.where(F.col(column) == F.lit(value))
    for column, (low, high) in (between or {}).items():
        if low is not None:
            frame = frame.where(F.col(column) >= F.lit(low))
        if high is not None:
            frame = frame.where(F.col(column) <= F.lit(high))
    if any_role:
        frame = frame.where(F.arrays_overlap("roles", F.array(*[F.lit(r) for r in any_role])))
    if order_by:
        frame = frame.orderBy(F.col(order_by).desc() if descending else F.col(order_by), tie)
    if limit is not None:
        frame = frame.offset(offset).limit(limit) if offset else frame.limit(limit)
    return frame


def slice_members(frame: DataFrame, ids: DataFrame | None = None, ranges: Mapping[str, tuple[float | None, float | None]] | None = None, start: int = 0, stop: int | None = None, key: str = "artifact_id") -> DataFrame:
    """Members by id set, then feature ranges (nulls fall out), then position in key order."""
    if ids is not None:
        frame = frame.join(ids.select(key).distinct(), key, "left_semi")
    for column, (low, high) in (ranges or {}).items():
        frame = frame.where(F.col(column).isNotNull())
        frame = frame.where(F.col(column) >= low) if low is not None else frame
        frame = frame.where(F.col(column) <= high) if high is not None else frame
    frame = frame.orderBy(key)
    return frame.offset(start).limit(stop - start) if stop is not None else frame.offset(start)


def storage_stats(frame: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """n, bytes, distinct contents, and the ratio of all to distinct (1 when empty)."""
    agg = [F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"), F.count_distinct("digest").alias("unique_contents")]
    out = frame.groupBy(*by).agg(*agg)
    return out.withColumn("dedup_ratio", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("unique_contents").cast("double")), F.lit(1.0)))


def latest_versions(frame: DataFrame, name: str, version: str) -> DataFrame:
    """The row with the greatest version text of each name."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(F.col(version).desc()))).where("_r = 1").drop("_r")


def fingerprint(frame: DataFrame, by: Iterable[str], digest: str = "digest") -> DataFrame:
    """members, and two numbers that stand for each group's digests, whatever their order: sums of hashes, added up in parts, for groups of any size."""
    two = (F.sum(F.xxhash64(digest).cast("decimal(38,0)")).alias("sum_a"), F.sum(F.xxhash64(F.lit(1), digest).cast("decimal(38,0)")).alias("sum_b"))
    return frame.groupBy(*by).agg(F.count("*").alias("members"), *two)


def same_members(before: DataFrame, after: DataFrame, by: Iterable[str], digest: str = "digest") -> DataFrame:
    """by, intact: whether a group of both frames has the same digests in both."""
    a, b = (fingerprint(f, by, digest) for f in (before, after))
    same = (F.col("members") == F.col("_n")) & (F.col("sum_a") == F.col("_a")) & (F.col("sum_b") == F.col("_b"))
    return a.join(b.toDF(*by, "_n", "_a", "_b"), list(by)).select(*by, same.alias("intact"))


def delete(frame: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The records but those of the keys. An index entry goes by itself: nothing that names it goes with it."""
    return frame.join(keys.select(key).distinct(), key, "left_anti").select(frame.columns)


def manifest_hash(frame: DataFrame, by: Iterable[str], digest: str = "digest", most: int = MOST_MEMBERS) -> DataFrame:
    """SHA-256 of each group's digests, sorted and joined by line ends: a group is a snapshot, whose members fit a manifest. One of more than `most` members fails before it is gathered."""
    by = list(by)
    large = frame.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    kept = frame.select(*by, F.col(digest).alias("_digest")).join(large, by, "left")
    message = F.concat(F.lit("a manifest of "), F.col("_n").cast("string"), F.lit(f" members; at most {most} are hashed"))
    own = kept.withColumn("_digest", F.when(F.col("_n").isNull(), F.col("_digest")).otherwise(F.raise_error(message).cast("string")))
    digest = "_digest"
    return own.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), "\n"), 256).alias("manifest_hash"))


def grouped_stats(frame: DataFrame, *groups: str) -> DataFrame:
    """count and bytes by each of the columns on its own, in one pass."""
    sets = [[F.col(g)] for g in groups]
    named = [F.when(F.grouping(g) == 0, F.lit(g)) for g in groups]
    return frame.groupingSets(sets, *[F.col(g) for g in groups]).agg(F.coalesce(*named).alias("grouping_column"), F.count("*").alias("n"), F.sum("byte_size").alias("bytes")).select("grouping_column", F.coalesce(*[F.col(g).cast("string") for g in groups]).alias("value"), "n", "bytes")


def feature_ranges(frame: DataFrame, features: Iterable[str]) -> DataFrame:
    """min and max of each numeric feature, as rows; nulls are left out."""
    long = frame.select(F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "value"))
    return long.where("value is not null").groupBy("feature").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def diff(before: DataFrame, after: DataFrame, key: str = "artifact_id", digest: str = "digest") -> DataFrame:
    """added, removed, modified or unchanged for every key of either snapshot."""
    a = before.select(key, F.col(digest).alias("old_digest"))
    b = after.select(key, F.col(digest).alias("new_digest"))
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def advance(base: DataFrame, removed: DataFrame, added: DataFrame, key: str = "artifact_id") -> DataFrame:
    """The next version of a snapshot: keys removed go, added rows replace rows of the same key."""
    gone = removed.select(key).union(added.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(added)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], latest: str, keep_old: bool = False) -> DataFrame:
    """Base with new rows put in: of a key's new rows the one with the greatest `latest` counts (the greatest row on ties); it replaces the old row, or is passed over where there is one if old rows are kept."""
    order = F.struct(F.col(latest), F.struct(*[F.col(c) for c in sorted(new.columns)]))
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    if keep_old:
        return base.unionByName(last.join(base.select(*keys).distinct(), keys, "left_anti"))
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def set_status(frame: DataFrame, changes: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Rows with the status that changes (key, status, one row for a key) give them; other rows stay."""
    new = changes.select(key, F.col(status).alias("_new"))
    return frame.join(new, key, "left").withColumn(status, F.coalesce("_new", status)).select(frame.columns)


def overlay(base: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Base values with overrides in their place."""
    over = overrides.select(key, F.col(value).alias("_over"))
    return base.join(over, key, "left").select(key, F.coalesce("_over", value).alias(value))


def coverage(expected: Column, provided: Column, consumed: Column) -> dict[str, Column]:
    """Differences of sets of names, and the share of what was expected that was consumed (1 when nothing was)."""
    share = F.size(F.array_intersect(expected, consumed)).cast("double") / F.size(expected).cast("double")
    return {"unused": F.array_except(provided, consumed), "unconsumed": F.array_except(expected, consumed), "ratio": F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(share)}

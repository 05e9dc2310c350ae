"""Leaves of JSON documents by VARIANT: parsed once, exploded level by level, without Python.

Rounds are as many as documents are deep; each reads only the values that still are objects or lists, which the round before
wrote. Names are joined by dots and list items are [i], as `documents.leaf_paths` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import cut

#: Levels that a document may have, as Spark's own parser allows them.
DEEPEST = 1000


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, or else a leaf's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^(OBJECT|ARRAY)", 1)


def leaves(frame: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys.., path, value) of all leaves that aren't null, as text; empty objects and lists have none.

    A null document, or text that isn't JSON, has no leaves. A document that is a leaf itself has the path "". Of repeated
    names in one object the last counts, as VARIANT keeps them.
    """
    spark = frame.sparkSession
    own = frame.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.try_parse_json(column).alias("v")).where("v is not null")
    names = [f"k{i}" for i in range(len(keys))]
    now = cut(own.select(*names, F.lit("").alias("path"), "v"))
    out = None
    for _ in range(DEEPEST):
        kind = now.withColumn("kind", _kind(F.col("v")))
        done = kind.where("kind = '' AND NOT is_variant_null(v)").select(*names, "path", F.col("v").cast("string").alias("value"))
        out = done if out is None else out.union(done)
        inner = kind.where("kind <> ''")
        exploded = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("kind") == "ARRAY", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), F.col("key")))
        now = cut(exploded.select(*names, step.alias("path"), F.col("value").alias("v")))
        if now.isEmpty():
            break
    return out.toDF(*keys, "path", "value")


def path_counts(found: DataFrame) -> DataFrame:
    """(path, documents): which parameters a corpus uses, list positions aside; for documents' rows counted with partial sums."""
    return found.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path")).agg(F.count("*").alias("n"))

"""Exact percentiles against sorted lists, and Spark's own that holds all values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import percentiles as P


def test_same_as_sorted_values(spark, monkeypatch):
    monkeypatch.setattr(P, "BINS", 8)
    rnd = random.Random(2)
    groups = {
        "normal": [rnd.gauss(0, 1) for _ in range(500)],
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(200)],
        "ties": [float(rnd.randrange(3)) for _ in range(301)],
        "one": [7.5],
        "odd": [math.inf, -math.inf, 0.0, -0.0, 1e308, -1e308, 5e-324, math.inf],
        None: [1.0, 2.0, 4.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("nulls", None), ("ties", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.share): (r.n, r.percentile) for r in P.percentiles(frame, ["g"], "v", [0, 0.25, 0.95, 1]).collect()}
    assert {g for g, _ in got} == set(groups)
    for (g, share), (n, value) in got.items():
        own = sorted(groups[g])
        at = share * (len(own) - 1)
        a, b = own[math.floor(at)], own[math.ceil(at)]
        want = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b if at != math.floor(at) else a
        assert n == len(own)
        assert value == want or math.isnan(value) and math.isnan(want)


def test_same_as_spark_and_no_rows(spark):
    frame = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, F.lit(None)).otherwise(F.sin("id")).alias("v"), F.col("id").alias("n"))
    want = {r.g: r.p for r in frame.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("p")).where("p is not null").collect()}
    assert {r.g: r.percentile for r in P.percentiles(frame, ["g"], "v", [0.9]).collect()} == want
    assert P.percentiles(frame.limit(0), ["g"], "v", [0.5]).count() == 0
    nan = spark.createDataFrame([(1, math.nan), (1, 1.0), (1, 2.0)], "g int, v double")
    assert [r.percentile for r in P.percentiles(nan, ["g"], "v", [0.5]).collect()] == [2.0]
    with pytest.raises(ValueError, match="from 0 to 1"):
        P.percentiles(frame, ["g"], "v", [1.5])


def test_large_groups_are_not_gathered(spark, monkeypatch, tmp_path):
    """Few ranks go to all tasks, whatever size Spark expects of them; of many ranks, those of large groups."""
    frame = spark.range(9_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 90).alias("g"), F.sin("id").alias("v"))
    seen = []
    monkeypatch.setattr(P, "cut", lambda f, real=P.cut: (seen.append(f._jdf.queryExecution().toString()), real(f))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = {r.g: r.p for r in frame.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("p")).collect()}
        for few, sorts in ((1_000, False), (0, True)):
            seen.clear()
            monkeypatch.setattr(P, "FEW", few)
            monkeypatch.setattr(P, "MANY", 1_000)
            assert {r.g: r.percentile for r in P.percentiles(frame, ["g"], "v", [0.9]).collect()} == want
            rounds = [x for x in seen if "upto" in x]
            assert rounds and all("BroadcastHashJoin" in x and ("SortMergeJoin" in x) == sorts for x in rounds)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

"""Interpolation in ranges gives what a window for each whole network gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import networks as N


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_ranges_are_as_whole_networks(spark, blocks):
    rnd = random.Random(blocks)
    lengths = {"long": 400, "one": 1, "two": 2, "mid": 30}  # the first is nine tenths of all rows
    own = [(n, i, j, float(f), rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for n, k in lengths.items() for f in rnd.sample(range(1000), k) for i, j in ((1, 1), (1, 2))]
    grid = [(n, float(f)) for n in lengths for f in [-5, 2000, *rnd.sample(range(1000), 60)]] + [("long", 0.5), ("long", 0.5), ("none", 1.0)]
    own += [("gap", 1, 1, float(f), float(f), -float(f)) for f in (0, 1000)]
    grid += [("gap", float(f)) for f in range(0, 1001, 5)]
    own = spark.createDataFrame(own, "network_id string, i int, j int, freq_hz double, re double, im double")
    grid = spark.createDataFrame(grid, "network_id string, freq_hz double")
    got = sorted(map(tuple, N.interpolate_blocks(own, grid, blocks).collect()))
    assert got == sorted(map(tuple, N.interpolate(own, grid).collect())) and len(got) > 400
    gap = [r for r in got if r[0] == "gap"]
    assert len(gap) == 201 and all(abs(r[4] - r[3]) < 1e-9 for r in gap)


def test_one_network_fills_many_tasks(spark):
    own = spark.range(20_000).select(F.lit("n").alias("network_id"), F.lit(1).alias("i"), F.lit(1).alias("j"), F.col("id").cast("double").alias("freq_hz"), F.rand(1).alias("re"), F.rand(2).alias("im"))
    ranged = own.repartitionByRange(16, "network_id", "i", "j", "freq_hz").groupBy(F.spark_partition_id().alias("block")).count().collect()
    assert len(ranged) >= 12 and max(r["count"] for r in ranged) < 4_000
    assert N.interpolate_blocks(own, own, 16).join(own.toDF("network_id", "i", "j", "freq_hz", "re2", "im2"), ["network_id", "i", "j", "freq_hz"]).where("re = re2 AND im = im2").count() == 20_000
    assert N.interpolate_blocks(own.limit(0), own, 4).count() == 0


def test_series_of_whole_labels(spark, tmp_path):
    """Networks of a label go on beyond 250 vectors: one window, one file."""
    from lodestone.plans import catalog

    own = spark.range(900).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0).cast("float"), 32).alias("embedding"), (F.col("id") % 3 + 1).cast("int").alias("label"))
    own.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["windowed_series"](spark, str(tmp_path)).where("i = 1 AND j = 1").collect()
    assert sorted((r.network_id, r.f_idx) for r in got) == [(n, k + 1) for n in "123" for k in range(300)]
    assert all(abs(r.re - (1 - math.cos(2 * math.pi * (r.f_idx - 1) / 299))) < 1e-7 for r in got)
    assert sorted(r.f_idx for r in catalog.queries()["sparameter_csv"](spark, str(tmp_path)).collect()) == sorted([*range(1, 301)] * 4)


@pytest.mark.parametrize("way", [N.interpolate, N.interpolate_blocks])
def test_no_frame_is_made_anew_for_each_row(spark, way):
    own = spark.range(20).select(F.lit("n").alias("network_id"), F.lit(1).alias("i"), F.lit(1).alias("j"), F.col("id").cast("double").alias("freq_hz"), F.lit(1.0).alias("re"), F.lit(2.0).alias("im"))
    assert "unboundedfollowing" not in way(own, own)._jdf.queryExecution().toString()

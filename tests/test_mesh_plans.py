"""Mesh plans keep their cap, their ratio and their fixed lines, on random axes."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import mesh_plans as M


def test_random_axes_keep_all_rules():
    rnd = random.Random(8)
    for _ in range(400):
        ratio, cap = rnd.choice([1.3, 1.5, 2.0, 3.0]), rnd.choice([20_000, 200_000, 5_000_000])
        fixed = sorted(rnd.sample(range(-1_000_000, 3_000_000), rnd.randrange(2, 9)))
        if any(b - a < 100 for a, b in zip(fixed, fixed[1:], strict=False)):
            continue
        lines = M.plan(fixed, cap, ratio)
        cells = [b - a for a, b in zip(lines, lines[1:], strict=False)]
        assert set(fixed) <= set(lines) and (lines[0], lines[-1]) == (fixed[0], fixed[-1])
        assert 0 < min(cells) and max(cells) <= cap
        assert all(max(a, b) <= min(a, b) * ratio for a, b in zip(cells, cells[1:], strict=False))


def test_thirds_clearance_and_wavelength(spark):
    boards = spark.createDataFrame([(1, 0, 1_000_000, 200_000, [(500_000, 300_000)], 1e11), (2, 0, 900, 0, [(450, 300)], 1e9), (3, 0, 900, 0, None, 1e9)], "board int, lo long, hi long, clear long, f array<struct<centre:bigint,radius:bigint>>, hz double")
    axes = boards.select("board", M.fixed_lines(F.col("lo"), F.col("hi"), F.col("clear"), F.col("f")).alias("fixed"), M.largest_cell(F.col("hz"), F.lit(1.0), F.lit(20), F.lit(1_000_000)).alias("cap"))
    got = {r.board: r.lines for r in M.plans(axes, "board", 1.5).collect()}
    assert {400_000, 600_000, -200_000, 1_200_000, 0, 1_000_000} <= set(got[1])
    assert {350, 550} <= set(got[2])
    assert got[3][0] == 0 and got[3][-1] == 900
    told = {r.board: r for r in M.summary(M.plans(axes, "board", 1.5), "board").collect()}
    assert (told[1].first, told[1].last) == (-200_000, 1_200_000)
    assert told[1].largest_cell <= 299_792_458 / 1e11 / 20 * 1e9
    assert told[1].worst_ratio <= 1.5
    cells = [b - a for a, b in zip(got[1], got[1][1:], strict=False)]
    assert (told[1].n_lines, told[1].least_cell, told[1].largest_cell) == (len(got[1]), min(cells), max(cells))


def test_odd_axes():
    assert M.plan([], 10, 1.5) == [] and M.plan([5], 10, 1.5) == [5] and M.plan([0, 1], 10, 1.5) == [0, 1]
    with pytest.raises(ValueError, match="more than"):
        M.plan([0, 10**9], 1, 1.5)


def test_equal_axes_are_planned_once_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "DEAL", 50)
    axes = spark.range(400).select("id", F.array(F.lit(0).cast("bigint"), (F.col("id") % 3 * 1000 + 900).cast("bigint")).alias("fixed"), F.lit(100).cast("bigint").alias("cap"))
    got = M.plans(axes.coalesce(1), "id", 1.5)
    assert got.rdd.getNumPartitions() == 8
    assert all(list(r.lines) == M.plan([0, r.id % 3 * 1000 + 900], 100, 1.5) for r in got.collect())

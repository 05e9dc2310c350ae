"""Reachability labels against walks from every node, on random graphs with cycles."""

import random

import pytest

from lodestone.operators import reachability as R


def walks(ids, edges):
    up = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for a in up.get(todo.pop(), ()):
                if a not in seen:
                    seen.add(a)
                    todo.append(a)
        out[i] = seen
    return out


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 25, 30), (2, 30, 60), (3, 14, 13)])
def test_same_as_walks(spark, seed, n, m):
    rnd = random.Random(seed)
    ids = [f"v{i:02}" for i in range(n)]
    edges = [(rnd.choice(ids), rnd.choice(ids)) if rnd.random() < 0.15 else tuple(sorted(rnd.sample(ids, 2))) for _ in range(m)]
    edges += [("away", ids[0]), ("v01", "v01"), (None, "v02")]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "alone", None]], "artifact_id string")
    made = R.labels(nodes, spark.createDataFrame([(*e, "r") for e in edges], "source_id string, target_id string, relation string"))
    known = [*ids, "alone", "away"]
    want = walks(known, [e for e in edges if e[0]])
    starts = spark.createDataFrame([(i,) for i in [*known, "unknown"]], "artifact_id string")
    assert sorted(map(tuple, R.ancestors(starts, made).collect())) == sorted((o, a) for o in known for a in want[o])
    pairs = spark.createDataFrame([(a, b) for a in [*known, "unknown"] for b in known], "a string, b string")
    assert {(r.a, r.b): r.reaches for r in R.reaches(pairs, made).collect()} == {(a, b): a in want[b] for a in [*known, "unknown"] for b in known}
    pins = rnd.sample(ids, 3)
    assert sorted(r[0] for r in R.closure(spark.createDataFrame([(i,) for i in pins], "artifact_id string"), made).collect()) == sorted(set().union(*(want[i] for i in pins)))
    assert made.of.count() == len(known)


def test_no_edges(spark):
    made = R.labels(spark.createDataFrame([("a",)], "artifact_id string"), spark.createDataFrame([], "source_id string, target_id string"))
    assert [tuple(r) for r in R.ancestors(spark.createDataFrame([("a",)], "artifact_id string"), made).collect()] == [("a", "a")]


@pytest.mark.parametrize("few", [0, 1_000])
def test_blocks_of_all_sizes(spark, monkeypatch, few):
    """A fan of 700 below a chain: intervals of several sizes; large blocks and asked ids sent to all tasks, or not."""
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "LARGE", 4)
    edges = [("r", "m"), ("m", "k"), ("k", "m"), ("x", "f5")] + [("k", f"f{i}") for i in range(700)] + [("f9", f"g{i}") for i in range(40)]
    ids = sorted({i for e in edges for i in e})
    made = R.labels(spark.createDataFrame([(i,) for i in ids], "artifact_id string"), spark.createDataFrame(edges, "source_id string, target_id string"))
    want = walks(ids, edges)
    starts = spark.createDataFrame([(i,) for i in ids], "artifact_id string")
    assert sorted(map(tuple, R.ancestors(starts, made).collect())) == sorted((o, a) for o in ids for a in want[o])
    pairs = spark.createDataFrame([(a, b) for a in ("r", "x", "f9", "no") for b in ids], "a string, b string")
    assert {(r.a, r.b): r.reaches for r in R.reaches(pairs, made).collect()} == {(a, b): a in want[b] for a in ("r", "x", "f9", "no") for b in ids}
    for pin in ("f5", "g7", "r"):
        assert {r.artifact_id for r in R.closure(spark.createDataFrame([(pin,)], "artifact_id string"), made).collect()} == want[pin]
    assert R._blocks(made).groupBy("comp", "size").count().agg({"count": "max"}).first()[0] > 2

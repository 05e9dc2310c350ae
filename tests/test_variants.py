"""Leaves by VARIANT are those of a plain walk; no Python in the plan."""

import json
import random

from lodestone.sources import variants as V


def walk(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for n, v in enumerate(value):
            yield from walk(v, f"{path}[{n}]")
    elif value is not None:
        yield path, "true" if value is True else "false" if value is False else str(value)


def made(rnd, depth):
    kind = rnd.choice(["dict", "list", "leaf", "leaf"]) if depth else "leaf"
    if kind == "dict":
        return {rnd.choice(["a", "b", "é x", "c.d"]): made(rnd, depth - 1) for _ in range(rnd.randrange(0, 4))}
    if kind == "list":
        return [made(rnd, depth - 1) for _ in range(rnd.randrange(0, 4))]
    return rnd.choice([None, 1, -7, True, False, "text", ""])


def test_same_leaves_as_a_walk(spark):
    rnd = random.Random(6)
    docs = [(i, made(rnd, 5)) for i in range(80)]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in docs] + [(900, None), (901, "{broken"), (902, ""), (903, "[]"), (904, '"lone"')]
    got = V.leaves(spark.createDataFrame(rows, "path long, value string"), "value", ["path"]).toDF("id", "path", "value")
    want = [(i, *leaf) for i, d in docs for leaf in walk(d)] + [(904, "", "lone")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert V.leaves(spark.createDataFrame([], "id long, doc string"), "doc", ["id"]).count() == 0


def test_path_counts(spark):
    rows = [(1, '{"a": [1, 2], "b": {"c": 3}}'), (2, '{"a": [5]}')]
    got = V.path_counts(V.leaves(spark.createDataFrame(rows, "id long, doc string"), "doc", ["id"])).collect()
    assert {r.path: r.n for r in got} == {"a[]": 3, "b.c": 1}

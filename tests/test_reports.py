"""Canonical rule reports: against Python's own sorted JSON on random documents, and what goes, what is cut, what is sorted."""

import json
import random

from lodestone.sources import reports


def _of(spark, docs):
    own = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    return {r.id: r.canonical for r in reports.canonical(own, "doc", ["id"]).collect()}


def test_same_as_sorted_json(spark):
    rnd = random.Random(4)

    def value(depth):
        kind = rnd.randrange(9 if depth else 7)
        if kind < 7:
            return [rnd.randrange(-(10**12), 10**12), rnd.choice([0.5, 1.0, 1e-5, 0.0001, 12345678.25, 1e15, 1e16, 2.5e-9, 1e22, 0.001, 1.7e308]), None, True, "".join(rnd.choice('aZ é\n\t"\\😀\x01\x7f~') for _ in range(6)), "", 10**25][kind]
        if kind == 7:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(["a", "b", "B", "é", "n\n", "z_", ""]): value(depth - 1) for _ in range(rnd.randrange(4))}

    docs = [value(4) for _ in range(150)]
    got = _of(spark, [json.dumps(d, ensure_ascii=i % 2 == 0, indent=i % 3) for i, d in enumerate(docs)])
    assert [got[i] for i in range(len(docs))] == [json.dumps(d, sort_keys=True, separators=(",", ":")) for d in docs]


def test_what_goes_and_what_is_cut(spark):
    docs = [
        '{"date": "x", "DATE": [1], "Generated_At": {"a": 1}, "updated": 1}',
        '{"file": "/tmp/a.b", "in_path": "c\\\\d", "file_x": "e/f\\\\g", "other": "h/i", "root": "/j/k", "list": ["/l/m"], "path": 3, "path_of": ["n/o"]}',
        '{"violations": [{"b": 1, "time": 5}, {"a": 2}], "unconnected_items": [3, 20, 1], "kept": [3, 20, 1], "schematic_parity": {"x": [2, 1]}, "y": {"violations": [[2, 1], [1]]}}',
        None,
        "{broken",
        '{"a": 1, "a": 2}',
        '"/top/level"',
        "{}",
    ]
    assert _of(spark, docs) == {
        0: '{"updated":1}',
        1: '{"file":"a.b","file_x":"f\\\\g","in_path":"d","list":["/l/m"],"other":"h/i","path":3,"path_of":["n/o"],"root":"k"}',
        2: '{"kept":[3,20,1],"schematic_parity":{"x":[2,1]},"unconnected_items":[1,20,3],"violations":[{"a":2},{"b":1}],"y":{"violations":[[1,2],[1]]}}',
        3: None,
        4: None,
        5: None,
        6: '"/top/level"',
        7: "{}",
    }


def test_no_python_and_rows_stay_apart(spark):
    own = spark.createDataFrame([(1, '{"b": [1]}'), (1, '{"b": [1]}'), (None, "[2]")], "id int, doc string")
    got = reports.canonical(own, "doc", ["id"])
    assert sorted((r.id or 0, r.canonical) for r in got.collect()) == [(0, "[2]"), (1, '{"b":[1]}'), (1, '{"b":[1]}')]
    assert "Python" not in got._jdf.queryExecution().toString()
    assert reports.canonical(own.limit(0), "doc", ["id"]).count() == 0


def test_no_side_goes_through_the_driver(spark, tmp_path, monkeypatch):
    """Documents of a small file fill several tasks, and no join is a broadcast, however small the file's size lets sides seem."""
    monkeypatch.setattr(reports, "DEAL", 50)
    spark.range(200).selectExpr("id", """'{"a": [1, {"b": ' || id || '}]}' AS doc""").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = reports.canonical(spark.read.parquet(str(tmp_path / "d")), "doc", ["id"])
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    assert {r.id: r.canonical for r in got.collect()} == {i: f'{{"a":[1,{{"b":{i}}}]}}' for i in range(200)}

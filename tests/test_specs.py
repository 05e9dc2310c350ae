"""Specification documents: faults at whatever depth, and documents as rows."""

import pytest

from lodestone.sources import specs

KNOWN = {"name": "string", "trace": {"w": "int", "via": {"d": "int"}}, "layers": [{"t": "int", "tags": ["string"]}]}
GOOD = '{"layers": [{"t": 1, "tags": ["x"]}, {"tags": [], "t": 2}], "name": "a", "trace": {"via": {"d": 3}, "w": 4}}'
CASES = [
    (GOOD, []),
    ('{"name": "a", "trace": {"w": 4, "via": {"d": 3}}, "layers": []}', []),
    ('{"name": null, "trace": null, "layers": null}', []),
    ('{"name": "a", "trace": {"w": 4, "via": {"e": 3}}, "layers": [], "more": {"x": 1}}', ["missing trace.via.d", "unknown more", "unknown trace.via.e"]),
    ('{"name": "a", "trace": {"w": 4, "via": 7}, "layers": [{"t": 1, "tags": []}, {"t": 1, "z": 1}]}', ["missing layers[1].tags", "no object trace.via", "unknown layers[1].z"]),
    ('{"name": "a", "trace": [], "layers": {}}', ["no list layers", "no object trace"]),
    ("[1]", ["no object "]),
    ("{}", ["missing layers", "missing name", "missing trace"]),
    ("{broken", ["no document"]),
    ("", ["no document"]),
    (None, ["no document"]),
]


def test_faults_at_any_depth(spark):
    own = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(CASES)], "id int, doc string, extra string")
    got = {r.id: r for r in specs.read(own, "doc", KNOWN, strict=False).collect()}
    assert {i: got[i].faults for i in got} == {i: f for i, (_, f) in enumerate(CASES)}
    first = got[0].spec
    assert (first.name, first.trace.w, first.trace.via.d, [(x.t, x.tags) for x in first.layers]) == ("a", 4, 3, [(1, ["x"]), (2, [])])
    assert all((got[i].spec is None) == bool(f) for i, (_, f) in enumerate(CASES)) and got[3].extra == "kept"
    assert specs.read(own.limit(0), "doc", KNOWN).count() == 0


def test_strict_reading_names_the_faults(spark):
    own = spark.createDataFrame([(GOOD,)], "doc string")
    assert specs.read(own, "doc", KNOWN).first().spec.name == "a"
    with pytest.raises(Exception, match="unknown more"):
        specs.read(spark.createDataFrame([(GOOD,), (CASES[3][0],)], "doc string"), "doc", KNOWN).collect()

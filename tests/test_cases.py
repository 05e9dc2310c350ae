"""Trees of files against a plain fold; one changed file changes only the hashes above it."""

import hashlib
import math
import random

import pytest

from lodestone.operators import cases as C


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folded(entries, fan):
    digits = max(0, math.ceil(math.log(len(entries) / fan, 16)))
    rows = [(sha(n), n, h) for n, h in entries]
    for d in range(digits, 0, -1):
        groups = {}
        for k, n, h in rows:
            groups.setdefault(k[:d], []).append(f"{n}:{h}")
        rows = [(k, k, sha("\n".join(sorted(g)))) for k, g in groups.items()]
    return sha("\n".join(sorted(f"{n}:{h}" for _, n, h in rows)))


def plain(files, fan):
    """All nodes of one case: {path: hash}."""
    tree, out = {}, dict(files)
    for path, h in files.items():
        at = tree
        *folders, name = path.split("/")
        for part in folders:
            at = at.setdefault(part, {})
        at[name] = h

    def walk(node, path):
        entries = [(n, walk(v, f"{path}/{n}" if path else n) if isinstance(v, dict) else v) for n, v in node.items()]
        out[path] = folded(entries, fan)
        return out[path]

    walk(tree, "")
    return out


def frame(spark, cases):
    return spark.createDataFrame([(c, p, h) for c, files in cases.items() for p, h in files.items()], "case_id string, path string, digest string")


def hashes(got):
    return {(r.case_id, r.path): r.hash for r in got.collect()}


@pytest.fixture
def cases():
    rnd = random.Random(11)
    deep = {f"{'/'.join(rnd.choice('xyz') + 'd' for _ in range(rnd.randrange(0, 5)))}/f{i}".lstrip("/"): sha(str(i)) for i in range(60)}
    return {"A": deep, "B": {f"big/é{i}": sha(f"b{i}") for i in range(150)} | {"oracle_case.json": sha("c")}, "C": {"one": sha("")}}


@pytest.mark.parametrize("fan", [256, 3])
def test_tree_is_a_plain_fold(spark, cases, fan, monkeypatch):
    monkeypatch.setattr(C, "FAN", fan)
    own = frame(spark, cases)
    got = hashes(C.tree_hashes(own.union(own)))
    assert got == {(c, p): h for c, files in cases.items() for p, h in plain(files, fan).items()}


def test_one_change_goes_upwards_only(spark, cases):
    before = C.tree_hashes(frame(spark, cases))
    path = max(cases["A"], key=lambda p: p.count("/"))
    other = {c: dict(f) for c, f in cases.items()}
    other["A"][path] = sha("new")
    above = {path} | {path.rsplit("/", n)[0] for n in range(1, path.count("/") + 1)} | {""}
    got = C.changed(before, C.tree_hashes(frame(spark, other))).collect()
    assert {(r.case_id, r.path, r.change) for r in got} == {("A", p, "changed") for p in above}
    del other["A"][path]
    got = C.changed(before, C.tree_hashes(frame(spark, other))).collect()
    assert ("A", path, "removed") in {(r.case_id, r.path, r.change) for r in got} and {r.case_id for r in got} == {"A"}


def test_conflicts_nulls_and_empty(spark):
    schema = "case_id string, path string, digest string"
    for rows in ([("a", "x", "1"), ("a", "x", "2")], [("a", "x", "1"), ("a", "x/y", "2")]):
        with pytest.raises(ValueError):
            C.tree_hashes(spark.createDataFrame(rows, schema))
    assert C.tree_hashes(spark.createDataFrame([], schema)).count() == 0
    assert C.tree_hashes(spark.createDataFrame([("a", None, "1"), (None, "x", "2")], schema)).count() == 0


def test_fingerprints(spark, cases):
    nodes = C.tree_hashes(frame(spark, cases))
    schema = "case_id string, config string, toolchain string"
    of = lambda config, tool="t1", n=nodes: {r.case_id: r.fingerprint for r in C.fingerprints(n, spark.createDataFrame([("A", config, tool), ("none", None, None)], schema)).collect()}
    base = of('{"a": {"x": 1, "y": [1, 2]}, "b": "t"}')
    assert of('{"b": "t", "a": {"y": [1, 2], "x": 1}}') == base and len(base) == 2
    assert of('{"b": "t", "a": {"y": [2, 1], "x": 1}}')["A"] != base["A"]
    assert of('{"a": {"x": 1, "y": [1, 2]}, "b": "t"}', "t2")["A"] != base["A"]
    more = C.tree_hashes(frame(spark, cases | {"A": cases["A"] | {"new": sha("n")}}))
    assert of('{"a": {"x": 1, "y": [1, 2]}, "b": "t"}', n=more)["A"] != base["A"]


def test_layout(spark):
    rows = [("CAL_1", "oracle_case.json"), ("CAL_1", "fab/gerbers/a-F_Cu.gtl"), ("CAL_2", "fab/gerbers/bad name.txt"), ("CAL_3", "oracle_case.json"), ("CAL_4", "oracle_case.json"), ("CAL_4", "fab/gerbers/x.gtl"), ("CAL_4", ".env"), ("low", "oracle_case.json"), ("low", "fab/gerbers/x")]
    own = spark.createDataFrame([(c, p, "d") for c, p in rows], "case_id string, path string, digest string")
    got = {r.case_id: r for r in C.layout(own).collect()}
    assert {c for c, r in got.items() if r.valid} == {"CAL_1"}
    assert got["CAL_2"].missing == ["oracle_case.json"] and got["CAL_2"].n_bad_names == 1 and got["CAL_3"].empty_folders == ["fab/gerbers"]
    assert {r.case_id for r in C.layout(own, strict=False).collect() if r.valid} == {"CAL_1", "CAL_4"}


def test_large_folders_are_as_in_sql(spark, tmp_path):
    """A folder of more than 65,536 orders, which would take a third digit of buckets."""
    import duckdb

    from lodestone.plans import catalog

    duck = duckdb.connect()
    for name, sql in {
        "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range(2) t(i)",
        "customer": "SELECT i AS c_custkey, i::INT AS c_nationkey FROM range(2) t(i)",
        "orders": "SELECT i AS o_orderkey, (i % 1000 = 0)::BIGINT AS o_custkey FROM range(66500) t(i)",
        "lineitem": "SELECT i AS l_orderkey, 1::INT AS l_linenumber, i % 7 AS l_partkey, i % 5 AS l_suppkey, 'A' AS l_returnflag FROM range(66500) t(i)",
    }.items():
        duck.execute(f"CREATE TABLE {name} AS {sql}")
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT PARQUET)")
    for name, ends in (("case_fingerprints", ""), ("case_tree_hashes", "kind = 'folder' AND path NOT LIKE '%/o%'")):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]}) WHERE {ends or 'true'}").fetchall()
        assert sorted(map(tuple, (got.where(ends) if ends else got).collect())) == sorted(want) and want


def test_folders_that_are_done(spark, cases, monkeypatch):
    """Folders of files only are folded apart, in one stage where files of a folder lie together; the tree is the same."""
    own = {c: {f"top/d{len(p) % 3}/{i}": h for i, (p, h) in enumerate(files.items())} for c, files in cases.items()}
    tops = {c: {"oracle_case.json": sha(c)} for c in own} | {"D": {"only": sha("d")}}
    lines = frame(spark, own)
    done = C.leaf_folders(lines.union(lines).union(spark.createDataFrame([("A", None, "1"), (None, "x/y", "2")], lines.schema)))
    got = hashes(C.tree_hashes(frame(spark, tops), done=done).select("case_id", "path", "hash"))
    want = {(c, p): h for c in tops for p, h in plain(own.get(c, {}) | tops[c], C.FAN).items()}
    assert got == {k: h for k, h in want.items() if k[1] not in own.get(k[0], {})}
    with pytest.raises(ValueError):
        C.leaf_folders(frame(spark, {"A": {"x/y": "1"}}).union(frame(spark, {"A": {"x/y": "2"}})))
    for path in ("top/d0", "top/d0/more"):
        with pytest.raises(ValueError):
            C.tree_hashes(frame(spark, {"B": {path: "1"}}), done=done)


def test_lines_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Files of an order are folded in the stage that joins them; what is shuffled for that is deleted."""
    from lodestone.plans import case_queries as Q

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []
        monkeypatch.setattr(C, "stored", lambda f, what: plans.append(f._jdf.queryExecution().executedPlan().toString()) or f)
        C.leaf_folders(Q._line_files(Q._lines(spark, "/root/testdata/sf0.001")), "l_orderkey")
        plans.append(Q.files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
        assert [p.count("Exchange hashpartitioning") for p in plans] == [4, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

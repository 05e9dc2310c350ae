"""Readers, writers and round trips on small files."""

import json

import numpy as np
import pytest

from lodestone.operators import networks as N
from lodestone.operators import rules as R
from lodestone.sources import documents as J
from lodestone.sources import snapshots as S
from lodestone.sources import touchstone as T


def test_touchstone_round_trip(spark, tmp_path):
    rows = [("n", k, k * 1e9, i, j, 0.1 * i - 0.03 * k, 0.2 * j) for k in (1, 2, 3) for i in (1, 2) for j in (1, 2)]
    long = spark.createDataFrame(rows, "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double")
    lines = [r.line for r in T.lines(long, 75.0).orderBy("line_no").collect()]
    assert lines[0] == "# HZ S RI R 75" and len(lines) == 4
    (tmp_path / "n.s2p").write_text("! note\n" + "\n".join(lines))
    got = {(r.f_idx, r.i, r.j): (r.freq_hz, round(r.re, 8), round(r.im, 8), r.z0) for r in T.read(spark, str(tmp_path / "*.s2p")).collect()}
    assert got == {(k, i, j): (f, round(re, 8), round(im, 8), 75.0) for _, k, f, i, j, re, im in rows}


def test_touchstone_forms():
    assert list(T.parse("#\n1 0.5 90", 1))[0][1:] == (1e9, 1, 1, pytest.approx(0), pytest.approx(0.5), 50.0)
    assert list(T.parse("# MHz DB S R 60 ! x\n2 -20 180\n3 0 0", 1))[0][1:] == (2e6, 1, 1, pytest.approx(-0.1), pytest.approx(0), 60.0)
    three = list(T.parse("# Hz RI\n1 " + " ".join(str(x) for x in range(18)), 3))
    assert [(i, j, re) for _, _, i, j, re, _, _ in three][:4] == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (2, 1, 6)]
    for bad in ("# Hz RI\n1 0 0\n1 0 0", "# Hz RI\n1 0"):
        with pytest.raises(ValueError):
            list(T.parse(bad, 1))


def test_manifests_registry_and_lineage(spark, tmp_path):
    def doc(i, created, inputs=()):
        return json.dumps({"artifact_id": i, "artifact_type": "t", "byte_size": 3, "created_utc": created, "content_hash": {"algorithm": "sha256", "digest": created}, "lineage": {"run_id": "r", "inputs": [{"artifact_id": x, "relation": "derived_from"} for x in inputs]}, "roles": ["a_b"], "tags": {"k": "v"}}, indent=1)

    for n, text in enumerate([doc("a", "2020"), doc("b", "2021", ["a", "gone"]), doc("a", "2022"), "{broken", "{}"]):
        (tmp_path / f"{n}.json").write_text(text)
    own = J.manifests(spark, str(tmp_path))
    assert sorted((r.artifact_id, r.digest, r.roles[0], r.tags["k"]) for r in J.registry(own).collect()) == [("a", "2022", "a_b", "v"), ("b", "2021", "a_b", "v")]
    nodes, edges = J.lineage(own)
    assert nodes.count() == 2 and sorted(r.source_id for r in edges.collect()) == ["a", "gone"]


def test_series_and_reports(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"time_ps": [0, 1, 2], "ports": {"P1": {"voltage_v": [1, 2, 3], "current_a": [4, 5, 6]}}}))
    assert [(r.k, r.t_s, r.v, r.i) for r in J.port_signals(spark, str(tmp_path / "p.json")).orderBy("k").collect()][2] == (2, 2e-12, 3.0, 6.0)
    (tmp_path / "e.json").write_text(json.dumps({"time_ps": [0, 1], "energy_db": [0, -70]}))
    series = J.energy_series(spark, str(tmp_path / "e.json"))
    assert N.energy_decay(series).first().status == "PASSED"
    (tmp_path / "s.csv").write_text("freq_hz,s11_re,s11_im,s21_re,s21_im\n1e9,0.1,0.2,0.3,0.4\n2e9,0.5,0.6,0.7,0.8\n")
    long = J.sparameter_csv(spark, str(tmp_path / "s.csv"), "n")
    assert sorted((r.f_idx, r.i, r.j, r.re) for r in long.collect()) == [(1, 1, 1, 0.1), (1, 2, 1, 0.3), (2, 1, 1, 0.5), (2, 2, 1, 0.7)]
    assert J.sparameter_wide(long).columns == ["network_id", "freq_hz", "s11_re", "s11_im", "s21_re", "s21_im"]
    (tmp_path / "d.json").write_text(json.dumps({"violations": [{"type": "clearance", "severity": "error", "description": "x"}, {"type": "y", "severity": "warning", "description": ""}]}))
    from lodestone.operators.verification import drc_tier

    assert [(r.errors, r.warnings, r.status) for r in drc_tier(J.drc_report(spark, str(tmp_path / "d.json"))).collect()] == [(1, 1, "FAILED")]
    (tmp_path / "j.xml").write_text("<testsuite><testcase name='a' classname='m'/><testcase name='b' classname='m'><failure>no</failure></testcase></testsuite>")
    assert sorted((r.name, r.status) for r in J.junit(spark, str(tmp_path / "j.xml")).collect()) == [("a", "passed"), ("b", "failed")]


def test_candidates(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("[0.1, 0.2]\n\n[0.3, 0.4]\n")
    assert [list(r.u) for r in J.candidate_vectors(spark, str(tmp_path / "c.jsonl")).orderBy("cand_id").collect()] == [[0.1, 0.2], [0.3, 0.4]]
    np.save(tmp_path / "c.npy", np.arange(6.0).reshape(2, 3))
    assert [list(r.u) for r in J.candidate_arrays(spark, str(tmp_path / "c.npy")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_snapshot_round_trip(spark, tmp_path):
    rows = [("a", "t", "r", "d1", 5, "p", {"x": 1.0}), ("b", "t", "r", "d2", 7, "q", {"y": 2.0})]
    members = spark.createDataFrame(rows, "artifact_id string, artifact_type string, role string, digest string, byte_size bigint, storage_path string, features map<string,double>")
    path = str(tmp_path / "snap")
    S.write_snapshot(members, path, "set", "v1")
    got = {r.artifact_id: (r.feature_x, r.feature_y) for r in S.read_index(spark, path).collect()}
    assert got == {"a": (1.0, None), "b": (None, 2.0)} and S.verify_snapshot(spark, path).first().intact
    assert [r.artifact_id for r in S.read_slice(spark, f"{path}/index", ["artifact_id"], [("byte_size", ">", 5), ("role", "in", ["r"])]).collect()] == ["b"]
    assert sum(r.n_rows for r in S.row_groups(spark, f"{path}/index").collect()) == 2
    assert [json.loads(r.line)["artifact_id"] for r in S.export_graph(members, spark.createDataFrame([], "source_id string, target_id string, relation string")).collect()] == ["a", "b"]


def test_filter_sink_and_specs(spark, tmp_path):
    cands = spark.createDataFrame([(1, [0.5] * 19), (2, [0.0] * 19), (3, [1.0] * 19)], "cand_id long, u array<double>")
    S.write_filtered(R.batch_filter(cands), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f/meta")).first().n == 3
    assert S.load_spec(spark, '{"w": 3, "name": "x"}', {"w": int, "name": str}).first().w == 3
    with pytest.raises(ValueError):
        S.load_spec(spark, '{"w": 3, "more": 1}', {"w": int})


def test_objects(spark, tmp_path):
    import hashlib

    data = b"content"
    digest = hashlib.sha256(data).hexdigest()
    folder = tmp_path / "objects" / digest[:2]
    folder.mkdir(parents=True)
    (folder / digest).write_bytes(data)
    row = S.read_object(spark, str(tmp_path), digest).first()
    assert bytes(row.content) == data and row.intact


def test_choice_of_sources(spark, tmp_path):
    from lodestone.sources.choice import choose

    with pytest.raises(FileNotFoundError):
        choose(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("x")
    assert choose(spark, str(tmp_path))[0] == "csv"
    (tmp_path / "a.s2p").write_text("x")
    assert choose(spark, str(tmp_path))[0] == "touchstone"


def test_network_files_with_impedances(spark, tmp_path):
    rows = [(n, k, k * 1e9, 1, 1, 0.1 * k, -0.2) for n in ("a", "b") for k in (1, 2)]
    long = spark.createDataFrame(rows, "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double")
    told = spark.createDataFrame([("a", 1, 60.0), ("b", 1, 75.5)], "network_id string, port int, z0 double")
    folder = f"file://{tmp_path}/out"
    assert sorted((r.file, r.points) for r in T.write(long, folder, 50.0, told).collect()) == [("a.s1p", 2), ("b.s1p", 2)]
    assert (tmp_path / "out/b.s1p").read_text().splitlines()[:2] == ["! Port[1] = 75.5", "# HZ S RI R 50"]
    got = {(r.network_id, r.f_idx): (r.freq_hz, round(r.re, 9), r.im) for r in T.read(spark, f"{folder}/*.s1p").collect()}
    assert got == {(n, k): (f, round(re, 9), im) for n, k, f, _, _, re, im in rows}


def test_row_groups_are_read_by_number(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": list(range(10)), "b": ["x"] * 10}), tmp_path / "t.parquet", row_group_size=4)
    groups = S.row_groups(spark, str(tmp_path))
    assert sorted((r.row_group, r.n_rows, r.columns) for r in groups.collect()) == [(0, 4, 2), (1, 4, 2), (2, 2, 2)]
    assert sorted(r.a for r in S.read_row_groups(groups.where("row_group <> 1"), ["a"], str(tmp_path)).collect()) == [0, 1, 2, 3, 8, 9]


def test_nested_specs_are_strict(spark):
    known = {"name": str, "trace": {"w": int}, "layers": [{"t": float}]}
    row = S.load_spec(spark, '{"name": "n", "trace": {"w": 4}, "layers": [{"t": 1}, {"t": 2}]}', known).first()
    assert row.trace.w == 4 and [x.t for x in row.layers] == [1.0, 2.0]
    for text, path in (('{"name": "n", "trace": {"w": 4, "v": 1}, "layers": []}', "trace.v"), ('{"name": "n", "trace": {"w": 4}, "layers": [{}]}', r"layers\[0\].t"), ('{"name": "n", "trace": 5, "layers": []}', "trace")):
        with pytest.raises(ValueError, match=path):
            S.load_spec(spark, text, known)
    pytest.importorskip("yaml")
    assert S.load_spec(spark, "name: n\ntrace:\n  w: 4\nlayers:\n- t: 1\n", known).first().trace.w == 4


def test_snapshots_that_change_are_not_intact(spark, tmp_path):
    rows = [(str(i), "t", "r", f"d{i}", 5, "p", {"x": 1.0}) for i in range(6)]
    schema = "artifact_id string, artifact_type string, role string, digest string, byte_size bigint, storage_path string, features map<string,double>"
    path = str(tmp_path / "snap")
    S.write_snapshot(spark.createDataFrame(rows, schema), path, "set", "v1")
    changed = S.wide_features(spark.createDataFrame([*rows[:5], ("5", "t", "r", "d0", 5, "p", {"x": 1.0})], schema))
    changed.write.mode("overwrite").parquet(f"{path}/index")
    assert not S.verify_snapshot(spark, path).first().intact

"""Properties that SQL twins don't show: filters, graphs, retention, networks, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import integrity as I
from lodestone.operators import lineage as G
from lodestone.operators import networks as N
from lodestone.operators import retention as RT
from lodestone.operators import rules as R
from lodestone.operators import signals as S
from lodestone.operators import verification as V
from lodestone.streaming import events as E


def numpy_filter(u, limits, rounds=3):
    """The batch filter in numpy, over a whole batch."""
    names = [n for n, _, _ in R.SPACE]
    place = {n: i for i, n in enumerate(names)}
    scope = {"least": np.minimum, "greatest": np.maximum}

    def physical(x):
        return {n: a + x[:, i] * (b - a) for i, (n, a, b) in enumerate(R.SPACE)}

    def margins(p, tier):
        return {r: np.broadcast_to(eval(m.format(**limits), {"__builtins__": {}}, scope | p), len(u)) for t, r, m, _, _ in R.RULES if t == tier}

    own, p = u.copy(), physical(u)
    m = {t: margins(p, t) for t in ("T0", "T1", "T2")}
    for _ in range(rounds):
        for tier in ("T0", "T1", "T2"):
            for t, r, _, name, target in R.RULES:
                if t == tier and name:
                    bad = m[tier][r] < 0
                    lo, hi = next((a, b) for n, a, b in R.SPACE if n == name)
                    want = (np.broadcast_to(eval(target.format(**limits), {"__builtins__": {}}, scope | p), len(u)) - lo) / (hi - lo) if target else np.zeros(len(u))
                    own[bad, place[name]] = np.maximum(own[bad, place[name]], want[bad]) if target else 0
            p = physical(own)
            if tier != "T2":
                m[tier] = margins(p, tier)
    last = {t: margins(p, t) for t in ("T0", "T1", "T2")}
    return np.all([(v > 0) if r == R.STRICT else (v >= 0) for t in last.values() for r, v in t.items()], axis=0), own


def test_batch_filter_is_the_vectorised_one(spark):
    u = np.random.default_rng(0).random((400, 19))
    limits = dict(R.LIMITS, min_trace_width=200_000, min_annular_ring=130_000, min_via_to_via=500_000)
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(u)], "cand_id long, u array<double>")
    got = R.batch_filter(frame, limits).orderBy("cand_id").collect()
    mask, repaired = numpy_filter(u, limits)
    assert [r.feasible for r in got] == mask.tolist() and np.allclose([r.u_repaired for r in got], repaired, atol=0)
    done = spark.createDataFrame([(r.cand_id, r.u_repaired) for r in got if r.feasible], "cand_id long, u array<double>")
    again = R.batch_filter(done, limits).collect()
    assert all(r.feasible and r.distance == 0 and r.repairs == 0 for r in again)
    assert R.batch_filter(frame.limit(0), limits).count() == 0


def test_ancestors_are_descendants_of_reversed_edges(spark):
    rnd = np.random.default_rng(1)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "x") for a, b in rnd.integers(0, 30, (45, 2)).tolist()], "source_id string, target_id string, relation string")
    nodes = spark.createDataFrame([(f"n{i}", "t") for i in range(28)], "artifact_id string, artifact_type string")
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation")
    starts = nodes.limit(5).select("artifact_id")
    a = {tuple(r) for r in G.ancestors(nodes, edges, starts).collect()}
    assert a == {tuple(r) for r in G.descendants(nodes, back, starts).collect()} and len(a) >= 5


def test_cycles_have_no_level(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "b", "x"), ("c", "d", "x"), ("a", "e", "x")], "source_id string, target_id string, relation string")
    nodes = spark.createDataFrame([(x, "t") for x in "abcde"], "artifact_id string, artifact_type string")
    assert sorted((r.artifact_id, r.level) for r in G.topological_levels(nodes, edges).collect()) == [("a", 0), ("e", 1)]


def test_components_of_a_path_and_lone_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60)], "a long, b long")
    got = {r.id: r.component for r in G.components(edges, spark.createDataFrame([(99,), (3,)], "id long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 99: 99}


def test_budget_is_the_oldest_first_loop(spark):
    rnd = np.random.default_rng(2)
    rows = [(f"a{i}", "t", [], int(rnd.integers(1, 100)), f"2020-01-{1 + int(rnd.integers(0, 28)):02d}T00:00:00Z", ["age", "pinned", "min_count", "delete"][int(rnd.integers(0, 4))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "artifact_id string, artifact_type string, roles array<string>, byte_size bigint, created_utc string, reason string")
    budget = 3000
    left = sum(r[3] for r in rows if r[5] != "delete")
    gone = {r[0] for r in rows if r[5] == "delete"}
    for r in sorted((r for r in rows if r[5] in ("age", "min_count")), key=lambda r: (r[4], r[0])):
        if left > budget:
            left -= r[3]
            gone.add(r[0])
    got = RT.with_budget(frame, RT.Policy(budget_bytes=budget))
    assert {r.artifact_id for r in got.where("delete").collect()} == gone


def network(spark, s):
    rows = [("n", k + 1, (k + 1) * 1e9, i + 1, j + 1, float(m[i, j].real), float(m[i, j].imag)) for k, m in enumerate(s) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double")


def test_lossless_networks_are_passive_and_eigenvalues_agree(spark):
    rnd = np.random.default_rng(3)
    unitary = [np.linalg.qr(rnd.normal(size=(2, 2)) + 1j * rnd.normal(size=(2, 2)))[0] for _ in range(20)]
    own = network(spark, unitary)
    assert N.passivity(own, 1e-10).first().status == "PASS"
    closed = {r.f_idx: r.eig for r in N.largest_eigenvalue(N.two_port(own)).collect()}
    assert all(abs(r.eig - closed[r.f_idx]) < 1e-12 for r in S.eigenvalues(own).collect())


def test_interpolation_on_its_own_grid_is_the_identity_and_ends_clamp(spark):
    own = network(spark, [np.array([[k + 1j, 2], [3, 4j * k]]) for k in range(4)])
    same = N.interpolate(own, own.select("network_id", "freq_hz"))
    assert {(r.freq_hz, r.i, r.j, r.re, r.im) for r in same.collect()} == {(r.freq_hz, r.i, r.j, r.re, r.im) for r in own.collect()}
    ends = N.interpolate(own, spark.createDataFrame([("n", 1.0), ("n", 1e12)], "network_id string, freq_hz double")).where("i = 1 and j = 1").orderBy("freq_hz").collect()
    assert [(r.re, r.im) for r in ends] == [(0, 1), (3, 1)]


def test_renormalising_there_and_back(spark):
    rnd = np.random.default_rng(4)
    own = network(spark, [0.3 * (rnd.normal(size=(3, 3)) + 1j * rnd.normal(size=(3, 3))) for _ in range(5)])
    back = S.renormalise(S.renormalise(own, 50, 75), 75, 50)
    a, b = (sorted((r.f_idx, r.i, r.j, round(r.re, 9), round(r.im, 9)) for r in f.collect()) for f in (own, back))
    assert a == b


def test_mixed_mode_pairs(spark):
    own = network(spark, [np.arange(16).reshape(4, 4) * (1 + 0j)])
    got = {(r.mode, r.i, r.j): r.re for r in N.mixed_mode(own).collect()}
    m = np.arange(16).reshape(4, 4)
    assert got["dd", 1, 1] == (m[0, 0] - m[0, 2] - m[2, 0] + m[2, 2]) / 2 and got["cc", 1, 2] == (m[0, 1] + m[0, 3] + m[2, 1] + m[2, 3]) / 2
    with pytest.raises(ValueError):
        N.mixed_mode(own, ((1, 2), (2, 4)))


def test_checks(spark):
    ports = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 1), ("y", "a", 3)], "key string, port_id string, port_index int")
    assert sorted(map(tuple, V.ports(ports, "key").collect())) == [("x", 0, 0, True), ("y", 1, 0, False)]
    base = spark.createDataFrame([("c1", "z0", 50.0), ("c2", "z0", 50.0)], "case_id string, metric string, value double")
    now = spark.createDataFrame([("c1", "z0", 50.5), ("c3", "z0", 50.0)], "case_id string, metric string, value double")
    assert sorted((r.case_id, r.blocking) for r in V.regression(base, now, {"z0": 1.0}).collect()) == [("c1", False), ("c2", True), ("c3", True)]
    boards = spark.createDataFrame([("b", ["F.Cu", "X"])], "key string, present array<string>")
    assert tuple(V.layers(boards, "key", F.array(F.lit("F.Cu"), F.lit("B.Cu")), F.col("present")).first()) == ("b", ["B.Cu"], ["X"], False)
    assert V.resource_excess(spark.createDataFrame([("j", 5, 1)], "key string, ram int, gpu int"), {"ram": 4, "gpu": 2}, "key").count() == 1


def test_positions_without_one_task(spark):
    own = spark.range(1000).withColumn("p", F.xxhash64("id")).repartition(7)
    got = I.numbered(own, [F.col("p")]).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.p for r in got] == sorted(r.p for r in got)


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = E.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    plain = {(r.window_start, r.event_type, r.n) for r in E.tumbling(events).collect()}
    assert {(r.window_start, r.event_type, r.n) for r in spark.table("windows").collect()} == plain
    query = E.first_of_each(stream, ["event_type"]).writeStream.outputMode("append").format("memory").queryName("firsts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("firsts").count() == events.select("event_type").distinct().count()


def test_enforcing_and_missing_roles(spark):
    from lodestone.operators import proofs as P

    frame = spark.createDataFrame([(1, 5), (2, 20)], "k long, v long")
    long = P.evaluate(frame, "k", [P.at_least("MIN", "T0", F.col("v"), F.lit(10))])
    with pytest.raises(Exception, match="constraint MIN failed for 1"):
        P.enforce(long, "k").collect()
    assert P.enforce(long.where("k = 2"), "k").count() == 1
    reached = spark.createDataFrame([("o", ["a"]), ("o", ["b"]), ("p", None)], "origin string, roles array<string>")
    assert sorted((r.origin, r.missing) for r in P.missing_roles(reached, ["a", "c"]).collect()) == [("o", ["c"]), ("p", ["a", "c"])]


def test_windows_are_numpys(spark):
    n = 33
    frame = spark.range(n).withColumn("n", F.lit(n))
    for kind, want in (("hann", np.hanning(n)), ("hamming", np.hamming(n)), ("blackman", np.blackman(n)), ("kaiser", np.kaiser(n, 14.0))):
        got = [r.w for r in frame.select("id", S.window(kind, F.col("id").cast("double"), F.col("n")).alias("w")).orderBy("id").collect()]
        assert np.allclose(got, want, atol=1e-12)


def test_tukey_ends_and_normalised_windows(spark):
    from pyspark.sql import Window

    n, ends = 33, 8
    want = np.ones(n)
    for t in range(ends):
        want[t] = 0.5 * (1 - np.cos(np.pi * t / ends))
        want[n - 1 - t] = 0.5 * (1 - np.cos(np.pi * (t + 1) / ends))
    frame = spark.range(n).select("id", F.lit("s").alias("s"), F.col("id").cast("double").alias("k"), F.lit(n).alias("n"))
    got = frame.select("id", S.window("tukey", F.col("k"), F.col("n")).alias("w"), S.normalised_window("tukey", F.col("k"), F.col("n"), Window.partitionBy("s")).alias("v")).orderBy("id").collect()
    assert np.allclose([r.w for r in got], want) and np.allclose([r.v for r in got], want / want.mean())
    m = S.window_metrics(frame, "s", "none").first()
    assert (m.coherent_gain, m.noise_bandwidth) == (1.0, 1.0) and abs(m.processing_gain_db - 10 * np.log10(n)) < 1e-9


def test_mappings_there_and_back(spark):
    from lodestone.functions import mappings as P

    u = spark.createDataFrame([(x / 8,) for x in range(9)], "u double")
    for kind, options in (("linear", {"low": -3, "high": 9}), ("log", {"low": 0.1, "high": 1e4})):
        back = u.select("u", P.to_number(P.to_value(F.col("u"), kind, **options), kind, **options).alias("b"))
        assert all(abs(r.u - r.b) < 1e-12 for r in back.collect())
    some = (3.0, 5.0, 11.0)
    got = u.select("u", P.to_value(F.col("u"), "discrete", values=some).alias("v")).select("u", "v", P.to_number(F.col("v"), "discrete", values=some).alias("b")).orderBy("u").collect()
    assert [r.v for r in got] == [3, 3, 3, 5, 5, 5, 11, 11, 11] and [round(r.b * 6) for r in got] == [1, 1, 1, 3, 3, 3, 5, 5, 5]
    with pytest.raises(ValueError):
        P.to_value(F.col("u"), "cubic")


def test_upserts_and_status(spark):
    from lodestone.operators import catalogue as C

    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, status string, v long")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1), (3, "e", 1)], "k long, status string, v long")
    assert sorted(map(tuple, C.upsert(base, new, ["k"], "v").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, C.upsert(base, new, ["k"], "v", keep_old=True).collect())) == [(1, "a", 1), (2, "b", 1), (3, "e", 1)]
    assert C.upsert(base.limit(0), new.limit(0), ["k"], "v").count() == 0
    assert sorted(map(tuple, C.set_status(base, spark.createDataFrame([(2, "x")], "k long, status string"), "k").collect())) == [(1, "a", 1), (2, "x", 1)]


def test_document_repair_order_and_log(spark):
    limits = {"min_trace_width": 100, "min_gap": 100, "min_board_width": 5000, "min_drill": 200, "min_via_diameter": 300, "min_annular_ring": 100, "min_edge_clearance": 200, "min_via_to_via": 200}
    doc = {"trace_width": 50, "trace_gap": 150, "board_width": 6000, "board_length": 20000, "corner_radius": -5, "signal_drill": 400, "signal_via": 350, "signal_pad": 360, "return_drill": 200, "return_via": 300, "ring_radius": 500, "fence_drill": None, "fence_via": None, "fence_pitch": None, "fence_offset": None, "length_left": 9000, "length_right": 1, "left_x": 100, "right_x": 19900}
    row = doc | limits
    own = R.document_repair(spark.createDataFrame([(1, *row.values())], "k long, " + ", ".join(f"{c} long" for c in row))).first()
    assert [(a.constraint_id, a.before, a.after) for a in own.actions] == [
        ("T0_TRACE_WIDTH_MIN", 50, 100), ("T0_CORNER_RADIUS_MIN", -5, 0), ("T1_SIGNAL_VIA_DIAMETER_GT_DRILL", 350, 500), ("T1_SIGNAL_ANNULAR_MIN", 360, 700), ("T1_RETURN_ANNULAR_MIN", 300, 400),
        ("T2_LEFT_CONNECTOR_X_MIN", 100, 200), ("T2_RIGHT_CONNECTOR_X_MAX", 19900, 19800), ("T2_RETURN_VIA_RING_RADIUS", 500, 750), ("F1_CONTINUITY_LENGTH_RIGHT", 1, 10600),
    ]
    assert own.fence_pitch is None and own.signal_pad == 700


def test_absorbing_layers_and_ports(spark):
    rows = [(1, 4e9, 8, 8, None, None, 8, 8), (2, 1e10, 8, 16, None, None, None, None), (3, 3e10, 32, 32, 8, None, None, None), (4, 3e10, 32, None, 32, 32, 32, 32), (5, 3e10, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "k long, f_max_hz double, x_min int, x_max int, y_min int, y_max int, z_min int, z_max int")
    assert sorted((r.k, r.status) for r in V.absorbing_layers(frame, "k").collect()) == [(1, "PASSED"), (2, "WARNING"), (3, "FAILED"), (4, "WARNING"), (5, "WARNING")]
    ports = spark.createDataFrame([("p", 90.0001, 500, 300, 150, 100, 50), ("q", 45.0, 660, 300, 180, 40, 50), ("r", 360.0, 660, None, None, 50, 50)], "id string, rotation_deg double, width long, signal_width long, gap long, length long, mesh_cell long")
    assert sorted(map(tuple, V.port_shapes(ports, ["id"]).collect())) == [("p", True, True, True), ("q", False, False, False), ("r", True, False, True)]
    boxes = spark.createDataFrame([("d", "a", 0, 0, 0, 100, 10, 10), ("d", "b", 50, 0, 0, 100, 10, 10), ("d", "c", 150, 0, 0, 100, 10, 10), ("e", "a", 0, 0, 0, 100, 10, 10)], "d string, p string, x long, y long, z long, length long, width long, height long")
    assert [tuple(r) for r in V.port_overlaps(boxes, "d", "p", 100).collect()] == [("d", "a", "b")]


def test_manifests_have_a_bound(spark):
    from lodestone.operators import catalogue as C

    frame = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "d"), (2, "e")], "g int, digest string")
    import hashlib

    assert C.manifest_hash(frame.where("g = 1"), ["g"], most=2).first().manifest_hash == hashlib.sha256(b"a\nb").hexdigest()
    with pytest.raises(Exception, match="a manifest of 3 members"):
        C.manifest_hash(frame, ["g"], most=2).collect()


def test_levels_with_cycles_loops_and_lone_nodes(spark):
    from lodestone.operators import lineage as G

    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "artifact_id string")
    edges = [("a", "b", "r"), ("a", "b", "s"), ("b", "c", "r"), ("a", "c", "r"), ("d", "e", "r"), ("e", "d", "r"), ("e", "f", "r"), ("g", "g", "r"), ("zz", "b", "r")]
    got = {r.artifact_id: r.level for r in G.topological_levels(nodes, spark.createDataFrame(edges, "source_id string, target_id string, relation string")).collect()}
    assert got == {"a": 0, "h": 0, "b": 1, "c": 2}


def test_byte_forms(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import scalars as X

    sizes = [0, 1023, 1024, 1280, 1536 * 1024, 5 * 1024**3 + 7 * 1024**2, 3 * 1024**4, 1024**5, 2000 * 1024**5]
    frame = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    rows = frame.select("n", X.format_bytes_listing(F.col("n")).alias("a"), X.format_bytes_report(F.col("n")).alias("b")).collect()

    def listing(n):
        return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" if n < 1024**3 else f"{n / 1024**3:.2f} GB"

    def report(n):
        for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
            if n < 1024 or unit == "PB":
                return f"{n}.0 {unit}"
            n //= 1024

    assert [(r.a, r.b) for r in rows] == [(listing(n), report(n)) for n in sizes]


def test_shapes_of_one_centre_give_no_pairs(spark):
    """300 shapes at each of four centres: links grow with the shapes, and tie what all pairs tie."""
    from lodestone.operators import connectivity as K
    from lodestone.operators import lineage as G

    points = spark.range(1200).select("id", (F.col("id") % 2).alias("net"), F.when(F.col("id") % 4 < 2, 0).otherwise(100).alias("x"), F.lit(0).alias("y"), (F.col("id") % 40 + 11).alias("r"))
    assert K.links(points, 50).count() <= 1200 < K.touching(points, 50).count()
    want = {(r.id, r.component) for r in G.components(K.touching(points, 50), points).collect()}
    assert {(r.id, r.component) for r in G.components(K.links(points, 50), points).collect()} == want

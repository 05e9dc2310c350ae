"""Verdicts on networks of known behaviour, strict and not."""

import math

import pytest

from lodestone.operators import validation as V

SCHEMA = "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double"


def network(name, cells, points=40):
    return [(name, k + 1, 1e8 * (k + 1), i, j, *map(float, cells(k, i, j))) for k in range(points) for i in (1, 2) for j in (1, 2)]


def through(k, i, j):
    """A short delay with a little loss."""
    phase = -2 * math.pi * 1e8 * (k + 1) * 2e-10
    return (0.0, 0.0) if i == j else (0.9 * math.cos(phase), 0.9 * math.sin(phase))


def rows(spark):
    good = network("good", through)
    active = network("active", lambda k, i, j: (1.2, 0) if (k, i, j) == (7, 2, 1) else through(k, i, j))
    one_way = network("one_way", lambda k, i, j: (0.4, 0.0) if (i, j) == (1, 2) and k >= 30 else through(k, i, j))
    single = [("single", k + 1, 1e8 * (k + 1), 1, 1, 0.5, 0.0) for k in range(5)]
    return spark.createDataFrame(good + active + one_way + single, SCHEMA).repartition(5)


def test_checks_find_what_is_wrong_and_where(spark):
    limits = V.LIMITS | {"causality": V.Limit(1e-3, 1e-2, enabled=False)}
    got = {(r.network_id, r.check): r for r in V.checks(rows(spark), limits).collect()}
    assert {k: r.status for k, r in got.items() if k[0] == "good"} == {("good", "passivity"): "PASS", ("good", "reciprocity"): "PASS", ("good", "power_balance"): "PASS", ("good", "causality"): "SKIP"}
    r = got["active", "passivity"]
    assert (r.status, r.worst_freq_hz, r.n_violations) == ("FAIL", 8e8, 1)
    assert abs(r.value - 1.2) < 1e-9
    assert got["active", "power_balance"].status == "FAIL"
    assert (got["one_way", "reciprocity"].status, got["one_way", "reciprocity"].n_violations, got["one_way", "passivity"].status) == ("FAIL", 10, "PASS")
    assert got["single", "reciprocity"].status == "SKIP"
    verdict = {r.network_id: (r.status, r.failing) for r in V.verdicts(V.checks(rows(spark), limits)).collect()}
    assert verdict["good"] == ("PASS", "")
    assert verdict["active"] == ("FAIL", "passivity,power_balance,reciprocity")
    assert verdict["one_way"] == ("FAIL", "reciprocity")


def test_strict_raises_limits_and_switches(spark):
    bad = rows(spark).where("network_id = 'active'")
    with pytest.raises(Exception, match="network active fails"):
        V.checks(bad, strict=True).collect()
    off = {n: V.Limit(1, 1, enabled=False) for n in V.LIMITS}
    assert [r.status for r in V.verdicts(V.checks(bad, off, strict=True)).collect()] == ["SKIP"]
    wide = off | {"passivity": V.Limit(1.1, 2.0)}
    assert [r.status for r in V.verdicts(V.checks(bad, wide, strict=True)).collect()] == ["WARN"]
    assert V.verdicts(V.checks(bad.limit(0))).count() == 0


def test_worst_pair_and_symmetry(spark):
    r = V.worst_pairs(rows(spark).where("network_id = 'one_way'")).first()
    error = lambda k: math.hypot(0.4 - through(k, 1, 2)[0], through(k, 1, 2)[1])
    worst = max(range(30, 40), key=error)
    assert (r.i, r.j, r.freq_hz) == (1, 2, 1e8 * (worst + 1))
    assert abs(r.max_error_db - 20 * math.log10(error(worst))) < 1e-9
    got = {r.network_id: (r.symmetry_error, r.n_active) for r in V.symmetry(rows(spark).where("network_id <> 'single'")).collect()}
    assert got == {"good": (0.0, 0), "active": (0.0, 1), "one_way": (0.0, 0)}


def test_documents_fill_tasks_by_their_number(spark, monkeypatch):
    from lodestone.operators import rules
    from lodestone.plans import rule_queries

    monkeypatch.setattr(rules, "DEAL", 20)
    own = rule_queries.specs(spark, "/root/testdata/sf0.001")
    assert rules.document_results(own, "p_partkey").rdd.getNumPartitions() == -(-own.count() // 20) > 4

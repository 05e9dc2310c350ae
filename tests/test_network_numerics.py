"""Operators without SQL twins against plain sums: causality, extraction, renormalising, hashes, graded lines."""

import cmath
import hashlib
import json
import math
import random

import numpy as np
import pytest

from lodestone.operators import designs as D
from lodestone.operators import meshes as M
from lodestone.operators import signals as S

LONG = "network_id string, f_idx int, freq_hz double, i int, j int, re double, im double"


def test_causality_is_that_of_a_plain_transform(spark):
    rnd = random.Random(1)
    rows = [(n, k, k * 1e9, 2, 1, *((math.cos(0.3 * k), -math.sin(0.3 * k)) if n == "late" else (rnd.uniform(-1, 1), rnd.uniform(-1, 1)))) for n in ("late", "any") for k in range(1, 6)]
    got = {r.network_id: (r.ratio, r.status) for r in S.causality(spark.createDataFrame(rows, LONG)).collect()}
    for name in ("late", "any"):
        f = [r[2] for r in rows if r[0] == name]
        s = [complex(*r[5:]) for r in rows if r[0] == name]
        n = 512
        half = []
        for k in range(n // 2 + 1):
            at = k * 2 * f[-1] / (n // 2)
            m = min(max(sum(x <= at for x in f), 1), len(f) - 1)
            share = min(max((at - f[m - 1]) / (f[m] - f[m - 1]), 0), 1)
            half.append(s[m - 1] + share * (s[m] - s[m - 1]))
        half[0], half[-1] = half[0].real, half[-1].real
        response = [(half[0] + half[-1] * (-1) ** t + 2 * sum((half[k] * cmath.exp(2j * math.pi * k * t / n)).real for k in range(1, n // 2))) / n for t in range(n)]
        ratio = sum(x * x for x in response[n // 2 :]) / sum(x * x for x in response)
        assert got[name][0] == pytest.approx(ratio) and got[name][1] == ("PASS" if ratio <= 1e-3 else "WARN" if ratio <= 1e-2 else "FAIL")


def test_extraction_is_that_of_plain_sums(spark):
    rnd, n, step, z0 = random.Random(2), 16, 1e-10, 50.0
    rows = [("a", 1, p, k, k * step, rnd.uniform(-1, 1), rnd.uniform(-0.02, 0.02)) for p in (1, 2) for k in range(n)]
    grid = [0.0, 1 / (n * step), 1.5 / (n * step), 3 / (n * step)]
    got = {(r.i, r.f_idx): complex(r.re, r.im) for r in S.extract(spark.createDataFrame(rows, "network_id string, excite int, port int, k int, t_s double, v double, i double"), z0, grid).collect()}

    def wave(port, sign, m):
        return sum((v + sign * z0 * i) / (2 * math.sqrt(z0)) * cmath.exp(-2j * math.pi * m * k / n) for _, _, p, k, _, v, i in rows if p == port)

    for port in (1, 2):
        s = [wave(port, -1, m) / wave(1, 1, m) for m in range(4)]
        want = [s[0], s[1], (s[1] + s[2]) / 2, s[3]]
        for k, value in enumerate(want):
            assert got[port, k + 1] == pytest.approx(value)


def test_renormalising_goes_by_way_of_impedances(spark):
    rnd = np.random.default_rng(3)
    s = 0.3 * (rnd.normal(size=(3, 3)) + 1j * rnd.normal(size=(3, 3)))
    rows = [("a", 1, 1e9, i + 1, j + 1, float(s[i, j].real), float(s[i, j].imag)) for i in range(3) for j in range(3)]
    one = np.eye(3)
    z = 50 * (one + s) @ np.linalg.inv(one - s)
    want = (z - 75 * one) @ np.linalg.inv(z + 75 * one)
    for r in S.renormalise(spark.createDataFrame(rows, LONG), 50, 75).collect():
        assert complex(r.re, r.im) == pytest.approx(want[r.i - 1, r.j - 1])


def test_hashes_are_of_the_canonical_document(spark):
    rows = [(n, k, k * 1e9, i, j, round(0.1 * i + 1e-14 * k, 15), -0.25 * j) for n in ("a", "b") for k in (1, 2) for i in (1, 2) for j in (1, 2)]
    cell = lambda i, j: [round(0.1 * i, 12), -0.25 * j]
    document = {"frequencies_hz": [1e9, 2e9], "n_ports": 2, "reference_impedance_ohm": 50.0, "s_parameters": [[[cell(1, 1), cell(1, 2)], [cell(2, 1), cell(2, 2)]]] * 2}
    want = hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    frame = spark.createDataFrame(rows, LONG).repartition(5)
    assert {(r.network_id, r.network_hash) for r in D.network_hashes(frame).collect()} == {("a", want), ("b", want)}


def test_graded_lines_grow_by_the_ratio(spark):
    fixed = [0, 40_000, 41_000, 900_000]
    (row,) = M.graded_lines(spark.createDataFrame([("x", fixed)], "axis string, fixed array<bigint>"), 1_000, 1.5, 60_000).collect()
    lines, cells = list(row.lines), np.diff(row.lines)
    assert set(fixed) <= set(lines) and lines == sorted(set(lines)) and cells.min() >= 500 and cells.max() <= 90_000
    for a, b in zip(fixed, fixed[1:], strict=False):
        own = np.diff([x for x in lines if a <= x <= b])
        if len(own) > 4:
            assert own[0] == own[-1] == 1_000
            growth = own[1 : len(own) // 2] / own[: len(own) // 2 - 1]
            assert (growth <= 1.51).all() and (growth[:-1] >= 0.99).all() and growth[-1] >= 0.74  # what is left in the middle is divided evenly
            assert np.abs(own - own[::-1]).max() <= 1

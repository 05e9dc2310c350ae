"""Operator 13 against all pairs, and its registers and estimates against sets of known similarity."""

import numpy as np
import pytest

from lodestone.llm import set_join
from lodestone.llm import set_sketches as S
from tests.llm.test_set_join import SCHEMA, brute, corpus


@pytest.mark.parametrize(("seed", "chunk", "spread"), [(1, 1000, 16), (2, 5, -1)])
def test_same_as_all_pairs(spark, monkeypatch, seed, chunk, spread):
    monkeypatch.setattr(set_join, "CHUNK_SETS", chunk)
    monkeypatch.setattr(set_join, "LIST_SETS", 2 * chunk)
    monkeypatch.setattr(set_join, "SPREAD", spread)
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, "en", 1, b"r") for d, t in rows], SCHEMA + ", n int, registers binary").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(frame).collect()}
    assert got == brute(rows, 4, 80)


def test_null_keys_repeated_rows_and_no_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", "x"), (4, "A b c d e", "x"), (4, "A b c d e", "x"), (None, "z z z z z", "x"), (None, None, "x"), (9, "a b c d e", "x"), (11, "", "x")]
    got = sorted((tuple(r) for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (None, 0, None, True), (9, 2, 4, False), (11, 0, 11, True)], key=str)


@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.8, 0.95])
def test_registers_merge_and_estimate(similarity):
    rnd = np.random.default_rng(3)
    n, pairs = 400, 60
    both = round(2 * n * similarity / (1 + similarity))
    estimates, agree = [], []
    for _ in range(pairs):
        pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64)
        a, b = pool[:n], np.concatenate((pool[:both], pool[n : 2 * n - both]))
        x, y = S.sketch(a, np.array([len(a)])), S.sketch(b, np.array([len(b)]))
        union = np.unique(np.concatenate((a, b)))
        assert (S.merged(x, y) == S.sketch(union, np.array([len(union)]))).all()
        estimates.append(S.likeliest(x, y, np.array([len(a)]), np.array([len(b)]))[0])
        agree.append((x == y).mean())
    assert abs(np.mean(estimates) - similarity) < 0.02
    assert abs(np.mean(agree) - similarity) < 0.02
    assert np.max(np.abs(np.array(estimates) - similarity)) < 0.2


def test_every_pair_at_the_threshold_is_a_candidate():
    """400 pairs of similarity 0.8: each shares a band, and none is estimated below the bound."""
    rnd = np.random.default_rng(4)
    for _ in range(400):
        pool = rnd.integers(0, 1 << 63, 200, dtype=np.int64).astype(np.uint64)
        a, b = pool[:180], pool[20:]
        x, y = S.sketch(a, np.array([180])), S.sketch(b, np.array([180]))
        assert (x == y).reshape(S.BANDS, S.ROWS).all(axis=1).any()
        assert S.likeliest(x, y, np.array([180]), np.array([180]))[0] >= S.least_estimate(80)


@pytest.mark.parametrize(("sought", "most"), [(1 << 18, 1 << 21), (50, 200)])
def test_overlaps_of_blocks(monkeypatch, sought, most):
    monkeypatch.setattr(set_join, "SOUGHT", sought)
    monkeypatch.setattr(set_join, "OVERLAPS", most)
    rnd = np.random.default_rng(6)
    some = lambda n: [np.unique(np.minimum(rnd.integers(0, 300, 40), rnd.integers(5, 300, 40))).astype(np.uint64) for _ in range(n)]
    for n in (3, 40):
        sets, others = some(n), some(25)
        got = np.concatenate([rows for _, rows in set_join.overlaps(sets, others)])
        assert (got == [[len(np.intersect1d(a, b)) for a in sets] for b in others]).all()


def test_what_many_sets_share_makes_no_lists(spark):
    """200 sets of 60 members, 20 of them in all, and two pairs that share 55: in lists by size of hash all would meet."""
    rnd = np.random.default_rng(7)
    hashes = lambda n: rnd.integers(1 << 40, 1 << 62, n, dtype=np.int64)
    sets = [np.concatenate((np.arange(20), hashes(40))) for _ in range(200)]
    sets += [np.concatenate((s[:55], hashes(5))) for s in sets[:2]]
    rows = [(0, i, 60, np.sort(s).astype("<u8").tobytes(), i) for i, s in enumerate(sets)]
    known = spark.createDataFrame(rows, "family long, id long, n int, data binary, component long")
    got = set_join._rarest(known, 80).collect()
    assert {r.id for r in got} == {0, 1, 200, 201} and max(sum(r.token == t for r in got) for t in {r.token for r in got}) == 2
    links = {tuple(sorted(r)) for r in set_join._by_lists(known, 80, ordered=False).collect()}
    assert links == {(0, 200), (1, 201)}

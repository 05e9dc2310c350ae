"""Operator 5 against all pairs."""

import random
import re

import pytest

from lodestone.llm import exchange, set_join

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "The"]
    rows, bases = [], [[rnd.choice(vocab) for _ in range(rnd.choice([40, 90, 200]))] for _ in range(8)]
    line = [rnd.choice(vocab) for _ in range(30)]
    for d in range(n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.7 else [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.randrange(0, 5)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            w += line
        rows.append((d * 13 % 997, rnd.choice([" ", "\n"]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows + [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  b"), (5004, "a"), (5005, "a"), (5006, rows[0][1])]


@pytest.mark.parametrize(("width", "percent", "part_bytes", "chunk", "spread"), [(3, 90, 1 << 20, 1000, 4), (5, 80, 3000, 1000, 4), (3, 90, 4000, 5, 4), (3, 90, 4000, 5, 1000), (3, 90, 4000, 5, -1), (5, 80, 4000, 4, -1)])
def test_same_as_all_pairs(spark, monkeypatch, width, percent, part_bytes, chunk, spread):
    """Also with families split into chunks, whose rest meets in chunks (a large spread) or in prefix lists (none)."""
    monkeypatch.setattr(set_join, "CHUNK_SETS", chunk)
    monkeypatch.setattr(set_join, "ACROSS_SETS", 2 * chunk)
    monkeypatch.setattr(set_join, "LIST_SETS", 2 * chunk)
    monkeypatch.setattr(set_join, "SPREAD", spread)
    rows = corpus(width + part_bytes)
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.join(frame, width=width, percent=percent, part_bytes=part_bytes, group_words=200).collect()}
    assert got == brute(rows, width, percent)


def test_two_steps_and_a_key_of_many_rows(spark, monkeypatch):
    """More parts and groups than the fan; one key with a third of all rows; a columns' names that clash."""
    monkeypatch.setattr(exchange, "FAN", 4)
    rows = corpus(11, 60)
    many = [(8000, f"{rows[3][1]} z{i % 3}") for i in range(30)]
    frame = spark.createDataFrame([(d, t, "en", 1, "k") for d, t in rows + many], "doc_id long, text string, salt string, n int, key string").repartition(3)
    got = {}
    for r in set_join.join(frame, part_bytes=1500, group_words=100).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    want = brute(rows + [(9000 + i, t) for i, t in enumerate(sorted({t for _, t in many}))], 3, 90)
    assert {d: c for d, c in got.items() if d < 8000} == {d: {c if c < 8000 else 8000} for d, (_, c) in want.items() if d < 8000}


def test_empty_table_and_null_keys(spark):
    assert set_join.join(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(None, "a b c d", "x"), (4, "a b c d", "x"), (4, "a b c d", "x"), (None, "z z z z", "x"), (None, None, "x")], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in set_join.join(frame).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 1, None), (None, 0, None)], key=str)

"""Operator 2 against a plain search through all windows."""

import hashlib
import random
import re

import numpy as np

from lodestone.llm import exchange, repeats

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, width):
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    seen, out = set(), {}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - width + 1):
            own = tuple(w[i : i + width])
            if own in seen:
                gone.update(range(i, i + width))
            seen.add(own)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "é", "naïve", "x y", "日本"] + [f"w{i}" for i in range(40)]
    lines = [" ".join(rnd.choices(vocab, k=30)) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [" ".join(rnd.choices(vocab, weights=[20, 10] + [1] * (len(vocab) - 2), k=rnd.randrange(0, 60)))]
        if rnd.random() < 0.6:
            parts.insert(rnd.randrange(2), rnd.choice(lines))
        if rnd.random() < 0.2:
            parts += parts
        rows.append((d * 7 % 1000, rnd.choice(["\n", "  ", "\t"]).join(parts)))
    rows += [(2000 + i, rows[5][1]) for i in range(4)] + [(3000, None), (3001, ""), (3002, " \n "), (3003, "the " * 500)]
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(1)
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    for width, part_bytes in ((20, 1 << 20), (5, 700), (20, 1500)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove(frame, width=width, part_bytes=part_bytes, group_words=50).collect()}
        assert got == brute(rows, width)


def digests(frame, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove(frame, **options).collect()}


def test_parts_keep_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(exchange, "RANGES", 3)
    frame = spark.createDataFrame([(k, "x" * 10) for k in [5, 900, 17, 17, -4, 30, 31, 32, 33, 1 << 40]] + [(None, "y")], "doc_id long, text string")
    parts = exchange.ranged_parts(frame, "doc_id", "text", 60)
    rows = parts.frame.collect()
    order = [r.part for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]
    assert not parts.mixed and order == sorted(order) and len(set(order)) > 2
    rows = corpus(4)
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)
    assert digests(frame, part_bytes=700) == brute(rows, 20)


def test_outgrown_ranges_are_split(spark, monkeypatch):
    """Clustered keys, null keys and one key with many rows: no part gets them all, and the result is the same."""
    monkeypatch.setattr(exchange, "RANGES", 4)
    rows = [(1 << 40, "far away " * 3)] + [(1000 + d, t) for d, t in corpus(5, 40)]
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    parts = exchange.ranged_parts(frame, "doc_id", "text", 500)
    sizes = [r["count"] for r in parts.frame.groupBy("part").count().collect()]
    assert parts.mixed and parts.n > 8 and len(sizes) > 8 and max(sizes) < 12
    assert digests(frame, part_bytes=500) == brute(rows, 20)
    text = " ".join(f"a{i}" for i in range(25))
    frame = spark.createDataFrame([(k, text, "x") for k in [None] * 60 + [7] * 60 + [8]], SCHEMA)
    got = [(r.doc_id, r.n_removed) for r in repeats.remove(frame, part_bytes=300).collect()]
    assert sorted(got, key=str) == sorted([(None, 25)] * 59 + [(None, 0)] + [(7, 25)] * 60 + [(8, 25)], key=str)


def test_two_steps_give_the_same(spark, monkeypatch):
    """Parts and groups beyond the fan meet by way of buckets and blocks, also with a passage in every part."""
    monkeypatch.setattr(exchange, "FAN", 4)
    rows = corpus(6, 40)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(d, f"{t} {passage} {d}" if t else t) for d, t in rows]
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    assert digests(frame, part_bytes=900, group_words=50) == brute(rows, 20)
    monkeypatch.setattr(exchange, "RANGES", 4)
    assert digests(frame, part_bytes=900, group_words=50) == brute(rows, 20)


def test_lists_stay_long_with_ten_times_the_parts(spark, monkeypatch):
    """Bytes of a record, rows' own 40 bytes included, hardly grow with the number of parts and groups."""
    monkeypatch.setattr(exchange, "FAN", 8)
    cost = []
    for docs in (30, 300):
        rows = [(d, " ".join(f"w{d * 100 + i}" for i in range(60))) for d in range(docs)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        parts = exchange.ranged_parts(frame, "doc_id", "text", 800)
        groups = max(16, parts.size // 600)
        key, width = "doc_id", 20

        def send(_, table, got, groups=groups):
            own = repeats.Suffixes(exchange.Part(table, key, "text"), width)
            order, group = own.leaves(groups)
            return group, exchange.fingerprints(own.path[order])

        sent = exchange.sent_lists(parts, exchange.no_replies(frame), send, groups).collect()
        cost.append(sum(40 + len(r.list) for r in sent) / (41 * docs))
    assert cost[1] < 1.5 * cost[0]


def test_spans_cover_what_goes(spark):
    rows = corpus(2, 20)
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)
    gone = {}
    for r in repeats.spans(frame, part_bytes=2000).collect():
        gone[r.doc_id] = gone.get(r.doc_id, 0) + r.end_word - r.first_word
    assert gone == {d: n for d, (_, n, _) in brute(rows, 20).items() if n}


def maximal(rows, width, depth):
    """(key, first word, end) of all occurrences of maximal repeats of width to depth words; of depth alone, those that can't go on to the left."""
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    found = set()
    for n in range(width, depth + 1):
        places = {}
        for d, w in words.items():
            for i in range(len(w) - n + 1):
                places.setdefault(tuple(w[i : i + n]), []).append((d, i))
        for at in places.values():
            left = {words[d][i - 1] if i else (d, "start") for d, i in at}
            right = {words[d][i + n] if i + n < len(words[d]) else (d, "end") for d, i in at}
            if len(at) > 1 and len(left) > 1 and (len(right) > 1 or n == depth):
                found |= {(d, i, n) for d, i in at}
    return found


def test_maximal_repeats_are_those_of_all_pairs(spark, monkeypatch):
    rows = corpus(7, 30)
    rows = [(d, t) for d, t in rows if d != 3003] + [(4000, "the of " * 8)]
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    for width, depth, fan in ((5, 12, 1 << 14), (5, 20, 4)):
        monkeypatch.setattr(exchange, "FAN", fan)
        got = {(r.doc_id, r.first_word, r.end_word - r.first_word) for r in repeats.repeats(frame, width=width, depth=depth, part_bytes=900, group_words=50).collect()}
        want = maximal(rows, width, depth)
        assert {x for x in got if x[2] < depth} == {x for x in want if x[2] < depth}
        assert {x[:2] for x in got if x[2] >= depth} == {x[:2] for x in want if x[2] == depth}


def test_subtrees_are_those_of_a_plain_trie():
    rnd = np.random.default_rng(3)
    words = rnd.integers(1, 4, 300).astype(np.uint8)
    edges = np.stack([words[i : i + 9] for i in range(290)])
    check = np.array([hash(tuple(e[:4])) for e in edges.tolist()]).view(np.uint64)
    tree = repeats.Subtree(edges, check, 1, 4)
    own = edges[tree.order].tolist()
    assert own == sorted(edges.tolist()) or [e[:4] for e in own] == sorted(e[:4] for e in edges.tolist())
    for i in range(1, len(own)):
        same = next((k for k in range(9) if own[i][k] != own[i - 1][k]), 9)
        assert tree.common[i] == same
    want = {(d, tuple(e[:d])) for d in range(4, 10) for e in own if len({tuple(x[: d + 1]) for x in own if x[:d] == e[:d]}) > (d < 9) and sum(x[:d] == e[:d] for x in own) > 1}
    assert {(d, tuple(own[a][:d])) for d, lo, hi in tree.nodes() for a in lo.tolist()} == want


def test_empty_table_null_keys_and_ties(spark):
    assert repeats.remove(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeats.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"a{i}" for i in range(25))
    frame = spark.createDataFrame([(None, text, "x"), (1, text, "x"), (1, text, "y")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove(frame).collect()) == [(0, 0), (1, 25), (1, 25)]


def test_columns_of_any_name_and_a_long_text(spark):
    rnd = random.Random(9)
    long = " ".join(f"v{rnd.randrange(200)}" for _ in range(120_000))
    tail = " ".join(long.split()[-50:])
    frame = spark.createDataFrame([(1, long, 1, "a", 2), (2, tail, 3, "b", 4)], "doc_id long, text string, part long, key string, k long")
    got = digests(frame)
    assert got == brute([(1, long), (2, tail)], 20) and got[2][1] == 50

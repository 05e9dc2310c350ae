"""Benchmark items shorter than a window: all placements of the tokens that may differ, and random texts against SQL."""

import random
from itertools import combinations

import duckdb
import pytest

from lodestone.llm import decontaminate

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def _by_sql(docs, items):
    own = duckdb.connect()
    own.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    own.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    own.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    own.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return sorted(own.execute(decontaminate.oracle_sql()).fetchall())


def test_all_placements_of_what_may_differ(spark):
    items, docs, want = [], [], set()
    for n in range(1, 13):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        most = n * 20 // 100
        for k in (most, most + 1):
            for gone in combinations(range(n), k):
                doc = len(docs)
                docs.append((doc, " ".join(["before", *["other" if i in gone else x for i, x in enumerate(item)], "after"])))
                if k == most:
                    want.add((doc, n))
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.window_tokens == r.item_id and r.n_matches == r.item_id - r.item_id * 20 // 100 and r.first_token == 1 for r in got)


@pytest.mark.parametrize("block, rows", [(4096, 200_000), (3, 200_000), (7, 0)])
def test_same_as_sql_on_few_words(spark, monkeypatch, block, rows):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rnd = random.Random(block)
    text = lambda n, words: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(rnd.randrange(40), text(rnd.randrange(0, 40), "abcd")) for _ in range(60)] + [(None, "a b c"), (50, None), (51, ""), (52, "zz " * 500), (52, "a")]
    items = [(rnd.randrange(30), text(n, "abcd")) for n in range(1, 16) for _ in range(3)] + [(None, "a b"), (90, None), (91, " . "), (92, "zz"), (93, "zz zz zz zz zz qq")]
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect())) == _by_sql(docs, items)


def test_other_shares(spark):
    docs, items = [(1, "a b c d e"), (2, "a b x d e"), (3, "x b y d z")], [(1, "a b c d e"), (2, "c")]
    found = lambda percent: sorted(map(tuple, decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), percent=percent).select("doc_id", "item_id", "n_matches").collect()))
    assert found(100) == [(1, 1, 5), (1, 2, 1)]
    assert found(40) == [(1, 1, 5), (1, 2, 1), (2, 1, 4), (3, 1, 2)]

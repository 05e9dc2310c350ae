"""Operator 7 against a plain search through all windows."""

import re

import pytest

from lodestone.llm import exchange, sparse_suffixes
from tests.llm.test_repeats import SCHEMA, corpus


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


@pytest.mark.parametrize("fan", [1 << 14, 4])
def test_same_windows_as_brute_force(spark, monkeypatch, fan):
    """Also in two steps, where there are more parts and groups than the fan."""
    monkeypatch.setattr(exchange, "FAN", fan)
    rows = corpus(3)
    words = {d: split(t) for d, t in rows}
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    for width, seed, part_bytes in ((20, 5, 1 << 20), (12, 4, 1000)):
        seen, want = set(), set()
        for d in sorted(words):
            for i in range(len(words[d]) - width + 1):
                own = tuple(words[d][i : i + width])
                if own in seen:
                    want.add((d, i))
                seen.add(own)
        got = set()
        for r in sparse_suffixes.passages(frame, width=width, seed=seed, part_bytes=part_bytes, group_words=50).collect():
            n = r.end_word - r.first_word
            assert n >= width and (r.source_doc_id, r.source_first_word) < (r.doc_id, r.first_word)
            assert words[r.doc_id][r.first_word : r.end_word] == words[r.source_doc_id][r.source_first_word : r.source_first_word + n]
            own = {(r.doc_id, i) for i in range(r.first_word, r.end_word - width + 1)}
            assert not own & got
            got |= own
        assert got == want


def test_empty_table_null_keys_and_ties(spark):
    assert sparse_suffixes.passages(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"a{i}" for i in range(60))
    frame = spark.createDataFrame([(None, text, "x"), (1, text, "x"), (1, text, "y"), (2, None, "z"), (3, "", "z")], SCHEMA)
    assert {r.doc_id for r in sparse_suffixes.passages(frame).collect()} == {1}


def test_columns_of_any_name_and_split_ranges(spark, monkeypatch):
    monkeypatch.setattr(exchange, "RANGES", 3)
    text = " ".join(f"a{i}" for i in range(60))
    frame = spark.createDataFrame([(k, text, 1, "s") for k in [None, *range(5)] * 8], "doc_id int, text string, step int, source string")
    got = sparse_suffixes.passages(frame, part_bytes=400)
    assert got.columns == ["doc_id", "first_word", "end_word", "source_doc_id", "source_first_word"]
    rows = got.collect()
    assert {(r.doc_id, r.first_word, r.end_word, r.source_first_word) for r in rows} == {(k, 0, 60, 0) for k in [None, *range(5)]}

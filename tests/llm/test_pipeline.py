"""The pipeline, stage by stage, against plain versions on a small table."""

import hashlib
import re

import numpy as np

import corpus_pipeline as P
from lodestone.llm import private_data, quality
from lodestone.llm.sentencepiece_codec import codec
from tests.llm.test_set_join import brute

SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weights, bias = model.weights()

    def score(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        own = np.concatenate([b for _, b in quality.features(data, np.array([0, len(data)]))])
        return 1 / (1 + np.exp(-((weights[own].astype(float).mean() if len(own) else 0) + bias)))

    assert {r.doc_id for r in good.collect()} == {d for d, t in rows.items() if score(t) >= 0.3}
    single = stages["near_duplicates"](spark, docs, SF)
    groups = brute(list(rows.items()), 5, 80)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    clean = stages["decontamination"](spark, docs, SF)
    items = [re.findall("[a-z0-9]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spaced = lambda w: " " + " ".join(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", w.lower())) + " "
    whole = {d for d, t in rows.items() if any(" " + " ".join(i) + " " in spaced(t) for i in items if len(i) >= 8)}
    kept = {r.doc_id for r in clean.collect()}
    assert not whole & kept and len(kept) >= len(rows) - 2 * len(whole) - 3
    hidden = {r.doc_id: (r.text, r.n_chars) for r in stages["private_data"](spark, docs, SF).collect()}
    assert hidden == {d: (private_data.redact(t), len(private_data.redact(t))) for d, t in rows.items()}
    ids = codec(P.model_path())
    for r in stages["sentencepiece"](spark, docs, SF).collect():
        assert r.ids == ids.encode(rows[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_run_composes_the_stages(spark):
    got = {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_table_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(1, None, "en", None, None, 1.0, "a"), (2, "", None, "s", 0, None, "b"), (None, "The of and. Is it that.", "en", "s", 3, 2.0, "c"), (2, "", None, "s", 0, None, "b")], "doc_id long, text string, lang string, source string, n_chars long, score double, component string")
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
        got = stage(spark, odd, SF)
        n = got.count()
        assert n <= 4 and (name in ("quality", "sentencepiece") or n == 4)

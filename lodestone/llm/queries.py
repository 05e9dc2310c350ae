"""The numbered queries over the training-data tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import archives, conversations, decontaminate, flac, licences, periodic_runs, private_data, quality, repeats, sentencepiece_codec, set_join, set_sketches, sparse_suffixes
from lodestone.llm.store import read

Query = Callable[[SparkSession, str], DataFrame]


def model_path() -> str:
    """The public vocabulary file; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(read(spark, sf_dir, "documents"), model_path())


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(read(spark, sf_dir, "documents"))


def op5_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffixes.passages(read(spark, sf_dir, "documents"))


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(read(spark, sf_dir, "pages"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.scan(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(read(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(read(spark, sf_dir, "documents"))


def op13_set_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketches.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (op1_licences, op2_repeats, op3_sentencepiece, op4_flac, op5_set_join, op6_decontaminate, op7_sparse_suffixes, op8_archives, op9_private_data, op10_quality, op11_conversations, op12_periodic_runs, op13_set_sketches)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": licences.oracle_sql(), "op6_decontaminate": decontaminate.oracle_sql()}

"""From documents to token ids: five stages, each on everything that the stage before kept.

Quality (rejected documents go), near duplicates (one document of each group stays, the one with the smallest key),
benchmark leaks (documents with one go), personal data (replaced in place), SentencePiece ids. All stages but the last
return the columns of documents. Rows with a null key pass the second and third stage; null texts stay null until they
are encoded, as no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, private_data, quality, sentencepiece_codec, set_join
from lodestone.llm.queries import model_path
from lodestone.llm.store import cut, new_folder, read

#: Near duplicates share word shingles of five words to a Jaccard similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = set_join.join(docs, width=SHINGLE, percent=PERCENT)
    gone = cut(groups.where("component_id != doc_id").select("doc_id").distinct())
    return docs.join(decontaminate.small(gone), "doc_id", "left_anti").select(docs.columns)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark")).select(docs.columns)


def no_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private_data.redact_column(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(docs, model_path(), with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_leaks),
    ("private_data", no_private_data),
    ("sentencepiece", token_ids),
]

#: SQL can't express the first, second, fourth and fifth stage; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

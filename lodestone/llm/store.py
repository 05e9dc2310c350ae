"""Shared folder of the cluster, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset in local mode, as in tests, one of this machine's. On a cluster it must be set."""
    named = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if named:
        return named
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once into the shared folder and read from there: lost executors cost nothing that came before."""
    spark = frame.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of text that pass between Spark and Python at a time: ten thousand long ones fill a task's memory.

    Spark has no way to say this of one plan, so it is set for the session, unless that says otherwise; the registered
    queries and the pipeline do so when they read a table. Who calls operators on frames of their own should set it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Session settings of the engine, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lodestone", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive plans and UTC; partitions should be 2 to 3 times the cluster's cores, or more for spills."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset in local mode, one of this machine's. On a cluster it must be set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = context._jsc.sc().getCheckpointDir()
    if not named and not have.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not have.isDefined():
        context.setCheckpointDir(named)
    return named or have.get()


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Computes the frame into the shared folder and reads it from there."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, what: str) -> DataFrame:
    """As cut, for frames of very many rows: into compressed files, and what was shuffled for them is deleted at once."""
    spark = frame.sparkSession
    folder, key = new_folder(spark, what), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        frame.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(folder)


def dealt(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """The same rows in tasks of about that many, by the key's hash: a small file of rows that make much work would fill one task. The frame is counted first."""
    return frame.repartition(max(1, -(-frame.count() // rows)), key)

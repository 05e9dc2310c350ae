"""Which of several files of a simulation is read: network files first, then tables, then port series."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFERENCE = (("touchstone", "*.s[0-9]*p"), ("csv", "*.csv"), ("port_signals", "*ports*.json"))


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern matches in whatever store Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def choose(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(kind, pattern) of the first kind that the folder holds; FileNotFoundError if it holds none."""
    for kind, pattern in PREFERENCE:
        if exists(spark, f"{folder}/{pattern}"):
            return kind, f"{folder}/{pattern}"
    raise FileNotFoundError(folder)

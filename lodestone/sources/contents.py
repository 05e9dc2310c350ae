"""A store of contents by their digest: written once each, and all of a job or nothing.

`objects/<first two digits>/<task's folder>/<digest>` holds a content. Tasks write under `_staging/<job>`; when all have
succeeded, the driver renames each task's folders into place, one for each pair of a task and a prefix, not one for each
object: rows come in ranges of their digest, so there are at most as many as tasks and prefixes together. A job that fails
is cleared; what an attempt left that didn't count goes with the staging folder. Stores without renames of folders copy.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestone.sources import documents
from lodestone.sources.stores import opened_store

FORMAT = "lodestone_contents"


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    prefixes: list[str]
    objects: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex
        store, path = opened_store(self.root)
        store.create_dir(f"{path}/_staging/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> _Staged:
        """Rows (digest, content), in order of digest; a digest that isn't the content's ends the job."""
        store, root = opened_store(self.root)
        folder = uuid.uuid4().hex
        store.create_dir(f"{root}/_staging/{self.job}/{folder}", recursive=False)  # fails once the job has been cleared
        prefixes: list[str] = []
        last, objects = None, 0
        for batch in iterator:
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest == last:
                    continue
                data = content.as_buffer()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"content is not that of digest {digest}")
                if not prefixes or prefixes[-1] != digest[:2]:
                    prefixes.append(digest[:2])
                    store.create_dir(f"{root}/_staging/{self.job}/{folder}/{digest[:2]}", recursive=False)
                with store.open_output_stream(f"{root}/_staging/{self.job}/{folder}/{digest[:2]}/{digest}") as file:
                    file.write(data)
                last, objects = digest, objects + 1
        return _Staged(folder, prefixes, objects)

    def commit(self, messages: list[_Staged | None]) -> None:
        store, root = opened_store(self.root)
        for m in messages:
            for prefix in m.prefixes if m else ():
                store.create_dir(f"{root}/objects/{prefix}", recursive=True)
                store.move(f"{root}/_staging/{self.job}/{m.folder}/{prefix}", f"{root}/objects/{prefix}/{m.folder}")
        self._clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        _remove(self.root, f"_staging/{self.job}")


def _remove(root: str, name: str) -> None:
    """Removes a folder; again, where a task that outlives its job writes at the same time."""
    from pyarrow import fs

    store, path = opened_store(root)
    for left in range(20, -1, -1):
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            return
        try:
            store.delete_dir(f"{path}/{name}")
        except OSError:
            if not left:
                raise
            time.sleep(0.05)


def sweep(root: str) -> None:
    """Removes what jobs that died, driver and all, have left in the staging folder; for when no job writes."""
    _remove(root, "_staging")


class Contents(DataSource):
    """Sink of rows (digest, content): `frame.write.format("lodestone_contents").mode("append").save(root)`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "digest string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("contents are written once; use mode append")
        return _Writer(self.options["path"])


#: Bytes of contents that a task hands on at once, about.
BATCH = 8_000_000


def _objects(spark: SparkSession, root: str, digest: str | None, schema: str, contents: bool) -> DataFrame:
    """What is stored, a row for each file: tasks list the folders of their prefixes, so that names don't go through the driver, and open the files if contents are wanted."""
    prefixes = [digest[:2]] if digest else [f"{i:02x}" for i in range(256)]

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, path = opened_store(root)
        inner = lambda p: store.get_file_info(fs.FileSelector(p, allow_not_found=True))
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                for folder in inner(f"{path}/objects/{prefix}"):
                    names, data, size = [], [], 0
                    for file in inner(folder.path) if folder.type == fs.FileType.Directory else ():
                        if file.type != fs.FileType.File or file.base_name.startswith((".", "_")) or digest not in (None, file.base_name):
                            continue
                        names.append(file.base_name)
                        if contents:
                            with store.open_input_stream(file.path) as stream:
                                data.append(stream.read())
                            size += len(data[-1])
                        if size >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["digest", "content"])
                            names, data, size = [], [], 0
                    if names:
                        yield pa.RecordBatch.from_arrays([pa.array(names), *([pa.array(data, pa.binary())] if contents else [])], names=["digest", "content"][: 1 + contents])

    own = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    return own.repartition(min(len(prefixes), 64), "prefix").mapInArrow(run, schema)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """Digests of all contents; only files' names are read."""
    return _objects(spark, root, None, "digest string", contents=False).distinct()


def put(frame: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Stores each content that isn't there yet, once, and returns each row's (digest, byte_size), lazily; nulls are no content."""
    spark = frame.sparkSession
    spark.dataSource.register(Contents)
    own = frame.where(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("content")).withColumn("digest", F.sha2("content", 256))
    have = stored(spark, root)
    fresh = documents.put(own, have.hint("merge")).select("digest", "content")  # Spark doesn't know how many a listing in tasks gives, and would send all to the driver
    fresh.repartitionByRange("digest").sortWithinPartitions("digest").write.format(FORMAT).mode("append").save(root)
    return own.select("digest", F.octet_length("content").cast("bigint").alias("byte_size"))


def read(spark: SparkSession, root: str, digest: str | None = None) -> DataFrame:
    """(digest, content, intact) of one content or of all; intact tells whether it still is what its name says."""
    own = _objects(spark, root, digest, "digest string, content binary", contents=True)
    return own.select("digest", "content", (F.sha2("content", 256) == F.col("digest")).alias("intact"))

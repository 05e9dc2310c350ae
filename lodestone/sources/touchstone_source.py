"""Touchstone files as a data source of Spark: a partition for each file, filters on network and frequency pushed down.

`spark.dataSource.register(Touchstone)`, then `spark.read.format("touchstone").load(folder)`. Filters on network_id choose
files by their names before any is opened; filters on freq_hz drop points while a file is read, before they become rows.
Everything else is left to Spark. Filters reach the source where spark.sql.python.filterPushdown.enabled is on, as `read`
sets it; without it rows are the same. Option `errors`: `raise` (default) or `skip`, for files that can't be parsed.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lodestone.sources.stores import opened_store
from lodestone.sources.touchstone import SCHEMA, parse, ports_of

#: Rows of a batch.
BATCH = 1 << 16
_BOUNDS = {GreaterThan: lambda f, v: f > v, GreaterThanOrEqual: lambda f, v: f >= v, LessThan: lambda f, v: f < v, LessThanOrEqual: lambda f, v: f <= v, EqualTo: lambda f, v: f == v}


@dataclass
class File(InputPartition):
    path: str
    network: str

    def __init__(self, path: str, network: str):
        super().__init__((path, network))
        self.path, self.network = path, network


class Reader(DataSourceReader):
    def __init__(self, folder: str, errors: str = "raise"):
        if errors not in ("raise", "skip"):
            raise ValueError("errors is raise or skip")
        self.folder, self.errors = folder.rstrip("/"), errors
        self.networks: set[str] | None = None
        self.bounds: list[tuple[type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Keeps what it can do itself and gives the rest back."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("network_id",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.networks = wanted if self.networks is None else self.networks & wanted
            elif column == ("freq_hz",) and type(f) in _BOUNDS:
                self.bounds.append((type(f), float(f.value)))
            else:
                yield f

    def partitions(self) -> list[File]:
        """Files by name; the folder's list is all that the driver sees."""
        from pyarrow import fs

        store, path = opened_store(self.folder)
        found = []
        for info in store.get_file_info(fs.FileSelector(path, recursive=True)):
            network = info.base_name.rsplit(".", 1)[0]
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name.lower(), "*.s[0-9]*p") and (self.networks is None or network in self.networks):
                found.append(File(f"{self.folder}/{info.path[len(path.rstrip('/')) + 1 :]}", network))
        return sorted(found, key=lambda f: f.path) or [File("", "")]

    def _passes(self, freq: float) -> bool:
        return all(_BOUNDS[kind](freq, value) for kind, value in self.bounds)

    def read(self, partition: File) -> Iterator:
        import pyarrow as pa

        if not partition.path:
            return
        store, path = opened_store(partition.path)
        with store.open_input_stream(path) as file:
            text = file.read().decode()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
            rows.clear()
            return out

        try:
            own = parse(text, ports_of(path))
            if self.errors == "skip":
                own = iter(list(own))  # a file counts whole or not at all
        except ValueError:
            if self.errors == "raise":
                raise
            return
        for row in own:
            if self._passes(row[1]):
                rows.append((partition.network, *row))
                if len(rows) >= BATCH:
                    yield batch()
        yield batch()


class Touchstone(DataSource):
    @classmethod
    def name(cls) -> str:
        return "touchstone"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("errors", "raise"))


def read(spark: SparkSession, folder: str, errors: str = "raise") -> DataFrame:
    """Long rows of all files below a folder; turns on filters for Python sources in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Touchstone)
    return spark.read.format("touchstone").option("errors", errors).load(folder)

"""File systems by the names that Spark uses for them, for what is read and written inside tasks."""

from __future__ import annotations

#: Hadoop's names of stores, and those of the file systems that tasks use.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def opened_store(name: str):
    """(file system, path) of a URI as Spark writes it, or of a plain path."""
    from pyarrow import fs

    scheme, mark, rest = name.partition(":")
    if not mark or "/" in scheme:
        return fs.FileSystem.from_uri("file://" + name)
    scheme = SCHEMES.get(scheme, scheme)
    if scheme == "file":
        rest = "//" + "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")

"""Tables of keyed rows in hash buckets, whose upserts and deletes rewrite only the buckets that they touch.

`data/<change>/bucket=<b>` holds a bucket as some change left it, `versions/<n>.json` says for each bucket (at most
MOST, so the list is bounded) which change that was, and `current` names the version that counts. A change writes its
buckets beside the old ones, then its version, and swaps `current` last, by one rename: until then, and when it fails,
readers see the version before. Old versions stay readable until `vacuum`. One writer at a time: a change that finds
another version than the one it began with raises an error and leaves the table as it is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.stores import opened_store

MOST = 1 << 14


class Conflict(RuntimeError):
    """Another change came between."""


def _exists(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _text(root: str, name: str) -> str:
    store, path = opened_store(root)
    with store.open_input_stream(f"{path}/{name}") as file:
        return file.read().decode()


def _put(root: str, name: str, text: str) -> None:
    store, path = opened_store(root)
    temp = f"{path}/{name}.{uuid.uuid4().hex}"
    store.create_dir(temp.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(temp) as file:
        file.write(text.encode())
    store.move(temp, f"{path}/{name}")


def version(root: str) -> int:
    return int(_text(root, "current"))


def _state(root: str, number: int) -> dict:
    return json.loads(_text(root, f"versions/{number}.json"))


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def _publish(root: str, before: int, state: dict) -> int:
    store, path = opened_store(root)
    if before and version(root) != before or not before and _exists(store, f"{path}/current"):
        raise Conflict(f"{root} is no longer at version {before}")
    _put(root, f"versions/{before + 1}.json", json.dumps(state))
    _put(root, "current", str(before + 1))
    return before + 1


def _write(frame: DataFrame, root: str, keys: list[str], n: int) -> str:
    change = uuid.uuid4().hex
    frame.withColumn("bucket", _bucket(keys, n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{change}")
    return change


def _held(frame: DataFrame, keys: list[str], n: int) -> list[int]:
    """Buckets that have rows: at most n numbers."""
    return sorted(r["b"] for r in frame.select(_bucket(keys, n).alias("b")).distinct().collect())


def create(frame: DataFrame, root: str, keys: list[str], buckets: int) -> int:
    """Version 1, of rows with distinct keys."""
    if not 0 < buckets <= MOST:
        raise ValueError(f"from 1 to {MOST} buckets")
    change = _write(frame, root, keys, buckets)
    held = _held(frame, keys, buckets)
    return _publish(root, 0, {"keys": keys, "buckets": buckets, "schema": frame.schema.json(), "of": {str(b): change for b in held}})


def read(spark: SparkSession, root: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """Rows of a version (the current one unless named), of all buckets or some."""
    from pyspark.sql.types import StructType

    state = _state(root, number or version(root))
    schema = StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{root}/data/{change}/bucket={b}" for b, change in sorted(state["of"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def lookup(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Rows of the given keys (columns named as the table's), from their buckets alone."""
    state = _state(root, number := version(root))
    own = read(spark, root, number, _held(keys, state["keys"], state["buckets"])).alias("o")
    return own.join(keys.select(*state["keys"]).distinct().alias("n"), _same(state["keys"]), "left_semi")


def _changed(spark: SparkSession, root: str, keys: DataFrame, added: DataFrame | None) -> int:
    number = version(root)
    state = _state(root, number)
    touched = _held(keys, state["keys"], state["buckets"])
    if not touched:
        return number
    rest = read(spark, root, number, touched).alias("o").join(keys.select(*state["keys"]).distinct().alias("n"), _same(state["keys"]), "left_anti")
    left = rest if added is None else rest.unionByName(added)
    change = _write(left, root, state["keys"], state["buckets"])
    held = _held(spark.read.parquet(f"{root}/data/{change}"), state["keys"], state["buckets"]) if _any(root, change) else []
    of = {b: c for b, c in state["of"].items() if int(b) not in touched} | {str(b): change for b in held}
    return _publish(root, number, state | {"of": of})


def _any(root: str, change: str) -> bool:
    """Whether a change left rows at all: Spark writes no folder for a bucket without."""
    from pyarrow import fs

    store, path = opened_store(f"{root}/data/{change}")
    return any(f.type == fs.FileType.Directory for f in store.get_file_info(fs.FileSelector(path)))


def upsert(frame: DataFrame, root: str) -> int:
    """Rows replace those of equal keys, or are added; of several rows with one key the greatest, column by column, counts. Gives the new version."""
    state = _state(root, version(root))
    columns = read(frame.sparkSession, root).columns
    newest = frame.select(*columns).groupBy(*state["keys"]).agg(F.max(F.struct(*[c for c in columns if c not in state["keys"]])).alias("_r")).select(*state["keys"], "_r.*").select(*columns)
    return _changed(frame.sparkSession, root, newest, newest)


def delete(keys: DataFrame, root: str) -> int:
    """Rows of the given keys go; keys that the table hasn't don't matter."""
    return _changed(keys.sparkSession, root, keys, None)


def vacuum(root: str, keep: int = 1) -> list[str]:
    """Removes what none of the last versions needs; gives the changes that went."""
    from pyarrow import fs

    store, path = opened_store(root)
    last = version(root)
    needed = {c for v in range(max(1, last - keep + 1), last + 1) for c in _state(root, v)["of"].values()}
    gone = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{path}/data")) if f.base_name not in needed]
    for change in gone:
        store.delete_dir(f"{path}/data/{change}")
    return sorted(gone)

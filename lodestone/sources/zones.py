"""Zone maps: the least and greatest value and the nulls of each column in each row group, as a table to choose row groups by.

The map is made of footers alone, once; a predicate is evaluated on it before any data is read, and only row groups that
may hold a row are opened. What they hold is then filtered, so rows are those of a plain filter. Columns without
statistics rule nothing out. NaN is no value to Parquet's statistics, so it isn't one here: rows of NaN go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.snapshots import _files, _opened, read_row_groups

SCHEMA = "file string, row_group int, column string, n_rows bigint, nulls bigint, low_whole bigint, high_whole bigint, low_number double, high_number double, low_text string, high_text string"
Condition = tuple[str, str, object]
_OPS = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a.isin(*b), "null": lambda a, _: a.isNull()}


def _bounds(low: object, high: object) -> tuple:
    """Both as whole number, number or text; days and microseconds of dates and times."""
    import datetime as dt

    def plain(x: object) -> object:
        if isinstance(x, dt.datetime):
            return ((x if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        return (x - dt.date(1970, 1, 1)).days if isinstance(x, dt.date) else x

    low, high = plain(low), plain(high)
    if isinstance(low, int) and not isinstance(low, bool):
        return low, high, None, None, None, None
    if isinstance(low, float):
        return None, None, low, high, None, None
    return (None, None, None, None, low, high) if isinstance(low, str) else (None,) * 6


def zone_map(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column of each row group; tasks get paths and read footers."""

    def run(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch["path"]:
                with _opened(name) as file:
                    meta = pq.ParquetFile(file).metadata
                rows = []
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        chunk = meta.row_group(g).column(c)
                        stats = chunk.statistics
                        has = stats is not None and stats.has_min_max
                        nulls = stats.null_count if stats is not None and stats.has_null_count else None
                        rows.append((name, g, chunk.path_in_schema, meta.row_group(g).num_rows, nulls, *(_bounds(stats.min, stats.max) if has else (None,) * 6)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(dict.fromkeys(["nulls", "low_whole", "high_whole"], "Int64"))

    return _files(spark, path).mapInPandas(run, SCHEMA)


def _may_hold(condition: Condition) -> Column:
    """Whether a column's zone may hold a value of the condition; true where its statistics don't tell."""
    _, op, value = condition
    if op == "null":
        return F.coalesce(F.col("nulls") > 0, F.lit(True))
    values = list(value) if op == "in" else [value]
    some = F.coalesce(F.col("nulls") < F.col("n_rows"), F.lit(True))
    if not values:
        return F.lit(False)
    first = values[0]
    kind = "text" if isinstance(first, str) else None if isinstance(first, bool) or not isinstance(first, (int, float)) else "number"
    if kind is None:
        return some
    low, high = (F.col("low_text"), F.col("high_text")) if kind == "text" else tuple(F.coalesce(F.col(f"{e}_whole"), F.col(f"{e}_number")) for e in ("low", "high"))
    if kind == "number" and all(isinstance(v, int) for v in values):  # doubles can't tell large whole numbers apart
        low, high = (F.when(F.col(f"{e}_whole").isNotNull(), F.col(f"{e}_whole").cast("decimal(38,6)")).otherwise(F.col(f"{e}_number").cast("decimal(38,6)")) for e in ("low", "high"))
    fits = {"==": lambda v: (low <= F.lit(v)) & (high >= F.lit(v)), "<": lambda v: low < F.lit(v), "<=": lambda v: low <= F.lit(v), ">": lambda v: high > F.lit(v), ">=": lambda v: high >= F.lit(v)}
    test = reduce(lambda a, b: a | b, [fits["==" if op == "in" else op](v) for v in values])
    return some & F.coalesce(test, F.lit(True))


def choose(zones: DataFrame, conditions: list[Condition]) -> DataFrame:
    """(file, row_group) that may hold rows which all conditions (column, operator, value) let pass."""
    own = zones.where(F.col("column").isin(*{c for c, _, _ in conditions})) if conditions else zones
    tests = [(F.col("column") != c[0]) | _may_hold(c) for c in conditions]
    return own.groupBy("file", "row_group").agg(F.bool_and(reduce(lambda a, b: a & b, tests, F.lit(True))).alias("may")).where("may").select("file", "row_group")


def read_where(zones: DataFrame, path: str, columns: list[str], conditions: list[Condition]) -> DataFrame:
    """Columns of the rows that all conditions let pass, from the row groups that may hold some."""
    needed = list(dict.fromkeys([*columns, *(c for c, _, _ in conditions)]))
    own = read_row_groups(choose(zones, conditions), needed, path)
    for column, op, value in conditions:
        own = own.where(_OPS[op](F.col(column), value))
    return own.select(*columns)

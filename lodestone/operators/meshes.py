"""Meshes and via patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299_792_458.0


def mesh_stats(lines: DataFrame) -> DataFrame:
    """Of each axis' sorted lines: n_cells, min_cell, max_cell, mean_cell; null where there is no cell."""
    n = F.size("lines")
    cells = F.zip_with(F.slice("lines", 1, F.greatest(n - 1, F.lit(0))), F.slice("lines", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return lines.select("axis", cells.alias("cells")).select("axis", F.size("cells").alias("n_cells"), F.array_min("cells").alias("min_cell"), F.array_max("cells").alias("max_cell"), F.try_divide(total.cast("double"), F.size("cells").cast("double")).alias("mean_cell"))


def cell_sizes(specs: DataFrame, f_max_hz: float, fraction: float = 0.05, finest: int = 5_000, coarsest: int = 500_000, edge: int = 25_000) -> DataFrame:
    """Adds min_wavelength in the dielectric, base_cell and trace_cell (4 cells across a trace, 3 across a gap), in nanometres."""
    wave = F.floor(F.lit(SPEED_OF_LIGHT) / (F.lit(f_max_hz) * F.sqrt("er")) * F.lit(1e9)).cast("bigint")
    own = specs.withColumn("min_wavelength", wave)
    own = own.withColumn("base_cell", F.greatest(F.lit(finest), F.least(F.floor(F.col("min_wavelength") * F.lit(fraction)).cast("bigint"), F.lit(coarsest))).cast("bigint"))
    return own.withColumn("trace_cell", F.greatest(F.lit(finest), F.least(F.lit(edge), F.floor(F.col("w") / 4).cast("bigint"), F.floor(F.col("gap") / 3).cast("bigint"), F.col("base_cell"))).cast("bigint"))


def densities(specs: DataFrame, f_max_hz: float, drill: str, pad: str, thickness: str, finest: int = 5_000, via: int = 25_000, substrate: int = 50_000, **options) -> DataFrame:
    """Adds to the cell sizes those of vias (4 across a drill, 6 across a pad), of antipads, of the substrate (3 to a layer, of which `thickness` is an array) and of the absorbing border; drills and pads of 0 or null ask for nothing."""
    own = cell_sizes(specs, f_max_hz, finest=finest, **options)
    at_least = lambda x: F.greatest(F.lit(finest), x).cast("bigint")
    across = lambda c, n: F.when(F.col(c) > 0, F.floor(F.col(c) / n))  # noqa: E731  least() passes nulls over
    own = own.withColumn("via_cell", at_least(F.least(F.greatest(F.lit(finest), F.least(F.lit(via), F.col("base_cell"))), across(drill, 4), across(pad, 6))))
    layers = F.array_min(F.transform(F.filter(thickness, lambda t: t > 0), lambda t: F.floor(t / 3)))
    own = own.withColumn("substrate_cell", at_least(F.least(F.greatest(F.lit(finest), F.least(F.lit(substrate), F.col("base_cell"))), layers)))
    return own.withColumns({"antipad_cell": F.col("via_cell"), "border_cell": F.col("base_cell")})


def ring(frame: DataFrame, key: str, radius: str, count: str) -> DataFrame:
    """Centres of `count` vias on a circle: key, k, x, y. Angles step by whole thousandths of a degree, coordinates lose their fractions; no vias where radius or count is null or not above 0."""
    own = frame.where((F.col(count) > 0) & (F.col(radius) > 0)).select(key, radius, count, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)).alias("k"))
    angle = F.radians(F.col("k") * F.floor(F.lit(360_000) / F.col(count)) / 1000)
    return own.select(key, "k", (F.col(radius) * F.cos(angle)).cast("bigint").alias("x"), (F.col(radius) * F.sin(angle)).cast("bigint").alias("y"))


def grid(frame: DataFrame, key: str, rows: str, cols: str, row_pitch: str, col_pitch: str, without_centre: bool = True) -> DataFrame:
    """Centres of rows x cols vias around the origin: key, row, col, x, y; the middle one (of an even number, the one before the middle) stays out if asked."""
    own = frame.where((F.col(rows) > 0) & (F.col(cols) > 0)).withColumn("row", F.explode(F.sequence(F.lit(0), F.col(rows).cast("int") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col(cols).cast("int") - 1)))
    if without_centre:
        own = own.where(~((F.col("row") == F.floor((F.col(rows) - 1) / 2)) & (F.col("col") == F.floor((F.col(cols) - 1) / 2))))
    place = lambda at, n, pitch: (F.col(at) * F.col(pitch) - F.floor((F.col(n) - 1) * F.col(pitch) / 2)).cast("bigint")
    return own.select(key, "row", "col", place("col", cols, col_pitch).alias("x"), place("row", rows, row_pitch).alias("y"))


def fence(frame: DataFrame, key: str, length: Column, pitch: str, offset: Column) -> DataFrame:
    """Vias in two rows along a straight trace, as many as whole pitches fit, in the middle of it, at an offset to either side: key, k, side, x, y."""
    own = frame.withColumns({"_length": length.cast("bigint"), "_n": F.floor(length / F.col(pitch)).cast("int"), "_offset": offset.cast("bigint")}).where("_n > 0")
    own = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    start = F.floor((F.col("_length") - (F.col("_n") - 1) * F.col(pitch)) / 2)
    return own.select(key, "k", "side", (start + F.col("k") * F.col(pitch)).cast("bigint").alias("x"), (F.col("side") * F.col("_offset")).cast("bigint").alias("y"))


def _grade(a: int, b: int, finest: int, ratio: float, coarsest: int) -> list[int]:
    """Lines between two fixed ones: cells grow from both ends by the ratio up to the coarsest, and meet in the middle."""
    left, right, step, out = float(a), float(b), float(finest), []
    while right - left > 3 * step:
        left, right = left + step, right - step
        out += (round(left), round(right))
        step = min(step * ratio, coarsest)
    parts = max(1, round((right - left) / step))
    return sorted({a, b, *out, *(round(left + (right - left) * i / parts) for i in range(1, parts))})


def graded_lines(zones: DataFrame, finest: int, ratio: float, coarsest: int) -> DataFrame:
    """(axis, fixed array) to (axis, lines): the fixed lines, and graded ones between. A recurrence, so a helper on each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for fixed in batch["fixed"]:
                own = sorted({int(x) for x in fixed if x is not None})
                lines.append(sorted({x for a, b in zip(own, own[1:], strict=False) for x in _grade(a, b, finest, ratio, coarsest)} | set(own)))
            yield pd.DataFrame({"axis": batch["axis"], "lines": lines})

    return zones.select("axis", "fixed").mapInPandas(run, "axis string, lines array<bigint>")


def thirds_rule(centre: Column, radius: Column) -> Column:
    """Lines a third inside and two thirds outside of both edges of a round shape."""
    return F.array_sort(F.array(*[F.floor(centre + s * radius * F.lit(f)).cast("bigint") for s in (-1, 1) for f in (2 / 3, 4 / 3)]))

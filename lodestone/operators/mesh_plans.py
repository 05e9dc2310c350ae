"""Mesh plans: lines of an axis under a wavelength cap, a ratio between neighbouring cells, thirds of features and a clearance at the borders.

A row is one axis of one board, and planned by itself, so boards spread over all tasks; what is planned for an axis is a
recurrence along its lines, in a helper on each row. Sizes run forwards and backwards along the fixed lines: a cell is at
most `ratio` times the least size to either side. Gaps are then filled from both ends, and cells that are still too large beside a neighbour are
cut into equal parts, and theirs in turn, until none is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.meshes import SPEED_OF_LIGHT
from lodestone.plans.session import dealt

#: Axes that a task plans, about, and different ones whose plans it keeps.
DEAL, ALIKE = 10_000, 64
#: Lines that an axis may get; more raise an error.
MOST_LINES = 1_000_000


def largest_cell(f_max_hz: Column, er: Column, divisor: Column, base: Column) -> Column:
    """The wavelength in the dielectric over the divisor, in whole nanometres, or the base cell if that is less; at least 1."""
    return F.greatest(F.lit(1), F.least(F.floor(F.lit(SPEED_OF_LIGHT * 1e9) / (f_max_hz * F.sqrt(er) * divisor)), base)).cast("bigint")


def fixed_lines(low: Column, high: Column, clearance: Column, features: Column, thirds: bool = True) -> Column:
    """Borders moved outwards by the clearance, the domain's own, and the lines a third and two thirds through each feature (centre, radius) that lie within."""
    edge = F.array(low - clearance, low, high, high + clearance)
    if not thirds:
        return F.array_sort(F.array_distinct(edge))
    inner = F.flatten(F.transform(F.coalesce(features, F.array().cast("array<struct<centre:bigint,radius:bigint>>")), lambda f: F.array((f["centre"] - F.floor(f["radius"] / 3)).cast("bigint"), (f["centre"] + F.floor(f["radius"] / 3)).cast("bigint"))))
    return F.array_sort(F.array_distinct(F.concat(edge, F.filter(inner, lambda x: (x >= low - clearance) & (x <= high + clearance)))))


def _filled(a: int, b: int, left: float, right: float, ratio: float, cap: int) -> list[int]:
    """Lines strictly between two, with cells that begin at the given sizes at the ends and grow inwards up to the cap; what is left in the middle is no less than a cell beside it."""
    x, y, heads, tails = float(a), float(b), [a], [b]
    left, right = min(left, cap), min(right, cap)
    while y - x > left + right:
        if left <= right:
            x += left
            heads.append(int(x))
            left = min(left * ratio, cap)
        else:
            y -= right
            tails.append(int(y))
            right = min(right * ratio, cap)
        if len(heads) + len(tails) > MOST_LINES:
            raise ValueError(f"an axis has more than {MOST_LINES} lines")
    for side in (heads, tails):
        if len(side) > 1 and tails[-1] - heads[-1] < abs(side[-1] - side[-2]):
            side.pop()
    return [v for v in (*heads, *tails) if a < v < b]


def _parts(gaps: list[int], cap: int, ratio: float) -> list[int]:
    """Into how many equal cells each gap is cut, so that neighbouring cells keep the ratio: the least numbers, found by raising those that are too small."""
    parts = [-(-g // cap) for g in gaps]
    todo = list(range(len(gaps)))
    waits = [True] * len(gaps)
    total = sum(parts)
    while todo:
        i = todo.pop()
        waits[i] = False
        near = [gaps[j] // parts[j] for j in (i - 1, i + 1) if 0 <= j < len(gaps)]
        most = min([int(n * ratio) for n in near], default=cap)
        need = min(gaps[i], max(parts[i], -(-gaps[i] // max(1, most))))
        if need > parts[i]:
            total += need - parts[i]
            if total > MOST_LINES:
                raise ValueError(f"an axis has more than {MOST_LINES} lines")
            parts[i] = need
            for j in (i - 1, i + 1):
                if 0 <= j < len(gaps) and not waits[j]:
                    waits[j] = True
                    todo.append(j)
    return parts


def plan(fixed: list[int], cap: int, ratio: float) -> list[int]:
    """Lines that hold the fixed ones, with no cell above the cap and no two neighbouring cells further apart than the ratio."""
    own = sorted(set(fixed))
    if len(own) < 2:
        return own
    size = [float(min(b - a, cap)) for a, b in zip(own, own[1:], strict=False)]
    for order, step in ((range(1, len(size)), 1), (range(len(size) - 2, -1, -1), -1)):
        for i in order:
            size[i] = min(size[i], size[i - step] * ratio)
    lines = set(own)
    for k, (a, b) in enumerate(zip(own, own[1:], strict=False)):
        before, after = (size[j] * ratio if 0 <= j < len(size) else cap for j in (k - 1, k + 1))
        lines.update(_filled(a, b, min(size[k], before), min(size[k], after), ratio, cap))
    soft = sorted(lines)
    gaps = [b - a for a, b in zip(soft, soft[1:], strict=False)]
    parts = _parts(gaps, cap, ratio)
    return [*(a + g * i // n for a, g, n in zip(soft, gaps, parts, strict=False) for i in range(n)), soft[-1]]


def plans(axes: DataFrame, key: str, ratio: float) -> DataFrame:
    """(key, lines) of axes (key, fixed array<bigint>, cap bigint); a null or empty array of fixed lines has none. A ratio below 2 can't be kept by cells of one or two nanometres, which are left."""
    if ratio <= 1:
        raise ValueError("the ratio is above 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planned = lru_cache(ALIKE)(lambda f, c: plan(list(f), c, ratio))  # boards of one design have equal axes
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "lines": [planned(tuple(f.tolist()), int(c)) if f is not None else [] for f, c in zip(batch["fixed"], batch["cap"], strict=True)]})

    kind = axes.schema[key].dataType.simpleString()
    return dealt(axes.select(key, F.filter("fixed", lambda x: x.isNotNull()).alias("fixed"), "cap"), key, DEAL).mapInPandas(run, f"`{key}` {kind}, lines array<bigint>")


def summary(planned: DataFrame, key: str) -> DataFrame:
    """key, n_lines, first, last, least and largest cell, and the largest ratio of neighbouring cells (null below three lines)."""
    cells = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: F.element_at("lines", i + 1) - F.element_at("lines", i))
    own = planned.withColumn("cells", F.when(F.size("lines") > 1, cells).otherwise(F.array().cast("array<bigint>")))
    pairs = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c, i: F.greatest(c / F.element_at("cells", i + 1), F.element_at("cells", i + 1) / c))
    worst = F.when(F.size("cells") > 1, F.array_max(pairs))
    return own.select(key, F.size("lines").alias("n_lines"), F.array_min("lines").alias("first"), F.array_max("lines").alias("last"), F.array_min("cells").alias("least_cell"), F.array_max("cells").alias("largest_cell"), worst.alias("worst_ratio"))

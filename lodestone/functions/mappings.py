"""Parameters and their numbers in [0, 1]: linear, logarithmic and discrete ranges, both ways."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_value(u: Column, kind: str, low: float = 0.0, high: float = 1.0, values: tuple[float, ...] = ()) -> Column:
    """The value that a number stands for; a discrete range is cut evenly among its values."""
    if kind == "linear":
        return F.lit(float(low)) + u * F.lit(float(high - low))
    if kind == "log":
        return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
    if kind == "discrete":
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.least(F.lit(len(values)), F.floor(u * len(values)).cast("int") + 1))
    raise ValueError(kind)


def to_number(value: Column, kind: str, low: float = 0.0, high: float = 1.0, values: tuple[float, ...] = ()) -> Column:
    """The number of a value; of a discrete range, the middle of the part of the nearest value (the first on ties)."""
    if kind == "linear":
        return (value - F.lit(float(low))) / F.lit(float(max(high - low, 1e-10)))
    if kind == "log":
        return (F.ln(value) - F.lit(math.log(low))) / F.lit(max(math.log(high) - math.log(low), 1e-10))
    if kind == "discrete":
        near = F.array_min(F.array(*[F.struct(F.abs(value - F.lit(float(v))).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(values)]))
        return (near["i"] + 0.5) / F.lit(float(len(values)))
    raise ValueError(kind)

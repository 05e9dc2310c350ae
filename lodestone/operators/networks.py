"""Network parameters in long form (network_id, f_idx, freq_hz, i, j, re, im): conversions, checks, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestone.plans.session import cut

FLOOR = 1e-15


def magnitude_db(re: Column, im: Column) -> Column:
    return 20 * F.log10(F.greatest(F.hypot(re, im), F.lit(FLOOR)))


def phase_deg(re: Column, im: Column) -> Column:
    return F.degrees(F.atan2(im, re))


def to_format(re: Column, im: Column, kind: str) -> tuple[Column, Column]:
    """A value as RI, MA or DB pair."""
    if kind == "RI":
        return re, im
    return (F.hypot(re, im) if kind == "MA" else magnitude_db(re, im)), phase_deg(re, im)


def from_format(a: Column, b: Column, kind: str) -> tuple[Column, Column]:
    """Real and imaginary part of an RI, MA or DB pair."""
    if kind == "RI":
        return a, b
    size = a if kind == "MA" else F.pow(F.lit(10.0), a / 20)
    return size * F.cos(F.radians(b)), size * F.sin(F.radians(b))


def two_port(long: DataFrame) -> DataFrame:
    """One row for each frequency: re11, im11, .. re22, im22."""
    cell = lambda i, j, c: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c))).alias(f"{c}{i}{j}")
    return long.groupBy("network_id", "f_idx", "freq_hz").agg(*[cell(i, j, c) for i in (1, 2) for j in (1, 2) for c in ("re", "im")])


def _abs2(n: str) -> Column:
    return F.col(f"re{n}") * F.col(f"re{n}") + F.col(f"im{n}") * F.col(f"im{n}")


def largest_eigenvalue(wide: DataFrame) -> DataFrame:
    """Adds eig, the largest eigenvalue of S times its conjugate transpose, from its rows: exact near lossless networks too."""
    p, q = _abs2("11") + _abs2("12"), _abs2("21") + _abs2("22")
    re = F.col("re11") * F.col("re21") + F.col("im11") * F.col("im21") + F.col("re12") * F.col("re22") + F.col("im12") * F.col("im22")
    im = F.col("im11") * F.col("re21") - F.col("re11") * F.col("im21") + F.col("im12") * F.col("re22") - F.col("re12") * F.col("im22")
    return wide.withColumn("eig", (p + q) / 2 + F.hypot((p - q) / 2, F.hypot(re, im)))


def passivity(long: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """network_id, max_eig, n_violations (above 1 + tolerance), status."""
    own = largest_eigenvalue(two_port(long)).groupBy("network_id").agg(F.max("eig").alias("max_eig"), F.count_if(F.col("eig") > 1 + tolerance).alias("n_violations"))
    return own.withColumn("status", F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL"))


def reciprocity(long: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """network_id, max_error, mean_error of |Sij - Sji|, n_violations. Pairs i < j by a join on the cell."""
    a = long.where("i < j")
    b = long.where("i > j").select("network_id", "f_idx", F.col("j").alias("i"), F.col("i").alias("j"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    error = F.hypot(F.col("re") - F.col("rb"), F.col("im") - F.col("ib"))
    return a.join(b, ["network_id", "f_idx", "i", "j"]).groupBy("network_id").agg(F.max(error).alias("max_error"), F.avg(error).alias("mean_error"), F.count_if(error > tolerance).alias("n_violations"))


def power_balance(long: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """network_id, worst excess of a column's power over 1, the frequency of it, verdict."""
    sums = long.groupBy("network_id", "f_idx", "freq_hz", "j").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    own = sums.groupBy("network_id").agg((F.max("p") - 1).alias("excess"), F.max_by("freq_hz", F.struct("p", -F.col("f_idx"), -F.col("j"))).alias("worst_freq_hz"))
    return own.withColumn("status", F.when(F.col("excess") <= 0, "PASSED").when(F.col("excess") <= tolerance, "WARNING").otherwise("FAILED"))


def metrics(long: DataFrame) -> DataFrame:
    """network_id and min, max, mean of |S11| and |S21| in dB."""
    db = {n: magnitude_db(F.col(f"re{n}"), F.col(f"im{n}")) for n in ("11", "21", "12")}
    return two_port(long).groupBy("network_id").agg(*[f(x).alias(f"s{n}_db_{name}") for n, x in db.items() for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def stability(long: DataFrame) -> DataFrame:
    """network_id, f_idx, k (infinite without transmission), delta: Rollett's factor and |determinant|."""
    wide = two_port(long)
    re = lambda a, b: F.col(f"re{a}") * F.col(f"re{b}") - F.col(f"im{a}") * F.col(f"im{b}")
    im = lambda a, b: F.col(f"re{a}") * F.col(f"im{b}") + F.col(f"im{a}") * F.col(f"re{b}")
    delta = F.hypot(re("11", "22") - re("12", "21"), im("11", "22") - im("12", "21"))
    across = 2 * F.hypot(re("12", "21"), im("12", "21"))
    k = F.when(across > FLOOR, F.try_divide(1 - _abs2("11") - _abs2("22") + delta * delta, across)).otherwise(F.lit(float("inf")))
    return wide.select("network_id", "f_idx", k.alias("k"), delta.alias("delta"))


def _backwards(*by: str) -> WindowSpec:
    """From the greatest frequency down to a row's own: a frame that grows is linear, one that shrinks is made anew for each row."""
    return Window.partitionBy(*by).orderBy(F.desc("freq_hz")).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def interpolate(long: DataFrame, grid: DataFrame) -> DataFrame:
    """Values on a grid (network_id, freq_hz), linear in real and imaginary part, constant beyond the ends: a union and two windows, no range join."""
    cells = long.select("network_id", "i", "j").distinct()
    wanted = grid.select("network_id", "freq_hz").distinct().join(cells, "network_id").select("network_id", "i", "j", "freq_hz", F.lit(None).cast("double").alias("re"), F.lit(None).cast("double").alias("im"), F.lit(True).alias("wanted"))
    both = long.select("network_id", "i", "j", "freq_hz", "re", "im", F.lit(False).alias("wanted")).union(wanted)
    by = Window.partitionBy("network_id", "i", "j").orderBy("freq_hz")  # equal frequencies are peers: the source point serves as both ends
    point = F.when(~F.col("wanted"), F.struct("freq_hz", "re", "im"))
    before = F.last(point, ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.last(point, ignorenulls=True).over(_backwards("network_id", "i", "j"))
    own = both.select("*", before.alias("a"), after.alias("b")).where("wanted")
    return _between(own.select("network_id", "i", "j", "freq_hz", F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")))


def interpolate_blocks(long: DataFrame, grid: DataFrame, blocks: int | None = None) -> DataFrame:
    """As `interpolate`, for networks of any length: ranges of (cell, frequency) are windows of their own, and each takes the nearest points before and after it from a table of a row for each range and cell.

    Equal frequencies of a cell fall in one range. Of several source points at one frequency any one may serve.
    """
    cells = long.select("network_id", "i", "j").distinct()
    cell, none = ["network_id", "i", "j"], F.lit(None).cast("double")
    wanted = grid.select("network_id", "freq_hz").distinct().join(cells, "network_id").select(*cell, "freq_hz", none.alias("re"), none.alias("im"), F.lit(True).alias("wanted"))
    both = long.select(*cell, "freq_hz", "re", "im", F.lit(False).alias("wanted")).union(wanted)
    order = [*cell, "freq_hz"]
    ranged = both.repartitionByRange(blocks, *order) if blocks else both.repartitionByRange(*order)
    own = cut(ranged.withColumn("block", F.spark_partition_id()))
    point = F.when(~F.col("wanted"), F.struct("freq_hz", "re", "im"))
    ends = own.groupBy(*cell, "block").agg(F.max(point).alias("last"), F.min(point).alias("first"))
    by = Window.partitionBy(*cell)
    before = F.last("last", ignorenulls=True).over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(by.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*cell, "block", before.alias("before"), after.alias("after"))
    by = Window.partitionBy(*cell, "block").orderBy("freq_hz")
    a = F.last(point, ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    b = F.last(point, ignorenulls=True).over(_backwards(*cell, "block"))
    near = own.select("*", a.alias("a"), b.alias("b")).where("wanted").join(ends, [*cell, "block"])
    near = near.withColumns({"a": F.coalesce("a", "before"), "b": F.coalesce("b", "after")})
    return _between(near.select(*order, F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")))


def _between(own: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide(F.col("freq_hz") - F.col("a.freq_hz"), F.col("b.freq_hz") - F.col("a.freq_hz")), F.lit(0.0))
    mixed = lambda c: (F.col(f"a.{c}") + F.col("w") * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c)
    return own.withColumn("w", share).select("network_id", "i", "j", "freq_hz", mixed("re"), mixed("im"))


def deembed(long: DataFrame, shifts: dict[int, float]) -> DataFrame:
    """Turns each value by the phase beta L of its shifted ports. Known behaviour, kept: the diagonal is turned once, pairs of two shifted ports twice."""
    beta = 2 * F.pi() * F.col("freq_hz") / F.lit(299_792_458.0)
    length = lambda c: F.coalesce(*[F.when(F.col(c) == p, F.lit(v)) for p, v in shifts.items()], F.lit(0.0))
    turn = -beta * F.when(F.col("i") == F.col("j"), length("i")).otherwise(length("i") + length("j"))
    return long.withColumn("_t", turn).withColumns({"re": F.col("re") * F.cos("_t") - F.col("im") * F.sin("_t"), "im": F.col("re") * F.sin("_t") + F.col("im") * F.cos("_t")}).drop("_t")


def compare(base: DataFrame, other: DataFrame, share: float = 0.95) -> DataFrame:
    """Of the cells of both: largest, root-mean-square, and a percentile of |difference|; missing counts cells of one side only."""
    keys = ["network_id", "f_idx", "i", "j"]
    b = other.select(*keys, F.col("re").alias("rb"), F.col("im").alias("ib"), F.lit(True).alias("_b"))
    joined = base.select(*keys, "re", "im", F.lit(True).alias("_a")).join(b, keys, "full_outer")
    d = F.hypot(F.col("re") - F.col("rb"), F.col("im") - F.col("ib"))
    return joined.groupBy("network_id").agg(F.max(d).alias("max_delta"), F.sqrt(F.avg(d * d)).alias("rms_delta"), F.percentile(d, F.lit(share)).alias("percentile_delta"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"))


def energy_decay(series: DataFrame, threshold_db: float = -60.0) -> DataFrame:
    """sim_id: last_db, span, rate per sample, verdict, of (sim_id, k, energy_db)."""
    own = series.groupBy("sim_id").agg(F.max_by("energy_db", "k").alias("last_db"), F.min_by("energy_db", "k").alias("first_db"), F.count("*").alias("n"))
    return own.select("sim_id", "last_db", (F.col("last_db") - F.col("first_db")).alias("span_db"), F.coalesce(F.try_divide(F.col("last_db") - F.col("first_db"), (F.col("n") - 1).cast("double")), F.lit(0.0)).alias("rate_db"), F.when(F.col("last_db") <= threshold_db, "PASSED").otherwise("FAILED").alias("status"))


def roll_up(checks: DataFrame, by: str) -> DataFrame:
    """FAILED if any check failed, SKIPPED if all were skipped, WARNING if any warns, else PASSED."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return checks.groupBy(by).agg(F.when(any_("FAILED"), "FAILED").when(F.every(F.col("status") == "SKIPPED"), "SKIPPED").when(any_("WARNING"), "WARNING").otherwise("PASSED").alias("status"))


def mixed_mode(long: DataFrame, pairs: tuple[tuple[int, int], tuple[int, int]] = ((1, 3), (2, 4))) -> DataFrame:
    """4-port networks in differential and common modes: network_id, f_idx, freq_hz, mode (dd, dc, cd, cc), i, j, re, im."""
    if len({p for pair in pairs for p in pair}) != 4:
        raise ValueError("pairs must cover four ports once each")
    sign = {p: (pair, s) for pair, ports in enumerate(pairs, 1) for p, s in zip(ports, (1, -1), strict=True)}
    pair = lambda c: F.coalesce(*[F.when(F.col(c) == p, F.lit(k)) for p, (k, _) in sign.items()])
    turn = lambda c: F.coalesce(*[F.when(F.col(c) == p, F.lit(s)) for p, (_, s) in sign.items()])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), f.alias("f")) for m, f in (("dd", turn("i") * turn("j")), ("dc", turn("i")), ("cd", turn("j")), ("cc", F.lit(1)))])
    own = long.select("network_id", "f_idx", "freq_hz", pair("i").alias("pi"), pair("j").alias("pj"), "re", "im", F.inline(modes))
    return own.groupBy("network_id", "f_idx", "freq_hz", "mode", F.col("pi").alias("i"), F.col("pj").alias("j")).agg((F.sum(F.col("re") * F.col("f")) / 2).alias("re"), (F.sum(F.col("im") * F.col("f")) / 2).alias("im"))


def line_impedance(w: Column, gap: Column, er: Column) -> Column:
    """Approximate impedance of a coplanar line: two branches of the elliptic ratio at k = 0.707; 50 where the geometry is void."""
    k = F.try_divide(w.cast("double"), w + 2 * gap)
    kp = F.sqrt(F.greatest(F.lit(0.0), 1 - k * k))
    curve = lambda x: F.log(2 * (1 + F.sqrt(x)) / (1 - F.sqrt(x)))
    ratio = F.when(k <= 0.707, curve(kp) / F.pi()).otherwise(F.pi() / curve(k))
    return F.when((w <= 0) | (gap <= 0), F.lit(50.0)).otherwise(30 * F.pi() / F.sqrt((er + 1) / 2) * ratio)


def impedance_verdict(port: Column, line: Column, warn: float = 10.0, fail: float = 25.0) -> tuple[Column, Column]:
    """Mismatch in percent and its verdict."""
    off = F.when(line > 0, F.abs(port - line) / line * 100).otherwise(F.lit(100.0))
    return off, F.when(off <= warn, "PASSED").when(off <= fail, "WARNING").otherwise("FAILED")

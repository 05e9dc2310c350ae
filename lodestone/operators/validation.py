"""Validation of networks: every check on every network, their verdicts together, strict or not.

All checks but causality are aggregates with partial sums over rows of frequencies, so a network of any length spreads over
many tasks; causality needs a network's whole transmission in one task (an inverse transform) and can be left out.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import networks as N
from lodestone.operators import signals as S


@dataclass(frozen=True)
class Limit:
    """A value up to `passes` passes, up to `warns` warns, beyond it fails; a check that isn't enabled is skipped."""

    passes: float
    warns: float
    enabled: bool = True


LIMITS = {"passivity": Limit(1 + 1e-6, 1 + 1e-6), "reciprocity": Limit(1e-6, 1e-6), "causality": Limit(1e-3, 1e-2), "power_balance": Limit(0.0, 0.1)}
CHECK = ["network_id", "check", "value", "worst_freq_hz", "n_violations"]


def worst_pairs(long: DataFrame) -> DataFrame:
    """Reciprocity in full: network_id, max_error and max_error_db of |Sij - Sji|, and where: i < j and freq_hz; of equal errors the lowest frequency, then the first pair. A network of one port has no row."""
    a = long.where("i < j")
    b = long.where("i > j").select("network_id", "f_idx", F.col("j").alias("i"), F.col("i").alias("j"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    error = F.hypot(F.col("re") - F.col("rb"), F.col("im") - F.col("ib"))
    worst = F.max_by(F.struct("i", "j", "freq_hz"), F.struct(F.col("e"), -F.col("freq_hz"), -F.col("i"), -F.col("j")))
    own = a.join(b, ["network_id", "f_idx", "i", "j"]).withColumn("e", error).groupBy("network_id").agg(F.max("e").alias("max_error"), worst.alias("w"))
    return own.select("network_id", "max_error", (20 * F.log10(F.greatest(F.col("max_error"), F.lit(N.FLOOR)))).alias("max_error_db"), "w.i", "w.j", "w.freq_hz")


def symmetry(long: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Two-port networks: network_id, symmetry_error (largest |S11 - S22|), reciprocity_error (largest |S12 - S21|), n_active (points whose largest eigenvalue is above 1 + tolerance)."""
    wide = N.largest_eigenvalue(N.two_port(long))
    gap = lambda a, b: F.max(F.hypot(F.col(f"re{a}") - F.col(f"re{b}"), F.col(f"im{a}") - F.col(f"im{b}")))
    return wide.groupBy("network_id").agg(gap("11", "22").alias("symmetry_error"), gap("12", "21").alias("reciprocity_error"), F.count_if(F.col("eig") > 1 + tolerance).alias("n_active"))


def _measured(long: DataFrame, limits: Mapping[str, Limit]) -> DataFrame:
    """(network_id, check, value, worst_freq_hz, n_violations) of the enabled checks; the value is what the limits are for."""
    parts = []

    def worst(frame: DataFrame, name: str, value: Column) -> None:
        limit = limits[name]
        own = frame.select("network_id", "freq_hz", value.alias("v")).groupBy("network_id").agg(F.max("v").alias("value"), F.max_by("freq_hz", F.struct("v", -F.col("freq_hz"))).alias("worst_freq_hz"), F.count_if(F.col("v") > limit.warns).alias("n_violations"))
        parts.append(own.withColumn("check", F.lit(name)).select(*CHECK))

    if limits["passivity"].enabled:
        worst(N.largest_eigenvalue(N.two_port(long)), "passivity", F.sqrt(F.greatest("eig", F.lit(0.0))))
    if limits["reciprocity"].enabled:
        other = long.where("i > j").select("network_id", "f_idx", F.col("j").alias("i"), F.col("i").alias("j"), F.col("re").alias("rb"), F.col("im").alias("ib"))
        worst(long.where("i < j").join(other, ["network_id", "f_idx", "i", "j"]), "reciprocity", F.hypot(F.col("re") - F.col("rb"), F.col("im") - F.col("ib")))
    if limits["power_balance"].enabled:
        sums = long.groupBy("network_id", "f_idx", "freq_hz", "j").agg((F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) - 1).alias("p"))
        worst(sums, "power_balance", F.col("p"))
    if limits["causality"].enabled:
        own = S.causality(long, limits["causality"].passes, limits["causality"].warns)
        parts.append(own.select("network_id", F.lit("causality").alias("check"), F.col("ratio").alias("value"), F.lit(None).cast("double").alias("worst_freq_hz"), (F.col("ratio") > limits["causality"].warns).cast("bigint").alias("n_violations")))
    out = parts[0] if parts else long.select("network_id", F.lit("").alias("check"), F.lit(0.0).alias("value"), F.lit(0.0).alias("worst_freq_hz"), F.lit(0).cast("bigint").alias("n_violations")).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def checks(long: DataFrame, limits: Mapping[str, Limit] = LIMITS, strict: bool = False) -> DataFrame:
    """A row for each network and check: value, worst frequency, violations, status PASS, WARN, FAIL or SKIP.

    A check that isn't enabled, or has nothing to measure (one port, a value of NaN), is skipped. Strict ends the query
    with an error at the first that fails, with network, check, value and number of violations.
    """
    names = F.array(*[F.lit(n) for n in limits])
    all_ = long.select("network_id").distinct().select("network_id", F.explode(names).alias("check"))
    own = all_.join(_measured(long, limits), ["network_id", "check"], "left")
    of = lambda field: F.coalesce(*[F.when(F.col("check") == n, F.lit(float(getattr(x, field)))) for n, x in limits.items()])
    empty = F.col("value").isNull() | F.isnan("value")
    status = F.when(empty, "SKIP").when(F.col("value") <= of("passes"), "PASS").when(F.col("value") <= of("warns"), "WARN").otherwise("FAIL")
    if strict:
        said = F.concat(F.lit("network "), F.coalesce("network_id", F.lit("null")), F.lit(" fails "), F.col("check"), F.lit(": "), F.col("value").cast("string"), F.lit(", violations: "), F.col("n_violations").cast("string"))
        status = F.when(status == "FAIL", F.raise_error(said)).otherwise(status)
    return own.withColumn("status", status).select("network_id", "check", "value", "worst_freq_hz", "n_violations", "status")


def verdicts(checked: DataFrame) -> DataFrame:
    """A row for each network: FAIL if any check fails, SKIP if all were skipped, WARN if any warns, else PASS; how many of each, and the names of those that fail, sorted."""
    count = lambda s: F.count_if(F.col("status") == s)
    failing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "FAIL", F.col("check")))), ",")
    own = checked.groupBy("network_id").agg(*[count(s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL", "SKIP")], failing.alias("failing"), F.count("*").alias("n"))
    status = F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_skip") == F.col("n"), "SKIP").when(F.col("n_warn") > 0, "WARN").otherwise("PASS")
    return own.withColumn("status", status).drop("n")

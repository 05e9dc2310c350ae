"""Checks of simulation set-ups, layers, ports and cases, as rows (check, status, detail)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(value: Column, warn: float, fail: float) -> Column:
    """PASSED up to warn, WARNING up to fail, else FAILED; SKIPPED where there is no value."""
    return F.when(value.isNull(), "SKIPPED").when(value <= warn, "PASSED").when(value <= fail, "WARNING").otherwise("FAILED")


def nyquist(step_s: Column, f_max_hz: Column) -> Column:
    """Whether a time step resolves the highest frequency."""
    return F.when(step_s * 2 * f_max_hz <= 1, "PASSED").otherwise("FAILED")


def courant(step_s: Column, cell_m: Column, er: Column) -> Column:
    """Whether a time step is stable on cubic cells."""
    return F.when(step_s <= cell_m * F.sqrt(er) / (F.lit(299_792_458.0) * F.sqrt(F.lit(3.0))), "PASSED").otherwise("FAILED")


def layers(boards: DataFrame, key: str, required: Column, present: Column) -> DataFrame:
    """key, missing, extra, valid."""
    own = boards.select(key, F.array_sort(F.array_except(required, present)).alias("missing"), F.array_sort(F.array_except(present, required)).alias("extra"))
    return own.withColumn("valid", F.size("missing") == 0)


def ports(port_rows: DataFrame, key: str) -> DataFrame:
    """key, duplicate_ids, duplicate_indices, sequential: of (key, port_id, port_index), indices should be 1 to n."""
    own = port_rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("port_id").alias("ids"), F.count_distinct("port_index").alias("ix"), F.min("port_index").alias("lo"), F.max("port_index").alias("hi"))
    return own.select(key, (F.col("n") - F.col("ids")).alias("duplicate_ids"), (F.col("n") - F.col("ix")).alias("duplicate_indices"), ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("ix") == F.col("n"))).alias("sequential"))


def regression(baseline: DataFrame, current: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """case_id, metric, delta, blocking: of (case_id, metric, value); a case or metric on one side only blocks, as does a delta above its metric's threshold."""
    joined = baseline.withColumnRenamed("value", "b").join(current.withColumnRenamed("value", "c"), ["case_id", "metric"], "full_outer")
    limit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in thresholds.items()], F.lit(0.0))
    delta = F.abs(F.col("c") - F.col("b"))
    return joined.select("case_id", "metric", delta.alias("delta"), F.coalesce(delta > limit, F.lit(True)).alias("blocking"))


def resource_excess(jobs: DataFrame, budgets: Mapping[str, float], key: str) -> DataFrame:
    """key, resource, need, budget of jobs that need more than a budget."""
    cells = F.array(*[F.struct(F.lit(r).alias("resource"), F.col(r).cast("double").alias("need"), F.lit(float(b)).alias("budget")) for r, b in budgets.items()])
    return jobs.select(key, F.inline(cells)).where("need > budget")


def drc_tier(violations: DataFrame, by: str = "file") -> DataFrame:
    """Counts by severity, and the verdict: any error fails, any warning warns."""
    own = violations.groupBy(by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return own.withColumn("status", F.when(F.col("errors") > 0, "FAILED").when(F.col("warnings") > 0, "WARNING").otherwise("PASSED"))


def excitation_matrix(runs: DataFrame) -> DataFrame:
    """Full matrices from runs (network_id, excite, f_idx, freq_hz, i, re, im): the run that excites a port gives its column. Two runs of one port raise no error: the larger pair wins."""
    own = runs.groupBy("network_id", "f_idx", "freq_hz", "i", F.col("excite").alias("j")).agg(F.max(F.struct("re", "im")).alias("s"))
    return own.select("network_id", "f_idx", "freq_hz", "i", "j", "s.re", "s.im")


FACES = ("x_min", "x_max", "y_min", "y_max", "z_min", "z_max")


def absorbing_layers(frame: DataFrame, key: str) -> DataFrame:
    """key, status, layers: whether the absorbing boundaries of a set-up (f_max_hz and, for each face, its layers, null where it doesn't absorb) have layers enough for its band.

    Too few on any face fails; else the two port faces (x) must absorb, and fewer than recommended on any face warns.
    """
    band = F.when(F.col("f_max_hz") < 5e9, F.struct(F.lit(8).alias("least"), F.lit(8).alias("wanted"))).when(F.col("f_max_hz") <= 2e10, F.struct(F.lit(8).alias("least"), F.lit(16).alias("wanted"))).otherwise(F.struct(F.lit(16).alias("least"), F.lit(32).alias("wanted")))
    fewest = F.array_min(F.array(*FACES))
    status = F.when(fewest < F.col("_band.least"), "FAILED").when(F.col("x_min").isNull() | F.col("x_max").isNull() | (fewest < F.col("_band.wanted")), "WARNING").otherwise("PASSED")
    return frame.withColumn("_band", band).select(key, status.alias("status"), fewest.alias("layers"))


def set_up_checks(frame: DataFrame, key: str) -> DataFrame:
    """(key, check, status) of set-ups: absorbing layers, device settings (use_gpu, engine), excited ports (n_excited), the sweep (f_start_hz, f_max_hz)."""
    layers_ = absorbing_layers(frame, key).select(key, F.lit("absorbing_layers").alias("check"), "status")
    other = F.array(
        F.struct(F.lit("device").alias("check"), F.when(F.col("use_gpu") & ~F.col("engine").isin("basic", "multithreaded"), "WARNING").otherwise("PASSED").alias("status")),
        F.struct(F.lit("excitation").alias("check"), F.when(F.col("n_excited") > 0, "PASSED").otherwise("FAILED").alias("status")),
        F.struct(F.lit("sweep").alias("check"), F.when(F.col("f_start_hz") < F.col("f_max_hz"), "PASSED").otherwise("FAILED").alias("status")),
    )
    return layers_.union(frame.select(key, F.inline(other)))


def port_shapes(ports_: DataFrame, keys: list[str], tolerance_deg: float = 0.01, cells: float = 1.0) -> DataFrame:
    """Ports (keys, rotation_deg, width, length, mesh_cell; signal_width and gap may be null) with cardinal, shorted and long_enough: turned by a multiple of 90 degrees; gap not positive, or signal and gaps wider than the port; at least so many mesh cells long."""
    turn = F.pmod(F.col("rotation_deg"), F.lit(90.0))
    wide = (F.col("gap") <= 0) | (F.col("signal_width") > F.col("width")) | (F.col("signal_width") + 2 * F.col("gap") > F.col("width"))
    return ports_.select(*keys, (F.least(turn, 90.0 - turn) <= tolerance_deg).alias("cardinal"), F.coalesce(wide, F.lit(False)).alias("shorted"), (F.col("length") >= cells * F.col("mesh_cell")).alias("long_enough"))


def port_overlaps(ports_: DataFrame, key: str, port: str, longest: int) -> DataFrame:
    """Pairs (key, a, b) of a design's ports whose boxes (x, y, z as centres; length, width, height) overlap; boxes that only touch don't. Ports meet in strips as wide as the longest."""
    strip = F.floor(F.col("x") / longest)
    a = ports_.withColumn("_strip", strip).select(key, "_strip", F.col(port).alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "z", "length", "width", "height")])
    b = ports_.withColumn("_strip", F.explode(F.array(strip - 1, strip, strip + 1))).select(key, "_strip", F.col(port).alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "z", "length", "width", "height")])
    near = [2 * F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) < F.col(f"a_{size}") + F.col(f"b_{size}") for at, size in (("x", "length"), ("y", "width"), ("z", "height"))]
    return a.join(b, [key, "_strip"]).where(F.col("a") < F.col("b")).where(near[0] & near[1] & near[2]).select(key, "a", "b")

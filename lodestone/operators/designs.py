"""Designs: identity, parameters of candidates, the short evaluator, connectivity of nets, simulation limits, refinement."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import base32_prefix
from lodestone.operators.connectivity import links
from lodestone.operators.lineage import components
from lodestone.operators.proofs import at_least, evaluate
from lodestone.operators.rules import SPACE, physical, vectors


def canonical_json(parameters: Column) -> Column:
    """A map of names to whole numbers as JSON with sorted names and no spaces; null values stay out."""
    entries = F.array_sort(F.filter(F.map_entries(parameters), lambda e: e["value"].isNotNull()))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))


def design_ids(frame: DataFrame, key: str, parameters: Column) -> DataFrame:
    """key, design_hash (SHA-256 of the canonical parameters), short_id (twelve letters of base32)."""
    own = frame.select(key, F.sha2(canonical_json(parameters), 256).alias("design_hash"))
    return own.withColumn("short_id", base32_prefix(F.col("design_hash")))


def resolve_candidates(frame: DataFrame, u: str = "u", key: str = "cand_id") -> DataFrame:
    """Vectors as whole-number parameters: key and a map of names to nanometres."""
    own = vectors(frame, u)
    return own.select(key, F.create_map(*[x for n, _, _ in SPACE for x in (F.lit(n), F.round(F.expr(physical(n)), 0).cast("bigint"))]).alias("parameters"))


def select_feasible(filtered: DataFrame, limit: int | None = None, key: str = "cand_id") -> DataFrame:
    """Feasible candidates by key, at most limit of them if asked."""
    own = filtered.where("feasible").orderBy(key)
    return own.limit(limit) if limit is not None else own


def short_evaluation(frame: DataFrame, key: str) -> DataFrame:
    """Four checks of documents (w, gap, drill, pad and limits as columns). Known behaviour, kept: the ring isn't halved here."""
    col = F.col
    return evaluate(frame, key, [
        at_least("T0_TRACE_WIDTH_MIN", "T0", col("w"), col("min_trace_width")),
        at_least("T0_TRACE_GAP_MIN", "T0", col("gap"), col("min_gap")),
        at_least("T0_SIGNAL_DRILL_MIN", "T0", col("drill"), col("min_drill")),
        at_least("T1_SIGNAL_ANNULAR_MIN", "T1", col("pad") - col("drill"), col("min_annular_ring")),
    ])


def net_connectivity(points: DataFrame, ports: DataFrame, largest_radius: int) -> DataFrame:
    """net, connected: whether the ports (net, left_id, right_id) of a net lie in one component of its touching shapes (id, net, x, y, r)."""
    groups = components(links(points, largest_radius), points)
    left = groups.select(F.col("id").alias("left_id"), F.col("component").alias("a"))
    right = groups.select(F.col("id").alias("right_id"), F.col("component").alias("b"))
    joined = ports.join(left, "left_id", "left").join(right, "right_id", "left")
    return joined.select("net", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("connected"))


def time_step_limit_ps(cell_nm: Column, er: Column, courant: float = 0.5) -> Column:
    """Largest stable step on cubic cells, times a safety factor, in picoseconds."""
    return cell_nm * 1e-9 / (F.lit(299_792_458.0) / F.sqrt(er) * F.sqrt(F.lit(3.0))) * courant * 1e12


def sampling_check(step_ps: Column, f_max_hz: Column, wanted: float = 10.0, least: float = 2.0) -> tuple[Column, Column]:
    """Sampling rate over the highest frequency, and its verdict."""
    ratio = F.try_divide(F.lit(1.0), step_ps * 1e-12 * f_max_hz)
    return ratio, F.when(ratio >= wanted, "PASSED").when(ratio >= least, "WARNING").otherwise("FAILED")


def mean_step(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean difference of consecutive values of each series."""
    w = Window.partitionBy(by).orderBy(order)
    return series.select(by, (F.col(value) - F.lag(value).over(w)).alias("d")).groupBy(by).agg(F.avg("d").alias("mean_step"))


def via_zones(frame: DataFrame, key: str) -> DataFrame:
    """key, axis, center, radius: refinement around a via (columns length_left, drill, via, pad); none where there is no via."""
    radius = F.greatest(F.floor(F.col("pad") / 2), F.floor(F.col("via") / 2)) + F.col("drill")
    zones = F.array(F.struct(F.lit("x").alias("axis"), F.col("length_left").alias("center")), F.struct(F.lit("y").alias("axis"), F.lit(0).cast("bigint").alias("center")))
    return frame.where("pad IS NOT NULL").select(key, radius.cast("bigint").alias("radius"), F.inline(zones)).select(key, "axis", "center", "radius")


def antipad_zones(layers: DataFrame, key: str) -> DataFrame:
    """key, axis, center, radius: refinement around the cutouts (key, length_left, radius) of inner layers; none where a radius isn't above 0."""
    zones = F.array(F.struct(F.lit("x").alias("axis"), F.col("length_left").alias("center")), F.struct(F.lit("y").alias("axis"), F.lit(0).cast("bigint").alias("center")))
    return layers.where("radius > 0").select(key, "radius", F.inline(zones)).select(key, "axis", "center", "radius")


def trace_zones(frame: DataFrame, key: str) -> DataFrame:
    """key, axis, center, radius: refinement at both edges of a trace (columns w, gap) and at both outer edges of its gaps (two of the column trace_cell)."""
    half, outer = F.floor(F.col("w") / 2), F.floor(F.col("w") / 2) + F.col("gap")
    cell = lambda at, radius: F.struct(at.cast("bigint").alias("center"), radius.cast("bigint").alias("radius"))
    zones = F.array(*[cell(s * half, F.floor(F.col("gap") / 2)) for s in (1, -1)], *[cell(s * outer, 2 * F.col("trace_cell")) for s in (1, -1)])
    return frame.select(key, F.lit("y").alias("axis"), F.inline(zones))


def network_hashes(long: DataFrame, z0: float = 50.0) -> DataFrame:
    """network_id and SHA-256 of the canonical JSON of its matrices, numbers rounded to 12 digits; the text of numbers is Python's."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["f_idx", "i", "j"])
        n = int(own["i"].max())
        cells = [[round(a, 12), round(b, 12)] for a, b in zip(own["re"].tolist(), own["im"].tolist(), strict=True)]
        rows = [cells[k : k + n] for k in range(0, len(cells), n)]
        payload = {"n_ports": n, "reference_impedance_ohm": z0, "frequencies_hz": [round(f, 12) for f in own["freq_hz"].tolist()[:: n * n]], "s_parameters": [rows[k : k + n] for k in range(0, len(rows), n)]}
        return pd.DataFrame({"network_id": [key[0]], "network_hash": [hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()]})

    return long.groupBy("network_id").applyInPandas(run, "network_id string, network_hash string")

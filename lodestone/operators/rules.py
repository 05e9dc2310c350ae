"""Tiered design rules over batches of candidates: mapping, checks, repair, reports.

Rules are expressions over parameter and limit names, so the same text serves any engine; margins below zero are
violations. A candidate is a vector of numbers in [0, 1], one for each parameter of the space.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.session import dealt

#: Parameters in vector order, with the ends of their linear ranges (nanometres).
SPACE = (
    ("trace_width", 100_000, 500_000),
    ("trace_gap", 100_000, 300_000),
    ("board_width", 10_000_000, 50_000_000),
    ("board_length", 30_000_000, 150_000_000),
    ("corner_radius", 0, 5_000_000),
    ("signal_drill", 200_000, 500_000),
    ("signal_via", 300_000, 800_000),
    ("signal_pad", 400_000, 1_200_000),
    ("return_drill", 200_000, 500_000),
    ("return_via", 300_000, 800_000),
    ("fence_drill", 200_000, 400_000),
    ("fence_via", 300_000, 700_000),
    ("left_x", 2_000_000, 10_000_000),
    ("right_x", 70_000_000, 145_000_000),
    ("length_left", 5_000_000, 50_000_000),
    ("length_right", 5_000_000, 50_000_000),
    ("ring_radius", 800_000, 3_000_000),
    ("fence_pitch", 500_000, 3_000_000),
    ("fence_offset", 200_000, 1_500_000),
)
#: Default limits (nanometres).
LIMITS = {
    "min_trace_width": 100_000,
    "min_gap": 100_000,
    "min_drill": 200_000,
    "min_via_diameter": 300_000,
    "min_annular_ring": 100_000,
    "min_edge_clearance": 200_000,
    "min_via_to_via": 200_000,
    "min_board_width": 5_000_000,
}
#: Fixed values: (tier, rule, margin, parameter raised to repair it, what it is raised to); {..} are limits.
RULES = (
    ("T0", "T0_TRACE_WIDTH_MIN", "trace_width - {min_trace_width}", "trace_width", "{min_trace_width}"),
    ("T0", "T0_TRACE_GAP_MIN", "trace_gap - {min_gap}", "trace_gap", "{min_gap}"),
    ("T0", "T0_BOARD_WIDTH_MIN", "board_width - {min_board_width}", "board_width", "{min_board_width}"),
    ("T0", "T0_BOARD_LENGTH_MIN", "board_length - {min_board_width}", "board_length", "{min_board_width}"),
    ("T0", "T0_CORNER_RADIUS_MIN", "corner_radius", "corner_radius", None),
    ("T0", "T0_CORNER_RADIUS_MAX", "least(board_width, board_length) / 2 - corner_radius", None, None),
    ("T0", "T0_SIGNAL_DRILL_MIN", "signal_drill - {min_drill}", "signal_drill", "{min_drill}"),
    ("T0", "T0_SIGNAL_VIA_DIAMETER_MIN", "signal_via - {min_via_diameter}", "signal_via", "{min_via_diameter}"),
    ("T0", "T0_SIGNAL_PAD_DIAMETER_MIN", "signal_pad - {min_via_diameter}", "signal_pad", "{min_via_diameter}"),
    ("T0", "T0_RETURN_VIA_DRILL_MIN", "return_drill - {min_drill}", "return_drill", "{min_drill}"),
    ("T0", "T0_RETURN_VIA_DIAMETER_MIN", "return_via - {min_via_diameter}", "return_via", "{min_via_diameter}"),
    ("T0", "T0_FENCE_VIA_DRILL_MIN", "fence_drill - {min_drill}", "fence_drill", "{min_drill}"),
    ("T0", "T0_FENCE_VIA_DIAMETER_MIN", "fence_via - {min_via_diameter}", "fence_via", "{min_via_diameter}"),
    ("T1", "T1_SIGNAL_VIA_DIAMETER_GT_DRILL", "signal_via - signal_drill", None, None),
    ("T1", "T1_SIGNAL_PAD_GT_VIA", "signal_pad - signal_via", None, None),
    ("T1", "T1_SIGNAL_ANNULAR_MIN", "(signal_pad - signal_drill) / 2 - {min_annular_ring}", "signal_pad", "signal_drill + 2 * {min_annular_ring}"),
    ("T1", "T1_RETURN_ANNULAR_MIN", "(return_via - return_drill) / 2 - {min_annular_ring}", "return_via", "return_drill + 2 * {min_annular_ring}"),
    ("T1", "T1_FENCE_ANNULAR_MIN", "(fence_via - fence_drill) / 2 - {min_annular_ring}", "fence_via", "fence_drill + 2 * {min_annular_ring}"),
    ("T1", "T1_TRACE_LEFT_POSITIVE", "length_left - 1", None, None),
    ("T1", "T1_TRACE_RIGHT_POSITIVE", "length_right - 1", None, None),
    ("T1", "T1_BOARD_ASPECT_RATIO_MAX", "20 - greatest(board_width, board_length) / greatest(least(board_width, board_length), 1)", None, None),
    ("T2", "T2_LEFT_CONNECTOR_X_MIN", "left_x - {min_edge_clearance}", "left_x", "{min_edge_clearance}"),
    ("T2", "T2_LEFT_CONNECTOR_X_MAX", "board_length - {min_edge_clearance} - left_x", None, None),
    ("T2", "T2_RIGHT_CONNECTOR_X_MIN", "right_x - {min_edge_clearance}", "right_x", "{min_edge_clearance}"),
    ("T2", "T2_RIGHT_CONNECTOR_X_MAX", "board_length - {min_edge_clearance} - right_x", None, None),
    ("T2", "T2_TRACE_FITS_IN_BOARD", "(right_x - left_x) - (length_left + length_right)", None, None),
    ("T2", "T2_RETURN_VIA_RING_RADIUS", "ring_radius - (signal_pad / 2 + return_via / 2 + {min_via_to_via})", "ring_radius", "signal_pad / 2 + return_via / 2 + {min_via_to_via}"),
    ("T2", "T2_FENCE_VIA_GAP_CLEARANCE", "fence_offset - fence_via / 2", "fence_offset", "fence_via / 2"),
    ("T2", "T2_FENCE_PITCH_MIN", "fence_pitch - (fence_via + {min_via_to_via})", "fence_pitch", "fence_via + {min_via_to_via}"),
)
STRICT = "T1_SIGNAL_VIA_DIAMETER_GT_DRILL"  # passes above zero only
ROUNDS = 3


def _double(x: float) -> str:
    return f"{x:.1f}E0"


def physical(name: str) -> str:
    """The value of a parameter from its number u_<name>."""
    low, high = next((a, b) for n, a, b in SPACE if n == name)
    return f"({_double(low)} + u_{name} * ({_double(high)} - {_double(low)}))"


def number(name: str, value: str) -> str:
    """The number of a value."""
    low, high = next((a, b) for n, a, b in SPACE if n == name)
    return f"(({value} - {_double(low)}) / {_double(max(high - low, 1e-10))})"


def margin(text: str, limits: Mapping[str, float]) -> str:
    return text.format(**{k: _double(v) for k, v in limits.items()})


def passes(rule: str, column: str) -> str:
    return f"{column} > 0" if rule == STRICT else f"{column} >= 0"


def steps(limits: Mapping[str, float] = LIMITS, rounds: int = ROUNDS) -> list[dict[str, str]]:
    """The batch filter as successive projections (name to expression); each sees the columns before it.

    Counts and margins (m_*) are those of the input. Every round repairs the first tier by its margins, the second by
    the margins left from before, the third by those of the input, with parameters worked out anew in between.
    """
    names = [n for n, _, _ in SPACE]
    params = {n: physical(n) for n in names}
    tier = lambda t: [r for r in RULES if r[0] == t]
    margins = lambda t, prefix: {f"{prefix}{r[1]}": margin(r[2], limits) for r in tier(t)}

    def repair(t: str, prefix: str) -> tuple[dict[str, str], str]:
        raised: dict[str, str] = {}
        for _, rule, _, name, target in tier(t):
            if name:
                old = raised.get(f"u_{name}", f"u_{name}")
                new = f"greatest({old}, {number(name, margin(target, limits))})" if target else "0.0E0"
                raised[f"u_{name}"] = f"CASE WHEN {prefix}{rule} < 0 THEN {new} ELSE {old} END"
        count = " + ".join(f"CASE WHEN {prefix}{r[1]} < 0 THEN 1 ELSE 0 END" for r in tier(t) if r[3])
        return raised, count

    out = [params, margins("T0", "m_") | margins("T1", "m_") | margins("T2", "m_")]
    counts = {f"violations_{t.lower()}": " + ".join(f"CASE WHEN m_{r[1]} < 0 THEN 1 ELSE 0 END" for r in tier(t)) for t in ("T0", "T1", "T2")}
    out.append(counts | {"feasible_before": " AND ".join(passes(r[1], f"m_{r[1]}") for r in RULES)} | {f"o_{n}": f"u_{n}" for n in names} | {"repairs": "0"} | {f"c_{r[1]}": f"m_{r[1]}" for r in tier("T0") + tier("T1")})
    for _ in range(rounds):
        for t, prefix in (("T0", "c_"), ("T1", "c_"), ("T2", "m_")):
            raised, count = repair(t, prefix)
            out.append(raised | {"repairs": f"repairs + {count}"})
            out.append(params)
            if t != "T2":
                out.append(margins(t, "c_"))
    out.append({"distance": "sqrt(" + " + ".join(f"(u_{n} - o_{n}) * (u_{n} - o_{n})" for n in names) + ")", "feasible": " AND ".join(passes(r[1], f"({margin(r[2], limits)})") for r in RULES)})
    return out


def vectors(frame: DataFrame, u: str = "u") -> DataFrame:
    """One column u_<name> for each number of the vector."""
    return frame.select("*", *[F.col(u)[i].alias(f"u_{n}") for i, (n, _, _) in enumerate(SPACE)])


def batch_filter(frame: DataFrame, limits: Mapping[str, float] = LIMITS, repair: bool = True, u: str = "u", key: str = "cand_id") -> DataFrame:
    """key, feasible, u_repaired, repairs, distance, violations_t0..t2. Rows stand alone: a row's repairs don't depend on its batch."""
    own = vectors(frame, u)
    for step in steps(limits, ROUNDS if repair else 0):
        own = own.withColumns({name: F.expr(text) for name, text in step.items()})
    return own.select(key, "feasible", F.array(*[F.col(f"u_{n}") for n, _, _ in SPACE]).alias("u_repaired"), "repairs", "distance", "violations_t0", "violations_t1", "violations_t2", "feasible_before")


def results(frame: DataFrame, limits: Mapping[str, float] = LIMITS, u: str = "u", key: str = "cand_id") -> DataFrame:
    """Long form: key, tier, constraint_id, margin, passed."""
    own = vectors(frame, u).withColumns({n: F.expr(physical(n)) for n, _, _ in SPACE})
    cells = [F.struct(F.lit(t).alias("tier"), F.lit(r).alias("constraint_id"), F.lit(i).alias("ordinal"), F.expr(margin(m, limits)).cast("double").alias("margin")) for i, (t, r, m, _, _) in enumerate(RULES)]
    long = own.select(key, F.inline(F.array(*cells)))
    return long.withColumn("passed", F.when(F.col("constraint_id") == STRICT, F.col("margin") > 0).otherwise(F.col("margin") >= 0))


def first_failing_tier(long: DataFrame, key: str = "cand_id") -> DataFrame:
    """key and the first tier with a failure, null where all pass."""
    return long.groupBy(key).agg(F.min(F.when(~F.col("passed"), F.col("tier"))).alias("first_failing_tier"))


def fail_fast(long: DataFrame, key: str = "cand_id") -> DataFrame:
    """Results up to the first failing tier; later tiers aren't reported."""
    first = F.min(F.when(~F.col("passed"), F.col("tier"))).over(Window.partitionBy(key))
    return long.withColumn("_first", first).where("_first IS NULL OR tier <= _first").drop("_first")


def summary(long: DataFrame, by: str = "tier") -> DataFrame:
    """Of each category: n_failed, n_passed, mean margin, the smallest margin and the rule that has it (the first on ties)."""
    return long.groupBy(by).agg(
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.count_if("passed").alias("n_passed"),
        F.avg("margin").alias("mean_margin"),
        F.min("margin").alias("min_margin"),
        F.min_by("constraint_id", F.struct("margin", "ordinal")).alias("tightest"),
    )


def repair_distances(before: str = "u", after: str = "u_repaired") -> dict[str, object]:
    """Sum of changes, L2 and largest change between two vectors."""
    change = F.zip_with(before, after, lambda a, b: F.abs(b - a))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return {"l1": total(change), "l2": F.sqrt(total(F.transform(change, lambda v: v * v))), "linf": F.array_max(change)}


#: Checks of whole documents (integers, halves rounded down) that batches don't have: (rule, margin); names are columns.
DOCUMENT_RULES = (
    ("T0_TRACE_WIDTH_MIN", "trace_width - min_trace_width"),
    ("T0_TRACE_GAP_MIN", "trace_gap - min_gap"),
    ("T0_BOARD_WIDTH_MIN", "board_width - min_board_width"),
    ("T0_BOARD_LENGTH_MIN", "board_length - min_board_width"),
    ("T0_CORNER_RADIUS_MIN", "corner_radius"),
    ("T0_CORNER_RADIUS_MAX", "floor(least(board_width, board_length) / 2) - corner_radius"),
    ("T0_SIGNAL_DRILL_MIN", "signal_drill - min_drill"),
    ("T0_SIGNAL_VIA_DIAMETER_MIN", "signal_via - min_via_diameter"),
    ("T0_SIGNAL_PAD_DIAMETER_MIN", "signal_pad - min_via_diameter"),
    ("T0_RETURN_VIA_DRILL_MIN", "return_drill - min_drill"),
    ("T0_RETURN_VIA_DIAMETER_MIN", "return_via - min_via_diameter"),
    ("T0_FENCE_VIA_DRILL_MIN", "fence_drill - min_drill"),
    ("T0_FENCE_VIA_DIAMETER_MIN", "fence_via - min_via_diameter"),
    ("T1_SIGNAL_ANNULAR_MIN", "floor((signal_pad - signal_drill) / 2) - min_annular_ring"),
    ("T1_SIGNAL_VIA_DIAMETER_GT_DRILL", "signal_via - signal_drill - 1"),
    ("T1_SIGNAL_PAD_GT_VIA", "signal_pad - signal_via"),
    ("T1_RETURN_ANNULAR_MIN", "floor((return_via - return_drill) / 2) - min_annular_ring"),
    ("T1_FENCE_ANNULAR_MIN", "floor((fence_via - fence_drill) / 2) - min_annular_ring"),
    ("T1_TRACE_LEFT_POSITIVE", "length_left - 1"),
    ("T1_TRACE_RIGHT_POSITIVE", "length_right - 1"),
    ("T1_F1_CONTINUITY_LENGTH_ERROR", "-abs(length_right - (right_x - left_x - length_left))"),
    ("T1_BOARD_ASPECT_RATIO_MAX", "20 - CAST(greatest(board_width, board_length) AS DOUBLE) / greatest(least(board_width, board_length), 1)"),
    ("T1_COPPER_TO_EDGE_CLEARANCE", "floor(board_width / 2) - (floor(trace_width / 2) + trace_gap + coalesce(fence_offset + floor(fence_via / 2), 0)) - min_edge_clearance"),
    ("T1_FENCE_PITCH_MIN", "fence_pitch - (fence_via + min_via_to_via)"),
    ("T2_LEFT_CONNECTOR_X_MIN", "left_x - min_edge_clearance"),
    ("T2_LEFT_CONNECTOR_X_MAX", "board_length - min_edge_clearance - left_x"),
    ("T2_RIGHT_CONNECTOR_X_MIN", "right_x - min_edge_clearance"),
    ("T2_RIGHT_CONNECTOR_X_MAX", "board_length - min_edge_clearance - right_x"),
    ("T2_LEFT_CONNECTOR_Y_CENTERED", "floor(board_width / 2) - abs(left_y)"),
    ("T2_RIGHT_CONNECTOR_Y_CENTERED", "floor(board_width / 2) - abs(right_y)"),
    ("T2_TRACE_FITS_IN_BOARD", "right_x - left_x - length_left - coalesce(length_right, right_x - left_x - length_left)"),
    ("T2_RETURN_VIA_RING_RADIUS", "ring_radius - (floor(signal_pad / 2) + floor(return_via / 2) + min_via_to_via)"),
    ("T2_FENCE_VIA_GAP_CLEARANCE", "fence_offset - floor(fence_via / 2)"),
    ("T2_FENCE_PITCH_MIN", "fence_pitch - (fence_via + min_via_to_via)"),
    ("T3_RETURN_VIA_RING_NO_OVERLAP", "2 * ring_radius * sin(pi() / return_count) - (return_via + min_via_to_via)"),
    ("T3_RETURN_VIA_SIGNAL_CLEARANCE", "ring_radius - (floor(signal_pad / 2) + floor(return_via / 2)) - min_via_to_via"),
    ("T3_FENCE_VIA_CPWG_GAP_CLEARANCE", "fence_offset - floor(fence_via / 2)"),
    ("T3_FENCE_VIA_TRACE_CLEARANCE", "trace_gap + fence_offset - floor(fence_via / 2) - min_gap"),
    ("T3_TRACE_COPPER_TO_EDGE_Y", "floor(board_width / 2) - floor(trace_width / 2) - min_edge_clearance"),
    ("T3_CPWG_COPPER_TO_EDGE_Y", "floor(board_width / 2) - (floor(trace_width / 2) + trace_gap) - min_edge_clearance"),
    ("T3_LEFT_CONNECTOR_COPPER_TO_EDGE", "left_x - min_edge_clearance"),
    ("T3_RIGHT_CONNECTOR_COPPER_TO_EDGE", "board_length - right_x - min_edge_clearance"),
    ("T3_VIA_COPPER_TO_LEFT_EDGE", "left_x + length_left - floor(signal_pad / 2) - min_edge_clearance"),
    ("T3_VIA_COPPER_TO_RIGHT_EDGE", "board_length - (left_x + length_left + floor(signal_pad / 2)) - min_edge_clearance"),
    ("T3_RETURN_VIA_COPPER_TO_EDGE_X", "least(left_x + length_left, board_length - left_x - length_left) - (ring_radius + floor(return_via / 2)) - min_edge_clearance"),
    ("T3_RETURN_VIA_COPPER_TO_EDGE_Y", "floor(board_width / 2) - (ring_radius + floor(return_via / 2)) - min_edge_clearance"),
    ("T3_LEFT_CONNECTOR_CORNER_KEEPOUT", "CASE WHEN left_x < corner_radius AND abs(left_y) > floor(board_width / 2) - corner_radius THEN -1 ELSE 0 END"),
    ("T3_RIGHT_CONNECTOR_CORNER_KEEPOUT", "CASE WHEN board_length - right_x < corner_radius AND abs(right_y) > floor(board_width / 2) - corner_radius THEN -1 ELSE 0 END"),
    ("T3_TRACE_SYMMETRY", "-abs(length_left - length_right)"),
    ("T3_CONNECTOR_Y_SYMMETRY", "-abs(left_y - right_y)"),
)


#: Documents that a task checks, about: each gives a row for each rule.
DEAL = 50_000


def document_results(frame: DataFrame, key: str) -> DataFrame:
    """Long form of the document checks over columns of their names: key, constraint_id, margin, passed. A null in any of a rule's columns leaves that rule out."""
    cells = [F.struct(F.lit(r).alias("constraint_id"), F.expr(m).cast("double").alias("margin")) for r, m in DOCUMENT_RULES]
    return dealt(frame, key, DEAL).select(key, F.inline(F.array(*cells))).where("margin IS NOT NULL").withColumn("passed", F.col("margin") >= 0)


_EDGE = "2 * (floor(trace_width / 2) + trace_gap + coalesce(fence_offset + floor(fence_via / 2), 0) + min_edge_clearance)"
_RING = "floor(signal_pad / 2) + floor(return_via / 2) + min_via_to_via"
_PAST_PAD = "left_x + length_left + floor(signal_pad / 2) + min_edge_clearance"
_PAST_RING = "left_x + length_left + greatest(floor(signal_pad / 2), ring_radius + floor(return_via / 2)) + min_edge_clearance"
#: Repairs of documents, in order: (constraint, when, column, new value). A part that is absent (null) is left alone.
DOCUMENT_REPAIRS = (
    ("T0_TRACE_WIDTH_MIN", "trace_width < min_trace_width", "trace_width", "min_trace_width"),
    ("T0_TRACE_GAP_MIN", "trace_gap < min_gap", "trace_gap", "min_gap"),
    ("T0_BOARD_WIDTH_MIN", "board_width < min_board_width", "board_width", "min_board_width"),
    ("T0_BOARD_LENGTH_MIN", "board_length < min_board_width", "board_length", "min_board_width"),
    ("T0_CORNER_RADIUS_MIN", "corner_radius < 0", "corner_radius", "0"),
    ("T0_CORNER_RADIUS_MAX", "corner_radius > floor(least(board_width, board_length) / 2)", "corner_radius", "floor(least(board_width, board_length) / 2)"),
    ("T0_SIGNAL_DRILL_MIN", "signal_drill < min_drill", "signal_drill", "min_drill"),
    ("T0_SIGNAL_VIA_DIAMETER_MIN", "signal_via < min_via_diameter", "signal_via", "min_via_diameter"),
    ("T0_SIGNAL_PAD_DIAMETER_MIN", "signal_pad < min_via_diameter", "signal_pad", "min_via_diameter"),
    ("T0_RETURN_VIA_DRILL_MIN", "return_drill < min_drill", "return_drill", "min_drill"),
    ("T0_RETURN_VIA_DIAMETER_MIN", "return_via < min_via_diameter", "return_via", "min_via_diameter"),
    ("T0_FENCE_VIA_DRILL_MIN", "fence_drill < min_drill", "fence_drill", "min_drill"),
    ("T0_FENCE_VIA_DIAMETER_MIN", "fence_via < min_via_diameter", "fence_via", "min_via_diameter"),
    ("T1_SIGNAL_VIA_DIAMETER_GT_DRILL", "signal_via <= signal_drill", "signal_via", "signal_drill + min_annular_ring"),
    ("T1_SIGNAL_ANNULAR_MIN", "signal_pad < signal_via + 2 * min_annular_ring", "signal_pad", "signal_via + 2 * min_annular_ring"),
    ("T1_RETURN_ANNULAR_MIN", "return_via < return_drill + 2 * min_annular_ring", "return_via", "return_drill + 2 * min_annular_ring"),
    ("T1_FENCE_ANNULAR_MIN", "fence_via < fence_drill + 2 * min_annular_ring", "fence_via", "fence_drill + 2 * min_annular_ring"),
    ("T1_TRACE_LEFT_POSITIVE", "length_left < 1", "length_left", "1"),
    ("T1_TRACE_RIGHT_POSITIVE", "length_right < 1", "length_right", "1"),
    ("T1_FENCE_PITCH_MIN", "fence_pitch < fence_via + min_via_to_via", "fence_pitch", "fence_via + min_via_to_via"),
    ("T1_COPPER_TO_EDGE_CLEARANCE", f"board_width < {_EDGE}", "board_width", _EDGE),
    ("T2_LEFT_CONNECTOR_X_MIN", "left_x < min_edge_clearance", "left_x", "min_edge_clearance"),
    ("T2_LEFT_CONNECTOR_X_MAX", "left_x > board_length - min_edge_clearance", "left_x", "board_length - min_edge_clearance"),
    ("T2_RIGHT_CONNECTOR_X_MIN", "right_x < min_edge_clearance", "right_x", "min_edge_clearance"),
    ("T2_RIGHT_CONNECTOR_X_MAX", "right_x > board_length - min_edge_clearance", "right_x", "board_length - min_edge_clearance"),
    ("T2_RETURN_VIA_RING_RADIUS", f"ring_radius < {_RING}", "ring_radius", _RING),
    ("T3_VIA_COPPER_TO_RIGHT_EDGE", f"ring_radius IS NULL AND board_length < {_PAST_PAD}", "board_length", _PAST_PAD),
    ("T3_RETURN_VIA_COPPER_TO_EDGE_X", f"ring_radius IS NOT NULL AND signal_pad IS NOT NULL AND board_length < {_PAST_RING}", "board_length", _PAST_RING),
    ("T2_FENCE_VIA_GAP_CLEARANCE", "fence_offset < floor(fence_via / 2)", "fence_offset", "floor(fence_via / 2)"),
    ("T2_FENCE_PITCH_MIN", "fence_pitch < fence_via + min_via_to_via", "fence_pitch", "fence_via + min_via_to_via"),
    ("F1_CONTINUITY_LENGTH_LEFT", "signal_drill IS NOT NULL AND right_x - left_x - length_left < 1 AND length_left > greatest(right_x - left_x - 1, 1)", "length_left", "greatest(right_x - left_x - 1, 1)"),
    ("F1_CONTINUITY_LENGTH_RIGHT", "signal_drill IS NOT NULL AND coalesce(length_right, 0) <> greatest(right_x - left_x - length_left, 1)", "length_right", "greatest(right_x - left_x - length_left, 1)"),
)


def document_repair(frame: DataFrame) -> DataFrame:
    """Applies the repairs one after the other, each on what those before it left; adds actions, the log of those that took effect: (constraint_id, parameter, before, after)."""
    own = frame.withColumn("actions", F.array().cast("array<struct<constraint_id:string,parameter:string,before:bigint,after:bigint>>"))
    for rule, when, column, value in DOCUMENT_REPAIRS:
        hit, new = F.coalesce(F.expr(when), F.lit(False)), F.expr(value).cast("bigint")
        action = F.struct(F.lit(rule).alias("constraint_id"), F.lit(column).alias("parameter"), F.col(column).alias("before"), new.alias("after"))
        own = own.withColumns({column: F.when(hit, new).otherwise(F.col(column)), "actions": F.when(hit, F.concat("actions", F.array(action))).otherwise(F.col("actions"))})
    return own


def action_distances(actions: str = "actions") -> dict[str, Column]:
    """Of a log of repairs: the sum of relative changes (of the value before, or 1 where that is 0), L2 and the largest change."""
    change = F.transform(actions, lambda a: F.abs(a["after"] - F.coalesce(a["before"], F.lit(0))).cast("double"))
    share = F.transform(actions, lambda a: F.abs(a["after"] - F.coalesce(a["before"], F.lit(0))).cast("double") / F.greatest(F.abs(F.coalesce(a["before"], F.lit(0))), F.lit(1)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return {"relative": total(share), "l2": F.sqrt(total(F.transform(change, lambda v: v * v))), "linf": F.coalesce(F.array_max(change), F.lit(0.0))}

"""Derived features and dimensionless groups of board specifications, as expressions over columns.

Columns: w, gap, h (substrate height, may be null), board_width, board_length, length_left, length_right (may be null),
left_x, left_y, right_x, right_y, and, null where a part is absent: drill, via, pad; ring_radius, return_count,
return_drill, return_via; fence_pitch, fence_offset, fence_drill, fence_via; er, loss_tangent, total_thickness, copper_layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TRACE = "(length_left + coalesce(length_right, 0))"
#: Integer features.
FEATURES = {
    "board_area_nm2": "board_width * board_length",
    "board_perimeter_nm": "2 * (board_width + board_length)",
    "cpwg_ground_opening_nm": "w + 2 * gap",
    "cpwg_footprint_width_nm": "w + 2 * gap",
    "trace_total_length_nm": _TRACE,
    "fence_via_offset_from_center_nm": "CAST(floor(w / 2) AS BIGINT) + gap + fence_offset",
    "fence_via_annular_ring_nm": "fence_via - fence_drill",
    "fence_via_count_per_side": f"CASE WHEN fence_pitch > 0 THEN greatest(1, CAST(floor({_TRACE} / fence_pitch) AS BIGINT)) END",
    "signal_via_annular_ring_nm": "pad - drill",
    "signal_via_barrel_annular_nm": "via - drill",
    "return_via_annular_ring_nm": "return_via - return_drill",
    "connector_span_nm": "abs(right_x - left_x)",
    "launch_left_edge_clearance_nm": "left_x",
    "launch_right_edge_clearance_nm": "board_length - right_x",
    "launch_edge_symmetry_error_nm": "abs(left_x - (board_length - right_x))",
    "launch_left_y_offset_nm": "abs(left_y - CAST(floor(board_width / 2) AS BIGINT))",
    "launch_right_y_offset_nm": "abs(right_y - CAST(floor(board_width / 2) AS BIGINT))",
}
#: Ratios, 0 where the denominator is 0 and null where a part is absent: name to (numerator, denominator).
RATIOS = {
    "cpwg_gap_over_w": ("gap", "w"),
    "cpwg_w_over_gap": ("w", "gap"),
    "cpwg_k_ratio": ("w", "w + 2 * gap"),
    "board_aspect_ratio": ("board_length", "board_width"),
    "cpwg_w_over_h": ("w", "h"),
    "cpwg_gap_over_h": ("gap", "h"),
    "cpwg_ground_opening_over_h": ("w + 2 * gap", "h"),
    "cpwg_2h_over_a": ("2 * h", "w + 2 * gap"),
    "cpwg_h_over_w": ("h", "w"),
    "via_drill_over_pad": ("drill", "pad"),
    "via_pad_over_drill": ("pad", "drill"),
    "via_diameter_over_drill": ("via", "drill"),
    "via_pad_over_trace_w": ("pad", "w"),
    "via_drill_over_trace_w": ("drill", "w"),
    "via_pad_over_cpwg_opening": ("pad", "w + 2 * gap"),
    "via_annular_ring_ratio": ("pad - drill", "pad"),
    "via_barrel_aspect": ("h", "via"),
    "via_drill_over_h": ("drill", "h"),
    "via_return_radius_over_pad": ("ring_radius", "pad"),
    "via_return_radius_over_drill": ("ring_radius", "drill"),
    "via_return_drill_over_diam": ("return_drill", "return_via"),
    "via_return_spacing_over_diameter": ("2 * pi() * ring_radius / return_count", "return_via"),
    "via_return_count_fill_ratio": ("return_count * return_via", "2 * pi() * ring_radius"),
    "fence_pitch_over_gap": ("fence_pitch", "gap"),
    "fence_pitch_over_w": ("fence_pitch", "w"),
    "fence_offset_over_gap": ("fence_offset", "gap"),
    "fence_offset_over_w": ("fence_offset", "w"),
    "fence_total_offset_over_w": ("floor(w / 2) + gap + fence_offset", "w"),
    "fence_via_drill_over_pitch": ("fence_drill", "fence_pitch"),
    "fence_via_diam_over_pitch": ("fence_via", "fence_pitch"),
    "fence_via_drill_over_diam": ("fence_drill", "fence_via"),
    "fence_pitch_over_h": ("fence_pitch", "h"),
    "fence_offset_over_h": ("fence_offset", "h"),
    "fence_via_barrel_aspect": ("CASE WHEN fence_via IS NOT NULL THEN h END", "fence_via"),
    "launch_span_over_board_length": ("abs(right_x - left_x)", "board_length"),
    "launch_span_over_trace_w": ("abs(right_x - left_x)", "w"),
    "launch_left_y_offset_ratio": ("abs(left_y - floor(board_width / 2))", "board_width"),
    "launch_right_y_offset_ratio": ("abs(right_y - floor(board_width / 2))", "board_width"),
    "launch_left_x_ratio": ("left_x", "board_length"),
    "launch_right_x_ratio": ("right_x", "board_length"),
    "launch_edge_symmetry": ("abs(left_x - (board_length - right_x))", "board_length"),
    "launch_trace_over_span": (_TRACE, "abs(right_x - left_x)"),
    "launch_length_left_over_span": ("length_left", "abs(right_x - left_x)"),
    "launch_via_offset_ratio": ("CASE WHEN pad IS NOT NULL THEN length_left END", _TRACE),
    "stackup_h_over_gap": ("h", "gap"),
    "stackup_total_over_h": ("total_thickness", "h"),
}
OTHERS = {
    "cpwg_k_prime_ratio": "CASE WHEN w < w + 2 * gap THEN sqrt(1 - (CAST(w AS DOUBLE) / (w + 2 * gap)) * (CAST(w AS DOUBLE) / (w + 2 * gap))) ELSE 0 END",
    "stackup_sqrt_er": "CASE WHEN er > 0 THEN sqrt(er) ELSE 0 END",
}


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def derived_features(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(key, *[F.expr(x).cast("bigint").alias(n) for n, x in FEATURES.items()])


def dimensionless_groups(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(key, *[F.expr(ratio(*x)).alias(n) for n, x in RATIOS.items()], *[F.expr(x).cast("double").alias(n) for n, x in OTHERS.items()])

"""Networks validated: single checks, and verdicts over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import validation as V
from lodestone.plans.adapters import networks
from lodestone.plans.network_queries import _EIG, _WIDE, _rounded
from lodestone.plans.registry import query

#: Limits that tell the synthetic networks apart.
LIMITS = {"passivity": V.Limit(1.9, 2.1), "reciprocity": V.Limit(1.5, 2.2), "causality": V.Limit(1e-3, 1e-2, enabled=False), "power_balance": V.Limit(1.0, 3.0)}

_CHECKED = f"""{_WIDE}, {_EIG}, m AS (
    SELECT network_id, 'passivity' AS "check", freq_hz, sqrt(greatest((p + q) / 2 + sqrt((p - q) / 2 * ((p - q) / 2) + z * z), 0)) AS v, 1.9 AS a, 2.1 AS b FROM eigs JOIN wide USING (network_id, f_idx)
    UNION ALL SELECT network_id, 'reciprocity', freq_hz, sqrt((re12 - re21) * (re12 - re21) + (im12 - im21) * (im12 - im21)), 1.5, 2.2 FROM wide
    UNION ALL SELECT network_id, 'power_balance', freq_hz, re11*re11 + im11*im11 + re21*re21 + im21*im21 - 1, 1.0, 3.0 FROM wide
    UNION ALL SELECT network_id, 'power_balance', freq_hz, re12*re12 + im12*im12 + re22*re22 + im22*im22 - 1, 1.0, 3.0 FROM wide),
checked AS (SELECT network_id, "check", round(max(v), 8) AS value, arg_max(freq_hz, (v, -freq_hz)) AS worst_freq_hz, count(*) FILTER (v > b) AS n_violations, CASE WHEN max(v) <= max(a) THEN 'PASS' WHEN max(v) <= max(b) THEN 'WARN' ELSE 'FAIL' END AS status FROM m GROUP BY 1, 2
    UNION ALL SELECT DISTINCT network_id, 'causality', NULL, NULL, NULL, 'SKIP' FROM wide)"""


@query(f"{_CHECKED} SELECT * FROM checked")
def network_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passivity, reciprocity and power balance of each network; causality is left out."""
    return _rounded(V.checks(networks(spark, sf_dir), LIMITS), "value")


@query(f"""{_CHECKED}, n AS (SELECT network_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'WARN') AS n_warn, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'SKIP') AS n_skip,
    coalesce(string_agg("check", ',' ORDER BY "check") FILTER (status = 'FAIL'), '') AS failing FROM checked GROUP BY 1)
    SELECT *, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_skip = 4 THEN 'SKIP' WHEN n_warn > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM n""")
def network_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verdicts on a network together."""
    return V.verdicts(V.checks(networks(spark, sf_dir), LIMITS))


@query()
def network_full_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with causality, at the usual limits."""
    return V.verdicts(V.checks(networks(spark, sf_dir)))


@query(f"""{_WIDE}, d AS (SELECT network_id, freq_hz, sqrt((re12 - re21) * (re12 - re21) + (im12 - im21) * (im12 - im21)) AS e FROM wide)
    SELECT network_id, round(max(e), 8) AS max_error, round(20 * log10(max(e)), 8) AS max_error_db, 1 AS i, 2 AS j, arg_max(freq_hz, (e, -freq_hz)) AS freq_hz FROM d GROUP BY 1""")
def network_worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of ports, and the frequency, that are least reciprocal."""
    return _rounded(V.worst_pairs(networks(spark, sf_dir)), "max_error", "max_error_db")


@query(f"""{_WIDE}, {_EIG}, e AS (SELECT network_id, f_idx, (p + q) / 2 + sqrt((p - q) / 2 * ((p - q) / 2) + z * z) AS eig FROM eigs)
    SELECT network_id, round(max(sqrt((re11 - re22) * (re11 - re22) + (im11 - im22) * (im11 - im22))), 8) AS symmetry_error, round(max(sqrt((re12 - re21) * (re12 - re21) + (im12 - im21) * (im12 - im21))), 8) AS reciprocity_error,
    count(*) FILTER (eig > 1 + 1e-10) AS n_active FROM wide JOIN e USING (network_id, f_idx) GROUP BY 1""")
def network_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetry and reciprocity errors, and points that aren't passive."""
    return _rounded(V.symmetry(networks(spark, sf_dir)), "symmetry_error", "reciprocity_error")

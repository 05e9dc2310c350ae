"""Designs, nets and simulation limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import designs as D
from lodestone.operators import rules as R
from lodestone.plans.adapters import candidates, networks
from lodestone.plans.registry import query, table
from lodestone.plans.rule_queries import _SPECS_SQL, _U, TIGHT, _filter_sql, specs

_B32 = " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', CAST((CAST(('0x' || substr(h, 1, 15)) AS BIGINT) >> {55 - 5 * i}) & 31 AS INT) + 1, 1)" for i in range(12))


@query(f"""WITH {_SPECS_SQL}, h AS (SELECT p_partkey, sha256('{{' || CASE WHEN drill IS NULL THEN '' ELSE '"drill":' || drill || ',' END || '"gap":' || gap || ',"w":' || w || '}}') AS h FROM specs) SELECT p_partkey, h AS design_hash, {_B32} AS short_id FROM h""")
def design_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.design_ids(specs(spark, sf_dir), "p_partkey", F.create_map(*[x for n in ("w", "gap", "drill") for x in (F.lit(n), F.col(n))]))


@query(f"WITH {_U} SELECT cand_id, " + ", ".join(f"CAST(round({R.physical(n).replace(f'u_{n}', f'u[{i + 1}]')}, 0) AS BIGINT) AS {n}" for i, (n, _, _) in enumerate(R.SPACE)) + " FROM cands")
def resolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.resolve_candidates(candidates(spark, sf_dir))
    return own.select("cand_id", *[F.col("parameters")[n].alias(n) for n, _, _ in R.SPACE])


@query(f"SELECT cand_id, repairs FROM ({_filter_sql(R.ROUNDS)}) WHERE feasible ORDER BY cand_id LIMIT 20")
def feasible_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.select_feasible(R.batch_filter(candidates(spark, sf_dir), TIGHT), 20).select("cand_id", F.col("repairs").cast("bigint").alias("repairs"))


@query(f"""WITH {_SPECS_SQL} SELECT p_partkey, 'T0_TRACE_WIDTH_MIN' AS constraint_id, CAST(w - 120000 AS DOUBLE) AS margin, w >= 120000 AS passed FROM specs UNION ALL SELECT p_partkey, 'T0_TRACE_GAP_MIN', gap - 100000, gap >= 100000 FROM specs
    UNION ALL SELECT p_partkey, 'T0_SIGNAL_DRILL_MIN', drill - 200000, drill >= 200000 FROM specs WHERE drill IS NOT NULL UNION ALL SELECT p_partkey, 'T1_SIGNAL_ANNULAR_MIN', pad - drill - 425000, pad - drill >= 425000 FROM specs WHERE drill IS NOT NULL""")
def short_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = specs(spark, sf_dir).withColumns({"min_drill": F.lit(200_000), "min_annular_ring": F.lit(425_000)})
    return D.short_evaluation(own, "p_partkey").select("p_partkey", "constraint_id", "margin", "passed")


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_nationkey AS net, (s_suppkey * 7919) % 300 AS x, (s_suppkey * 104729) % 300 AS y, 40 + s_suppkey % 30 AS r FROM supplier),
    u AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.net = b.net AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (a.r + b.r) * (a.r + b.r)),
    w AS (SELECT id, id AS c FROM p UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.id), g AS (SELECT id, min(c) AS c FROM w GROUP BY id), q AS (SELECT net, min(id) AS l, max(id) AS r FROM p GROUP BY net)
    SELECT net, a.c = b.c AS connected FROM q JOIN g a ON a.id = l JOIN g b ON b.id = q.r""")
def net_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("net"), (key * 7919 % 300).alias("x"), (key * 104729 % 300).alias("y"), (40 + key % 30).alias("r"))
    ports = points.groupBy("net").agg(F.min("id").alias("left_id"), F.max("id").alias("right_id"))
    return D.net_connectivity(points, ports, 70)


@query(f"""WITH {_SPECS_SQL}, s AS (SELECT p_partkey, gap * 1e-9::DOUBLE / (299792458.0::DOUBLE / sqrt(er) * sqrt(3.0::DOUBLE)) * 0.5::DOUBLE * 1e12::DOUBLE AS ps FROM specs), q AS (SELECT *, 1 / (ps * 1e-12::DOUBLE * (4e11::DOUBLE + p_partkey % 9 * 1e11::DOUBLE)) AS q FROM s)
    SELECT p_partkey, round(ps, 9) AS step_ps, round(q, 6) AS ratio, CASE WHEN q >= 10 THEN 'PASSED' WHEN q >= 2 THEN 'WARNING' ELSE 'FAILED' END AS status FROM q""")
def sampling_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = specs(spark, sf_dir).select("p_partkey", D.time_step_limit_ps(F.col("gap"), F.col("er")).alias("ps"), (F.lit(4e11) + F.col("p_partkey") % 9 * F.lit(1e11)).alias("f"))
    ratio, status = D.sampling_check(F.col("ps"), F.col("f"))
    return own.select("p_partkey", F.round("ps", 9).alias("step_ps"), F.round(ratio, 6).alias("ratio"), status.alias("status"))


@query("SELECT user_id, round(avg(d), 6) AS mean_step FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) GROUP BY user_id")
def mean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mean_step(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("mean_step", F.round("mean_step", 6))


@query(f"""WITH {_SPECS_SQL}, z AS (SELECT p_partkey, length_left, CAST(greatest(floor(pad / 2), floor(via / 2)) AS BIGINT) + drill AS radius FROM specs WHERE pad IS NOT NULL) SELECT p_partkey, 'x' AS axis, length_left AS center, radius FROM z UNION ALL SELECT p_partkey, 'y', 0, radius FROM z""")
def via_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.via_zones(specs(spark, sf_dir), "p_partkey")


@query(f"""WITH {_SPECS_SQL}, l AS (SELECT p_partkey, length_left, unnest([pad, pad + 100000, 0]) AS radius FROM specs) SELECT p_partkey, 'x' AS axis, length_left AS center, radius FROM l WHERE radius > 0 UNION ALL SELECT p_partkey, 'y', 0, radius FROM l WHERE radius > 0""")
def antipad_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = specs(spark, sf_dir).select("p_partkey", "length_left", F.explode(F.array(F.col("pad"), F.col("pad") + 100_000, F.lit(0).cast("bigint"))).alias("radius"))
    return D.antipad_zones(layers, "p_partkey")


@query(f"""WITH {_SPECS_SQL}, c AS (SELECT p_partkey, CAST(floor(w / 2) AS BIGINT) AS h, gap, CAST(floor(gap / 3) AS BIGINT) AS cell FROM specs), z AS (SELECT p_partkey, h AS c, CAST(floor(gap / 2) AS BIGINT) AS r FROM c UNION ALL SELECT p_partkey, h + gap, 2 * cell FROM c)
    SELECT p_partkey, 'y' AS axis, s * c AS center, r AS radius FROM z, (VALUES (1), (-1)) v(s)""")
def trace_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trace_zones(specs(spark, sf_dir).withColumn("trace_cell", F.floor(F.col("gap") / 3)), "p_partkey")


@query()
def network_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.network_hashes(networks(spark, sf_dir))

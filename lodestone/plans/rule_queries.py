"""Design rules, features and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import mappings as P
from lodestone.operators import features as D
from lodestone.operators import integrity as I
from lodestone.operators import meshes as M
from lodestone.operators import rules as R
from lodestone.plans.adapters import candidates
from lodestone.plans.registry import query, table

#: Tighter than the defaults, so that every tier has violations.
TIGHT = {k: v * f for (k, v), f in zip(R.LIMITS.items(), (2, 1.6, 1.5, 1.8, 1.3, 12, 1.5, 5), strict=True)}
_U = "cands AS (SELECT vec_id AS cand_id, list_transform(embedding[1:19], lambda x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + CAST(x AS DOUBLE)))) AS u FROM embeddings)"


def _filter_sql(rounds: int) -> str:
    ctes, last, known = [_U, "s0 AS (SELECT *, " + ", ".join(f"u[{i + 1}] AS u_{n}" for i, (n, _, _) in enumerate(R.SPACE)) + " FROM cands)"], "s0", {"cand_id", "u"} | {f"u_{n}" for n, _, _ in R.SPACE}
    for k, step in enumerate(R.steps(TIGHT, rounds), 1):
        again = [n for n in step if n in known]
        star = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        ctes.append(f"s{k} AS (SELECT {star}, " + ", ".join(f"{x} AS {n}" for n, x in step.items()) + f" FROM {last})")
        last, known = f"s{k}", known | set(step)
    return "WITH " + ",\n".join(ctes) + f" SELECT cand_id, feasible, feasible_before, CAST(repairs AS BIGINT) AS repairs, round(distance, 9) AS distance, CAST(violations_t0 AS BIGINT) AS violations_t0, CAST(violations_t1 AS BIGINT) AS violations_t1, CAST(violations_t2 AS BIGINT) AS violations_t2 FROM {last}"


def _shown(got: DataFrame) -> DataFrame:
    return got.select("cand_id", "feasible", "feasible_before", F.col("repairs").cast("bigint").alias("repairs"), F.round("distance", 9).alias("distance"), *[F.col(f"violations_t{i}").cast("bigint").alias(f"violations_t{i}") for i in range(3)])


def _filtered(spark: SparkSession, sf_dir: str, repair: bool) -> DataFrame:
    return _shown(R.batch_filter(candidates(spark, sf_dir), TIGHT, repair))


@query(_filter_sql(R.ROUNDS))
def batch_filter_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, True)


@query(_filter_sql(0))
def batch_filter_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, False)


_LONG = (
    f"WITH {_U}, p AS (SELECT cand_id, " + ", ".join(f"{R.physical(n).replace(f'u_{n}', f'u[{i + 1}]')} AS {n}" for i, (n, _, _) in enumerate(R.SPACE)) + " FROM cands), long AS ("
    + " UNION ALL ".join(f"SELECT cand_id, '{t}' AS tier, '{r}' AS constraint_id, {i} AS ordinal, CAST({R.margin(m, TIGHT)} AS DOUBLE) AS margin, {R.passes(r, '(' + R.margin(m, TIGHT) + ')')} AS passed FROM p" for i, (t, r, m, _, _) in enumerate(R.RULES)) + ")"
)


@query(_LONG + " SELECT cand_id, tier, constraint_id, round(margin, 3) AS margin, passed FROM long WHERE NOT passed")
def constraint_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.results(candidates(spark, sf_dir), TIGHT).where(~F.col("passed")).select("cand_id", "tier", "constraint_id", F.round("margin", 3).alias("margin"), "passed")


@query(_LONG + " SELECT cand_id, min(tier) FILTER (NOT passed) AS first_failing_tier FROM long GROUP BY cand_id")
def first_failing_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_failing_tier(R.results(candidates(spark, sf_dir), TIGHT))


@query(_LONG + " SELECT cand_id, count(*) AS n FROM (SELECT *, min(CASE WHEN NOT passed THEN tier END) OVER (PARTITION BY cand_id) AS f FROM long) WHERE f IS NULL OR tier <= f GROUP BY cand_id")
def fail_fast_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fail_fast(R.results(candidates(spark, sf_dir), TIGHT)).groupBy("cand_id").agg(F.count("*").alias("n"))


@query(_LONG + """ SELECT tier, count(*) FILTER (NOT passed) AS n_failed, count(*) FILTER (passed) AS n_passed, round(avg(margin), 2) AS mean_margin, round(min(margin), 3) AS min_margin, arg_min(constraint_id, (margin, ordinal)) AS tightest FROM long GROUP BY tier""")
def constraint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(R.results(candidates(spark, sf_dir), TIGHT)).withColumns({"mean_margin": F.round("mean_margin", 2), "min_margin": F.round("min_margin", 3)})


@query(f"WITH s AS ({_filter_sql(R.ROUNDS)}) SELECT count(*) AS n, count(*) FILTER (feasible) AS n_feasible, CAST(count(*) FILTER (feasible) AS DOUBLE) / count(*) AS rate FROM s")
def feasibility_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_filter(candidates(spark, sf_dir), TIGHT).agg(F.count("*").alias("n"), F.count_if("feasible").alias("n_feasible"), F.avg(F.col("feasible").cast("double")).alias("rate"))


_SPEC = {
    "w": "CAST(100000 + p_size * 1000 AS BIGINT)", "gap": "CAST(80000 + (p_partkey % 50) * 1000 AS BIGINT)", "h": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(150000 + (p_partkey % 7) * 50000 AS BIGINT) END",
    "board_width": "CAST(10000000 + p_size * 100000 AS BIGINT)", "board_length": "CAST(80000000 + (p_partkey % 11) * 1000000 AS BIGINT)", "length_left": "CAST(20000000 + (p_partkey % 13) * 100000 AS BIGINT)",
    "length_right": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(20000000 + (p_partkey % 5) * 100000 AS BIGINT) END", "left_x": "CAST(2000000 + (p_partkey % 3) * 1000 AS BIGINT)", "left_y": "CAST(p_partkey % 2 AS BIGINT)",
    "right_x": "CAST(70000000 + (p_partkey % 17) * 500000 AS BIGINT)", "right_y": "CAST(p_partkey % 3 AS BIGINT)", "drill": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(300000 AS BIGINT) END",
    "via": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(450000 + p_size * 100 AS BIGINT) END", "pad": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(700000 + p_size * 1000 AS BIGINT) END", "ring_radius": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(900000 + p_size * 10000 AS BIGINT) END",
    "return_count": "CAST(4 + p_partkey % 5 AS BIGINT)", "return_drill": "CAST(300000 AS BIGINT)", "return_via": "CAST(460000 AS BIGINT)", "fence_pitch": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(400000 + p_size * 20000 AS BIGINT) END",
    "fence_offset": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(200000 + p_size * 5000 AS BIGINT) END", "fence_drill": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(250000 AS BIGINT) END", "fence_via": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(420000 AS BIGINT) END",
    "er": "CAST(3.5 AS DOUBLE) + p_size / CAST(100 AS DOUBLE)", "total_thickness": "CAST(1600000 AS BIGINT)", "min_edge_clearance": "CAST(4000000 AS BIGINT)", "min_via_to_via": "CAST(200000 AS BIGINT)", "min_trace_width": "CAST(120000 AS BIGINT)",
    "min_gap": "CAST(100000 AS BIGINT)", "min_drill": "CAST(260000 AS BIGINT)", "min_via_diameter": "CAST(430000 AS BIGINT)", "min_annular_ring": "CAST(82000 AS BIGINT)", "min_board_width": "CAST(11000000 AS BIGINT)", "corner_radius": "CAST((p_partkey % 4) * 1000000 AS BIGINT)",
}
_RENAMED = {"trace_width": "w", "trace_gap": "gap", "signal_pad": "pad", "signal_drill": "drill", "signal_via": "via"}
_SPECS_SQL = "specs AS (SELECT p_partkey, " + ", ".join(f"{x} AS {n}" for n, x in _SPEC.items()) + " FROM part), docs AS (SELECT *, " + ", ".join(f"{b} AS {a}" for a, b in _RENAMED.items()) + " FROM specs)"


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in _SPEC.items()])
    return own.select("*", *[F.col(b).alias(a) for a, b in _RENAMED.items()])


@query(f"WITH {_SPECS_SQL} SELECT p_partkey, " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in D.FEATURES.items()) + " FROM specs")
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.derived_features(specs(spark, sf_dir), "p_partkey")


@query(f"WITH {_SPECS_SQL} SELECT p_partkey, " + ", ".join(f"round({D.ratio(*x)}, 9) AS {n}" for n, x in D.RATIOS.items()) + ", " + ", ".join(f"round(CAST({x} AS DOUBLE), 9) AS {n}" for n, x in D.OTHERS.items()) + " FROM specs")
def dimensionless_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.dimensionless_groups(specs(spark, sf_dir), "p_partkey")
    return got.select("p_partkey", *[F.round(c, 9).alias(c) for c in got.columns[1:]])


@query(f"WITH {_SPECS_SQL} " + " UNION ALL ".join(f"SELECT p_partkey, '{r}' AS constraint_id, round(CAST({m} AS DOUBLE), 3) AS margin, CAST({m} AS DOUBLE) >= 0 AS passed FROM docs WHERE ({m}) IS NOT NULL" for r, m in R.DOCUMENT_RULES))
def document_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_results(specs(spark, sf_dir), "p_partkey").withColumn("margin", F.round("margin", 3))


_REPAIRED = tuple(dict.fromkeys(column for _, _, column, _ in R.DOCUMENT_REPAIRS))


def _repair_sql() -> str:
    ctes, last = [_SPECS_SQL, "r0 AS (SELECT *, CAST([] AS VARCHAR[]) AS actions FROM docs)"], "r0"
    for k, (rule, when, column, value) in enumerate(R.DOCUMENT_REPAIRS, 1):
        new = f"CAST({value} AS BIGINT)"
        said = f"'{rule}:' || coalesce(CAST({column} AS VARCHAR), '') || ':' || CAST({new} AS VARCHAR)"
        ctes.append(f"r{k} AS (SELECT * EXCLUDE ({column}, actions), CASE WHEN coalesce({when}, false) THEN {new} ELSE {column} END AS {column}, CASE WHEN coalesce({when}, false) THEN list_append(actions, {said}) ELSE actions END AS actions FROM {last})")
        last = f"r{k}"
    return "WITH " + ", ".join(ctes) + f" SELECT p_partkey, {', '.join(_REPAIRED)}, array_to_string(actions, ';') AS actions FROM {last}"


@query(_repair_sql())
def document_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("actions", lambda a: F.concat(a["constraint_id"], F.lit(":"), F.coalesce(a["before"].cast("string"), F.lit("")), F.lit(":"), a["after"].cast("string")))
    return R.document_repair(specs(spark, sf_dir)).select("p_partkey", *_REPAIRED, F.array_join(said, ";").alias("actions"))


@query(f"""WITH r AS ({_repair_sql()}), a AS (SELECT p_partkey, unnest(CASE WHEN actions = '' THEN [NULL] ELSE string_split(actions, ';') END) AS a FROM r), c AS (SELECT p_partkey, coalesce(CAST(nullif(split_part(a, ':', 2), '') AS BIGINT), 0) AS b, CAST(nullif(split_part(a, ':', 3), '') AS BIGINT) AS e FROM a)
    SELECT p_partkey, round(coalesce(sum(abs(e - b) / CAST(greatest(abs(b), 1) AS DOUBLE)), 0), 9) AS relative, round(sqrt(coalesce(sum(CAST(abs(e - b) AS DOUBLE) * abs(e - b)), 0)), 3) AS l2, CAST(coalesce(max(abs(e - b)), 0) AS DOUBLE) AS linf FROM c GROUP BY p_partkey""")
def document_repair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.action_distances()
    return R.document_repair(specs(spark, sf_dir)).select("p_partkey", F.round(d["relative"], 9).alias("relative"), F.round(d["l2"], 3).alias("l2"), d["linf"].alias("linf"))


@query("""WITH u AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS u, p_retailprice / 250 AS v FROM part), x AS (SELECT *, [1.0::DOUBLE, 2.5, 4.0, 8.0] AS l FROM u), m AS (SELECT *, 100.0::DOUBLE + u * 400 AS linear, exp(ln(1e3::DOUBLE) + u * (ln(1e6::DOUBLE) - ln(1e3::DOUBLE))) AS log FROM x)
    SELECT p_partkey, round(linear, 6) AS linear, round(log, 4) AS log, l[least(4, CAST(floor(u * 4) AS INT) + 1)] AS discrete, round((linear - 100) / 400, 9) AS linear_number, round((ln(log) - ln(1e3::DOUBLE)) / (ln(1e6::DOUBLE) - ln(1e3::DOUBLE)), 9) AS log_number,
        (list_position(list_transform(l, lambda e: abs(v - e)), list_min(list_transform(l, lambda e: abs(v - e)))) - 0.5::DOUBLE) / 4 AS discrete_number FROM m""")
def parameter_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, some = F.col("p_size") / F.lit(50.0), (1.0, 2.5, 4.0, 8.0)
    linear, log = P.to_value(u, "linear", 100, 500), P.to_value(u, "log", 1e3, 1e6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(linear, 6).alias("linear"), F.round(log, 4).alias("log"), P.to_value(u, "discrete", values=some).alias("discrete"),
        F.round(P.to_number(linear, "linear", 100, 500), 9).alias("linear_number"), F.round(P.to_number(log, "log", 1e3, 1e6), 9).alias("log_number"), P.to_number(F.col("p_retailprice") / 250, "discrete", values=some).alias("discrete_number"),
    )


@query("""WITH g AS (SELECT p_brand AS axis, list_sort(list_distinct(list(CAST(p_size * 100 AS BIGINT)))) AS l FROM part GROUP BY p_brand), d AS (SELECT axis, list_transform(range(1, len(l)), lambda i: l[i + 1] - l[i]) AS c FROM g)
    SELECT axis, len(c) AS n_cells, list_min(c) AS min_cell, list_max(c) AS max_cell, round(list_sum(c) / len(c), 6) AS mean_cell FROM d""")
def mesh_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("axis")).agg(F.array_sort(F.collect_set((F.col("p_size") * 100).cast("bigint"))).alias("lines"))
    got = M.mesh_stats(lines)
    return got.select("axis", F.col("n_cells").cast("bigint").alias("n_cells"), "min_cell", "max_cell", F.round("mean_cell", 6).alias("mean_cell"))


@query(f"""WITH {_SPECS_SQL}, b AS (SELECT *, CAST(floor(299792458.0 / (20e9 * sqrt(er)) * 1e9) AS BIGINT) AS lam FROM specs), c AS (SELECT *, greatest(5000, least(CAST(floor(lam * CAST(0.05 AS DOUBLE)) AS BIGINT), 500000)) AS base FROM b)
    SELECT p_partkey, lam AS min_wavelength, base AS base_cell, greatest(5000, least(25000, CAST(floor(w / 4) AS BIGINT), CAST(floor(gap / 3) AS BIGINT), base)) AS trace_cell FROM c""")
def mesh_cell_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_sizes(specs(spark, sf_dir), 20e9).select("p_partkey", "min_wavelength", "base_cell", "trace_cell")


_TURN = "k * (360000 // return_count) / 1000.0::DOUBLE * 0.017453292519943295::DOUBLE"


@query(f"""WITH {_SPECS_SQL} SELECT p_partkey, CAST(k AS INT) AS k, CAST(trunc(ring_radius * cos({_TURN})) AS BIGINT) AS x, CAST(trunc(ring_radius * sin({_TURN})) AS BIGINT) AS y
    FROM (SELECT *, unnest(range(0, return_count)) AS k FROM specs WHERE ring_radius IS NOT NULL)""")
def via_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ring(specs(spark, sf_dir), "p_partkey", "ring_radius", "return_count")


@query("""WITH g AS (SELECT p_partkey, p_size % 4 + 1 AS r, p_size % 5 + 1 AS c, 500000 + p_size * 1001 AS rp, 400001 + p_size * 1000 AS cp FROM part), x AS (SELECT *, unnest(range(0, r)) AS i FROM g), y AS (SELECT *, unnest(range(0, c)) AS j FROM x)
    SELECT p_partkey, CAST(i AS INT) AS "row", CAST(j AS INT) AS col, CAST(j * cp - floor((c - 1) * cp / 2) AS BIGINT) AS x, CAST(i * rp - floor((r - 1) * rp / 2) AS BIGINT) AS y FROM y WHERE NOT (i = (r - 1) // 2 AND j = (c - 1) // 2)""")
def via_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    own = table(spark, sf_dir, "part").select("p_partkey", (size % 4 + 1).alias("r"), (size % 5 + 1).alias("c"), (500_000 + size * 1001).alias("rp"), (400_001 + size * 1000).alias("cp"))
    return M.grid(own, "p_partkey", "r", "c", "rp", "cp")


@query(f"""WITH {_SPECS_SQL}, f AS (SELECT p_partkey, length_left + coalesce(length_right, 0) AS l, fence_pitch AS p, CAST(floor(w / 2) AS BIGINT) + gap + fence_offset AS o FROM specs WHERE fence_pitch IS NOT NULL), k AS (SELECT *, l // p AS n, unnest(range(0, l // p)) AS k FROM f)
    SELECT p_partkey, CAST(k AS INT) AS k, side, CAST((l - (n - 1) * p) // 2 + k * p AS BIGINT) AS x, side * o AS y FROM k, (VALUES (1), (-1)) s(side)""")
def via_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fence(specs(spark, sf_dir), "p_partkey", F.col("length_left") + F.coalesce("length_right", F.lit(0)), "fence_pitch", F.floor(F.col("w") / 2) + F.col("gap") + F.col("fence_offset"))


@query()
def graded_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("axis"), F.array(F.lit(0).cast("bigint"), (F.col("p_size") * 100_000).cast("bigint"), (F.col("p_size") * 100_000 + 5_000_000).cast("bigint")).alias("fixed"))
    return M.graded_lines(zones, finest=50_000, ratio=1.5, coarsest=500_000)


@query(_filter_sql(R.ROUNDS).rsplit(" SELECT cand_id", 1)[0] + f" SELECT cand_id, round(" + " + ".join(f"abs(u_{n} - o_{n})" for n, _, _ in R.SPACE) + ", 8) AS l1, round(distance, 8) AS l2, round(greatest(" + ", ".join(f"abs(u_{n} - o_{n})" for n, _, _ in R.SPACE) + f"), 8) AS linf FROM s{len(R.steps(TIGHT))}")
def repair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = candidates(spark, sf_dir)
    both = R.batch_filter(own, TIGHT).join(own, "cand_id")
    return both.select("cand_id", *[F.round(c, 8).alias(n) for n, c in R.repair_distances().items()])


@query("""SELECT p_partkey, CAST(floor(c + s * r * f) AS BIGINT) AS line FROM (SELECT p_partkey, p_size * 1000 AS c, 300 + p_size AS r FROM part), (VALUES (-1), (1)) a(s), (VALUES (2.0::DOUBLE / 3), (4.0::DOUBLE / 3)) b(f)""")
def thirds_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = M.thirds_rule(F.col("p_size") * 1000, 300 + F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(lines).alias("line"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'content' END, CASE WHEN o_orderstatus <> 'F' THEN 'version' END, CASE WHEN o_custkey % 7 = 0 THEN 'settings' END) AS reasons FROM orders""")
def invalidation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"content": F.col("o_totalprice") > 300_000, "version": F.col("o_orderstatus") != "F", "settings": F.col("o_custkey") % 7 == 0}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(I.invalidation_reasons(checks), ",").alias("reasons"))

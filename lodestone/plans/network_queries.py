"""Network parameter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import networks as N
from lodestone.operators import signals as S
from lodestone.operators import verification as V
from lodestone.plans.adapters import NETWORK_SQL, WHOLE_NETWORK_SQL, networks, whole_networks
from lodestone.plans.registry import query, table
from lodestone.plans.session import cut

_WIDE = f"WITH {NETWORK_SQL}, wide AS (SELECT network_id, f_idx, freq_hz, " + ", ".join(f"max({c}) FILTER (i = {i} AND j = {j}) AS {c}{i}{j}" for i in (1, 2) for j in (1, 2) for c in ("re", "im")) + " FROM networks GROUP BY 1, 2, 3)"
_DB = lambda n: f"20 * log10(greatest(sqrt(re{n} * re{n} + im{n} * im{n}), 1e-15))"


def _rounded(frame: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {NETWORK_SQL} SELECT network_id, f_idx, i, j, round({_DB('')}, 8) AS db, round(degrees(atan2(im, re)), 8) AS phase FROM networks")
def network_magnitude_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    re, im = F.col("re"), F.col("im")
    return _rounded(networks(spark, sf_dir).select("network_id", "f_idx", "i", "j", N.magnitude_db(re, im).alias("db"), N.phase_deg(re, im).alias("phase")), "db", "phase")


@query(f"WITH {NETWORK_SQL} SELECT network_id, f_idx, i, j, round(re, 8) + 0.0 AS re, round(im, 8) + 0.0 AS im FROM networks")
def network_format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = N.to_format(F.col("re"), F.col("im"), "DB")
    own = networks(spark, sf_dir).select("network_id", "f_idx", "i", "j", a.alias("a"), b.alias("b"))
    re, im = N.from_format(F.col("a"), F.col("b"), "DB")
    return own.select("network_id", "f_idx", "i", "j", (F.round(re, 8) + 0.0).alias("re"), (F.round(im, 8) + 0.0).alias("im"))


_EIG = """eigs AS (SELECT network_id, f_idx, p, q, sqrt(x * x + y * y) AS z FROM (SELECT network_id, f_idx, re11*re11 + im11*im11 + re12*re12 + im12*im12 AS p, re21*re21 + im21*im21 + re22*re22 + im22*im22 AS q,
    re11*re21 + im11*im21 + re12*re22 + im12*im22 AS x, im11*re21 - re11*im21 + im12*re22 - re12*im22 AS y FROM wide))"""


@query(f"""{_WIDE}, {_EIG}, e AS (SELECT network_id, (p + q) / 2 + sqrt((p - q) / 2 * ((p - q) / 2) + z * z) AS eig FROM eigs)
    SELECT network_id, round(max(eig), 8) AS max_eig, count(*) FILTER (eig > 1 + 1e-6) AS n_violations, CASE WHEN count(*) FILTER (eig > 1 + 1e-6) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM e GROUP BY network_id""")
def network_passivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.passivity(networks(spark, sf_dir)), "max_eig")


@query(f"""{_WIDE}, {_EIG} SELECT network_id, f_idx, round((p + q) / 2 + sqrt((p - q) / 2 * ((p - q) / 2) + z * z), 8) AS eig FROM eigs""")
def network_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.eigenvalues(networks(spark, sf_dir)), "eig")


@query(f"""{_WIDE}, d AS (SELECT network_id, sqrt((re12 - re21) * (re12 - re21) + (im12 - im21) * (im12 - im21)) AS e FROM wide)
    SELECT network_id, round(max(e), 8) AS max_error, round(avg(e), 8) AS mean_error, count(*) FILTER (e > 0.5) AS n_violations FROM d GROUP BY network_id""")
def network_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.reciprocity(networks(spark, sf_dir), 0.5), "max_error", "mean_error")


@query(f"""WITH {NETWORK_SQL}, c AS (SELECT network_id, f_idx, freq_hz, j, sum(re * re + im * im) AS p FROM networks GROUP BY 1, 2, 3, 4)
    SELECT network_id, round(max(p) - 1, 8) AS excess, arg_max(freq_hz, (p, -f_idx, -j)) AS worst_freq_hz, CASE WHEN max(p) - 1 <= 0 THEN 'PASSED' WHEN max(p) - 1 <= 0.1 THEN 'WARNING' ELSE 'FAILED' END AS status FROM c GROUP BY network_id""")
def network_power_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(N.power_balance(networks(spark, sf_dir)), "excess")


@query(f"{_WIDE} SELECT network_id, " + ", ".join(f"round({f}({_DB(n)}), 7) AS s{n}_db_{name}" for n in ("11", "21", "12") for name, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + " FROM wide GROUP BY network_id")
def network_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.metrics(networks(spark, sf_dir))
    return _rounded(got, *got.columns[1:], digits=7)


@query(f"""{_WIDE}, c AS (SELECT *, re11*re22 - im11*im22 - (re12*re21 - im12*im21) AS dr, re11*im22 + im11*re22 - (re12*im21 + im12*re21) AS di, re12*re21 - im12*im21 AS xr, re12*im21 + im12*re21 AS xi FROM wide)
    SELECT network_id, f_idx, round((1 - (re11*re11 + im11*im11) - (re22*re22 + im22*im22) + (dr*dr + di*di)) / (2 * sqrt(xr*xr + xi*xi)), 6) AS k, round(sqrt(dr*dr + di*di), 8) AS delta FROM c""")
def network_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(N.stability(networks(spark, sf_dir)), "k", digits=6), "delta")


@query(f"""WITH {NETWORK_SQL}, g AS (SELECT DISTINCT network_id, CAST(x AS DOUBLE) AS f FROM networks, (VALUES (5e7), (2.5e8), (3e8), (1.234e9), (9e11)) v(x)),
    p AS (SELECT g.network_id, g.f, i, j, max_by(struct_pack(f := n.freq_hz, re := n.re, im := n.im), n.freq_hz) FILTER (n.freq_hz <= g.f) AS a, min_by(struct_pack(f := n.freq_hz, re := n.re, im := n.im), n.freq_hz) FILTER (n.freq_hz >= g.f) AS b
        FROM g JOIN networks n USING (network_id) GROUP BY ALL), q AS (SELECT network_id, f, i, j, coalesce(a, b) AS a, coalesce(b, a) AS b FROM p), r AS (SELECT *, CASE WHEN b.f = a.f THEN 0 ELSE (f - a.f) / (b.f - a.f) END AS w FROM q)
    SELECT network_id, f AS freq_hz, i, j, round(a.re + w * (b.re - a.re), 9) + 0.0 AS re, round(a.im + w * (b.im - a.im), 9) + 0.0 AS im FROM r""")
def network_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = networks(spark, sf_dir)
    grid = own.select("network_id").distinct().select("network_id", F.explode(F.array(*[F.lit(x) for x in (5e7, 2.5e8, 3e8, 1.234e9, 9e11)])).alias("freq_hz"))
    got = N.interpolate(own, grid)
    return got.withColumns({c: F.round(c, 9) + 0.0 for c in ("re", "im")})


@query("""WITH o AS (SELECT vec_id * 1e6::DOUBLE AS f, CAST(embedding[20] AS DOUBLE) AS re, CAST(embedding[21] AS DOUBLE) AS im FROM embeddings),
    n AS (SELECT *, lead(f) OVER w AS f2, lead(re) OVER w AS re2, lead(im) OVER w AS im2 FROM o WINDOW w AS (ORDER BY f))
    SELECT 'all' AS network_id, 1 AS i, 1 AS j, f + 250000.0::DOUBLE AS freq_hz, round(coalesce(re + 250000.0::DOUBLE / (f2 - f) * (re2 - re), re), 9) + 0.0 AS re, round(coalesce(im + 250000.0::DOUBLE / (f2 - f) * (im2 - im), im), 9) + 0.0 AS im FROM n""")
def network_interpolate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one network of one cell, on a grid of as many points."""
    hertz = F.col("vec_id") * F.lit(1e6)
    own = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("network_id"), F.lit(1).alias("i"), F.lit(1).alias("j"), hertz.alias("freq_hz"), F.col("embedding")[19].cast("double").alias("re"), F.col("embedding")[20].cast("double").alias("im"))
    got = N.interpolate_blocks(own, own.select("network_id", (F.col("freq_hz") + 250_000.0).alias("freq_hz")))
    return got.withColumns({c: F.round(c, 9) + 0.0 for c in ("re", "im")})


@query(f"""WITH {NETWORK_SQL}, t AS (SELECT *, -(2 * pi() * freq_hz / 299792458.0::DOUBLE) * CASE WHEN i = j THEN CASE i WHEN 1 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END ELSE 0.01::DOUBLE + 0.02::DOUBLE END AS a FROM networks)
    SELECT network_id, f_idx, i, j, round(re * cos(a) - im * sin(a), 8) + 0.0 AS re, round(re * sin(a) + im * cos(a), 8) + 0.0 AS im FROM t""")
def network_deembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.deembed(networks(spark, sf_dir), {1: 0.01, 2: 0.02})
    return got.select("network_id", "f_idx", "i", "j", *[(F.round(c, 8) + 0.0).alias(c) for c in ("re", "im")])


@query(f"""WITH {NETWORK_SQL}, d AS (SELECT network_id, sqrt((re * 0.01::DOUBLE) * (re * 0.01::DOUBLE) + (im * 0.01::DOUBLE) * (im * 0.01::DOUBLE)) AS d FROM networks)
    SELECT network_id, round(max(d), 8) AS max_delta, round(sqrt(avg(d * d)), 8) AS rms_delta, round(quantile_cont(d, 0.95), 8) AS percentile_delta, CAST(0 AS BIGINT) AS missing FROM d GROUP BY network_id""")
def network_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = networks(spark, sf_dir)
    return _rounded(N.compare(own, own.withColumns({"re": F.col("re") * 0.99, "im": F.col("im") * 0.99})), "max_delta", "rms_delta", "percentile_delta")


@query("""SELECT CAST(user_id AS VARCHAR) AS sim_id, arg_max(value, event_id) AS last_db, round(arg_max(value, event_id) - arg_min(value, event_id), 8) AS span_db, round(CASE WHEN count(*) > 1 THEN (arg_max(value, event_id) - arg_min(value, event_id)) / (count(*) - 1) ELSE 0 END, 8) AS rate_db,
    CASE WHEN arg_max(value, event_id) <= 20 THEN 'PASSED' ELSE 'FAILED' END AS status FROM events GROUP BY user_id""")
def energy_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sim_id"), F.col("event_id").alias("k"), F.col("value").alias("energy_db"))
    return _rounded(N.energy_decay(series, 20.0), "span_db", "rate_db")


@query("""WITH c AS (SELECT user_id, CASE WHEN value > 400 THEN 'FAILED' WHEN event_type = 'view' THEN 'SKIPPED' WHEN value > 100 THEN 'WARNING' ELSE 'PASSED' END AS status FROM events)
    SELECT user_id, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_and(status = 'SKIPPED') THEN 'SKIPPED' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASSED' END AS status FROM c GROUP BY user_id""")
def report_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 400, "FAILED").when(F.col("event_type") == "view", "SKIPPED").when(F.col("value") > 100, "WARNING").otherwise("PASSED")
    return N.roll_up(table(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id")


_MIXED = "f AS (SELECT CAST(label AS VARCHAR) AS network_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS f_idx, embedding AS e FROM embeddings), m AS (SELECT network_id, f_idx, i, j, CAST(e[(i - 1) * 4 + j] AS DOUBLE) AS re, CAST(e[16 + (i - 1) * 4 + j] AS DOUBLE) AS im, CASE WHEN i IN (1, 3) THEN 1 ELSE 2 END AS pi, CASE WHEN j IN (1, 3) THEN 1 ELSE 2 END AS pj, CASE WHEN i <= 2 THEN 1 ELSE -1 END AS si, CASE WHEN j <= 2 THEN 1 ELSE -1 END AS sj FROM f, (VALUES (1), (2), (3), (4)) a(i), (VALUES (1), (2), (3), (4)) b(j))"


@query(f"""WITH {_MIXED}, x AS (SELECT *, 'dd' AS mode, si * sj AS s FROM m UNION ALL SELECT *, 'dc', si FROM m UNION ALL SELECT *, 'cd', sj FROM m UNION ALL SELECT *, 'cc', 1 FROM m)
    SELECT network_id, f_idx, mode, CAST(pi AS INT) AS i, CAST(pj AS INT) AS j, round(sum(re * s) / 2, 8) + 0.0 AS re, round(sum(im * s) / 2, 8) + 0.0 AS im FROM x GROUP BY 1, 2, 3, 4, 5""")
def network_mixed_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("network_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("f_idx"), F.col("embedding").alias("e"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("e")[(i - 1) * 4 + j - 1].cast("double").alias("re"), F.col("e")[15 + (i - 1) * 4 + j].cast("double").alias("im")) for i in range(1, 5) for j in range(1, 5)])
    got = N.mixed_mode(own.select("network_id", "f_idx", F.lit(1.0).alias("freq_hz"), F.inline(cells)))
    return got.select("network_id", "f_idx", "mode", "i", "j", *[(F.round(c, 8) + 0.0).alias(c) for c in ("re", "im")])


@query("""WITH s AS (SELECT p_partkey, CAST(100000 + p_size * 8000 AS DOUBLE) AS w, CAST(80000 + (p_partkey % 50) * 4000 AS DOUBLE) AS g, 3.5::DOUBLE + p_size / 100.0::DOUBLE AS er FROM part), k AS (SELECT *, w / (w + 2 * g) AS k FROM s), z AS (SELECT p_partkey, 30 * pi() / sqrt((er + 1) / 2) *
    CASE WHEN k <= 0.707 THEN ln(2 * (1 + sqrt(sqrt(1 - k * k))) / (1 - sqrt(sqrt(1 - k * k)))) / pi() ELSE pi() / ln(2 * (1 + sqrt(k)) / (1 - sqrt(k))) END AS z FROM k)
    SELECT p_partkey, round(z, 6) AS z0, round(abs(50 - z) / z * 100, 6) AS mismatch, CASE WHEN abs(50 - z) / z * 100 <= 10 THEN 'PASSED' WHEN abs(50 - z) / z * 100 <= 25 THEN 'WARNING' ELSE 'FAILED' END AS status FROM z""")
def line_impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, g, er = (100000 + F.col("p_size") * 8000).cast("double"), (80000 + (F.col("p_partkey") % 50) * 4000).cast("double"), F.lit(3.5) + F.col("p_size") / F.lit(100.0)
    own = table(spark, sf_dir, "part").select("p_partkey", N.line_impedance(w, g, er).alias("z"))
    off, verdict = N.impedance_verdict(F.lit(50.0), F.col("z"))
    return own.select("p_partkey", F.round("z", 6).alias("z0"), F.round(off, 6).alias("mismatch"), verdict.alias("status"))


@query(f"""WITH {WHOLE_NETWORK_SQL} SELECT network_id, f_idx, i, j, round(re * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (f_idx - 1) / greatest(n - 1, 1))), 8) + 0.0 AS re FROM networks JOIN (SELECT network_id, count(*) AS n FROM ranked GROUP BY 1) USING (network_id)""")
def windowed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = whole_networks(spark, sf_dir)
    n = cut(own.where("i = 1 AND j = 1").groupBy("network_id").agg(F.count("*").alias("n")))
    n = F.broadcast(n) if n.count() <= 100_000 else n  # a few labels hold all rows
    return own.join(n, "network_id").select("network_id", "f_idx", "i", "j", (F.round(F.col("re") * S.window("hann", F.col("f_idx") - 1, F.col("n")), 8) + 0.0).alias("re"))


@query()
def network_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.causality(networks(spark, sf_dir))


@query()
def network_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.renormalise(networks(spark, sf_dir), 50.0, 75.0)


@query()
def network_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = own.select(F.col("user_id").cast("string").alias("network_id"), F.lit(1).alias("excite"), k.alias("k"), F.col("value").alias("v"))
    ports = rows.select("network_id", "excite", F.explode(F.array(F.lit(1), F.lit(2))).alias("port"), "k", (F.col("k") * 1e-12).alias("t_s"), "v")
    return S.extract(ports.withColumns({"i": F.when(F.col("port") == 1, F.col("v") / 60).otherwise(F.col("v") / -80), "v": F.col("v") / F.col("port")}), 50.0, [1e9, 5e9, 1e10])


@query(f"""WITH {NETWORK_SQL} SELECT network_id, f_idx, i, j, re, im FROM networks""")
def network_excitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = networks(spark, sf_dir).withColumnRenamed("j", "excite")
    return V.excitation_matrix(runs).select("network_id", "f_idx", "i", "j", "re", "im")


@query("""SELECT DISTINCT CAST(label AS VARCHAR) AS network_id, i, j, CASE WHEN i <> j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS re, 0.0::DOUBLE AS im FROM embeddings, (VALUES (1), (2)) a(i), (VALUES (1), (2)) b(j)""")
def network_thru(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("network_id"), F.lit(1e9).alias("freq_hz")).distinct()
    return S.thru(grid).select("network_id", "i", "j", "re", "im")


_SAMPLES = "n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_WEIGHTS = {
    "hann": "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / greatest(n - 1, 1))",
    "hamming": "0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / greatest(n - 1, 1))",
    "blackman": "0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / greatest(n - 1, 1)) + 0.08::DOUBLE * cos(4 * pi() * k / greatest(n - 1, 1))",
    "tukey": "CASE WHEN k >= n - n // 4 THEN 0.5::DOUBLE * (1 - cos(pi() * (n - k) / (n // 4))) WHEN k < n // 4 THEN 0.5::DOUBLE * (1 - cos(pi() * k / (n // 4))) ELSE 1 END",
}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(by.orderBy("event_id")) - 1).cast("bigint").alias("k"), F.count("*").over(by).alias("n"))


@query(f"WITH {_SAMPLES}, w AS (SELECT *, {_WEIGHTS['tukey']} AS w FROM n) SELECT user_id, k, round(value * w / avg(w) OVER (PARTITION BY user_id), 9) AS v FROM w")
def tukey_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    weight = S.normalised_window("tukey", F.col("k").cast("double"), F.col("n"), Window.partitionBy("user_id"))
    return _samples(spark, sf_dir).select("user_id", "k", F.round(F.col("value") * weight, 9).alias("v"))


@query(f"WITH {_SAMPLES}, w AS (" + " UNION ALL ".join(f"SELECT user_id, '{kind}' AS kind, {x} AS w, {S.SCALLOPING[kind]}::DOUBLE AS l FROM n" for kind, x in _WEIGHTS.items()) + """), m AS (SELECT user_id, kind, l, avg(w) AS g, sum(w * w) AS e, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT *, CASE WHEN g * g * n > 1e-20 THEN e / (g * g * n) END AS b FROM m)
    SELECT user_id, kind, round(g, 9) AS coherent_gain, round(b, 6) AS noise_bandwidth, round(CASE WHEN b > 0 THEN 10 * log10(n / b) ELSE 0 END, 6) AS processing_gain_db, l AS scalloping_db FROM b WHERE g > 1e-9""")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, out = _samples(spark, sf_dir), None
    for kind in _WEIGHTS:
        one = S.window_metrics(own, "user_id", kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.where("coherent_gain > 1e-9").select("user_id", "kind", F.round("coherent_gain", 9).alias("coherent_gain"), F.round("noise_bandwidth", 6).alias("noise_bandwidth"), F.round("processing_gain_db", 6).alias("processing_gain_db"), "scalloping_db")

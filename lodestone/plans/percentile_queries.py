"""Exact percentiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import percentiles as P
from lodestone.plans.adapters import NETWORK_SQL, networks
from lodestone.plans.registry import query, table


@query("""SELECT l_returnflag, share, count(*) AS n, round(any_value(p), 6) AS percentile FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) JOIN
    (SELECT l_returnflag, 0.05::DOUBLE AS share, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.05) AS p FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 0.5, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 0.95, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95) FROM lineitem GROUP BY 1) USING (l_returnflag) WHERE v IS NOT NULL GROUP BY 1, 2""")
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups hold all lines."""
    own = P.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return own.withColumn("percentile", F.round("percentile", 6))


@query(f"""WITH {NETWORK_SQL}, d AS (SELECT network_id, 0.01 * sqrt(re * re + im * im) AS delta FROM networks)
    SELECT network_id, round(max(delta), 8) AS max_delta, round(sqrt(avg(delta * delta)), 8) AS rms_delta, round(quantile_cont(delta, 0.95), 8) AS percentile_delta, quantile_cont(delta, 0.95) <= 0.017 AS invariant FROM d GROUP BY 1""")
def network_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks against themselves, a little weaker."""
    own = networks(spark, sf_dir)
    got = P.invariance(own, own.withColumns({"re": F.col("re") * 0.99, "im": F.col("im") * 0.99}), limit=0.017)
    return got.withColumns({c: F.round(c, 8) for c in ("max_delta", "rms_delta", "percentile_delta")})

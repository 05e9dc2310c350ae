"""Scalar functions, file formats and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.plans.adapters import networks
from lodestone.plans.registry import query, table
from lodestone.sources import documents as J
from lodestone.sources import touchstone
from lodestone.streaming import events as E


@query("""SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1000000 + 500000 WHEN 3 THEN p_size * 25400 END AS BIGINT) AS nm FROM part""")
def parse_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(kind == 0, F.concat(size, F.lit("nm"))).when(kind == 1, F.concat(size, F.lit(" um"))).when(kind == 2, F.concat(size, F.lit(".5mm"))).when(kind == 3, F.concat(size, F.lit("mil"))).otherwise(F.concat(size, F.lit(".5nm")))
    return table(spark, sf_dir, "part").select("p_partkey", X.parse_quantity(text, "length").alias("nm"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?', '<time>', 'g'), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '[ \t]+', ' ', 'g'))) AS canonical_hash FROM pages""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_hash(F.col("html")).alias("canonical_hash"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1048576 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) WHEN b >= 1024 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE b || ' B' END AS size, round(CASE WHEN b % 10 = 0 THEN 0 ELSE b / (b % 10)::DOUBLE END, 6) AS ratio,
    (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 86400000000 AS age_days FROM (SELECT *, CAST(floor(o_totalprice * 7) AS BIGINT) AS b FROM orders)""")
def byte_sizes_and_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").withColumn("b", F.floor(F.col("o_totalprice") * 7).cast("bigint"))
    age = X.age_days(F.col("o_orderdate").cast("timestamp"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return own.select("o_orderkey", X.format_bytes(F.col("b")).alias("size"), F.round(X.safe_ratio(F.col("b"), F.col("b") % 10), 6).alias("ratio"), age.alias("age_days"))


_B32 = "CAST(('0x' || substr(d, 1, 15)) AS BIGINT)"


@query(f"""WITH h AS (SELECT doc_id, {_B32} AS v FROM (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents)) SELECT doc_id, """ + " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', CAST((v >> {55 - 5 * i}) & 31 AS INT) + 1, 1)" for i in range(12)) + " AS spec_id FROM h")
def spec_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.base32_prefix(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("spec_id"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(_events(spark, sf_dir)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT window_start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS window_start, event_type FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type FROM events) GROUP BY 1, 2""")
def event_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding(_events(spark, sf_dir)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = E.sessions(_events(spark, sf_dir))
    return own.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type AS gate, CASE WHEN bool_or(value > 495) THEN 'FAILED' ELSE 'PASSED' END AS status, count(*) AS n FROM events GROUP BY 1""")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("gate"), F.when(F.col("value") > 495, "failed").when(F.col("value") < 0, "skipped").otherwise("passed").alias("status"))
    return J.gate_status(own)


@query("""SELECT event_id, 'k' AS path FROM events WHERE props IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL""")
def json_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.leaf_paths(spark, table(spark, sf_dir, "events"), "props", "event_id").where("path = 'k'")


@query("""SELECT DISTINCT sha256(text) AS digest FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL)""")
def content_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("digest"))
    return J.put(own.where("lang <> 'en'"), own.where("lang = 'en'")).select("digest")


@query()
def touchstone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return touchstone.lines(networks(spark, sf_dir))

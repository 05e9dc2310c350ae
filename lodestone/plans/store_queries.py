"""Queries that write into stores of the engine and answer from what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.adapters import NETWORK_SQL, networks
from lodestone.plans.registry import query, table
from lodestone.plans.session import cut, new_folder
from lodestone.sources import buckets, contents, touchstone, touchstone_source, zones


@query("SELECT DISTINCT sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS byte_size, sha256(text) = sha256(text) AS intact FROM documents WHERE text IS NOT NULL")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a content: stored once by its digest, stored again to no effect, and read back."""
    root = new_folder(spark, "contents")
    texts = table(spark, sf_dir, "documents")
    contents.put(texts, root, "text")
    contents.put(texts, root, "text")
    return contents.read(spark, root).select("digest", F.octet_length("content").cast("bigint").alias("byte_size"), "intact")


#: Lines that a file of sorted lines gets, about; their number grows with the table.
LINES = 250_000


def _sorted_lines(spark: SparkSession, sf_dir: str) -> str:
    """Lines by order key, in files of many row groups, as an ingest in order leaves them."""
    path = new_folder(spark, "lines")
    lines = table(spark, sf_dir, "lineitem")
    lines.repartitionByRange(max(4, -(-lines.count() // LINES)), "l_orderkey").sortWithinPartitions("l_orderkey").write.option("parquet.block.size", 1 << 14).option("parquet.page.size", 1 << 12).option("parquet.page.row.count.limit", 500).parquet(path)
    return path


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN (SELECT CAST(max(l_orderkey) AS BIGINT) // 3 FROM lineitem) AND (SELECT CAST(max(l_orderkey) AS BIGINT) // 3 + 200 FROM lineitem) AND l_returnflag IN ('A', 'R')")
def zone_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of orders, of the row groups that a zone map leaves."""
    path = _sorted_lines(spark, sf_dir)
    lo = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] // 3
    own = zones.read_where(cut(zones.zone_map(spark, path)), path, ["l_orderkey", "l_linenumber", "l_quantity"], [("l_orderkey", ">=", lo), ("l_orderkey", "<=", lo + 200), ("l_returnflag", "in", ["A", "R"])])
    return own


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(l_shipdate) AS BIGINT) AS nulls, min(l_orderkey) AS low, max(l_orderkey) AS high, min(l_returnflag) AS low_flag, max(l_returnflag) AS high_flag FROM lineitem")
def zone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bounds of a table from its zone map alone."""
    own = zones.zone_map(spark, f"{sf_dir}/lineitem.parquet")
    of = lambda c, x: F.when(F.col("column") == c, F.col(x))
    return own.agg(F.sum(of("l_orderkey", "n_rows")).alias("n_rows"), F.sum(of("l_shipdate", "nulls")).alias("nulls"), F.min(of("l_orderkey", "low_whole")).alias("low"), F.max(of("l_orderkey", "high_whole")).alias("high"), F.min(of("l_returnflag", "low_text")).alias("low_flag"), F.max(of("l_returnflag", "high_text")).alias("high_flag"))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_totalprice > 150000 AND o_orderpriority = '5-LOW') AND o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, 'U', o_totalprice + 1 FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT -o_orderkey - 1, 'N', 0.5 FROM orders WHERE o_orderpriority = '2-HIGH'""")
def bucketed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in hash buckets: urgent ones updated, new ones added, dear ones of low priority deleted."""
    root = new_folder(spark, "buckets")
    orders = table(spark, sf_dir, "orders")
    own = lambda f: f.select("o_orderkey", "o_orderstatus", "o_totalprice")
    buckets.create(own(orders), root, ["o_orderkey"], 64)
    urgent = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    added = orders.where("o_orderpriority = '2-HIGH'").withColumn("o_orderkey", -F.col("o_orderkey") - 1).withColumn("o_orderstatus", F.lit("N")).withColumn("o_totalprice", F.lit(0.5).cast(orders.schema["o_totalprice"].dataType))
    buckets.upsert(own(urgent).union(own(added)), root)
    buckets.delete(orders.where("o_totalprice > 150000 AND o_orderpriority = '5-LOW'").select("o_orderkey"), root)
    return buckets.read(spark, root)


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN (SELECT max(o_orderkey) AS top FROM orders GROUP BY o_custkey) t ON o_orderkey = t.top")
def bucketed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, looked up by key in a bucketed table."""
    root = new_folder(spark, "buckets")
    orders = table(spark, sf_dir, "orders")
    buckets.create(orders.select("o_orderkey", "o_totalprice"), root, ["o_orderkey"], 64)
    return buckets.lookup(spark, root, orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")))


@query(f"WITH {NETWORK_SQL} SELECT network_id, f_idx, i, j, round(re, 6) AS re, round(im, 6) AS im FROM networks WHERE network_id IN ('1', '4', '7') AND freq_hz >= 3e8 AND freq_hz < 9e9")
def touchstone_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band of three networks, from one Touchstone file for each network: other files aren't opened, other points not made rows."""
    folder = new_folder(spark, "touchstone")
    touchstone.write(networks(spark, sf_dir), folder).count()
    own = touchstone_source.read(spark, folder).where("network_id IN ('1', '4', '7') AND freq_hz >= 3e8 AND freq_hz < 9e9")
    return own.select("network_id", "f_idx", "i", "j", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))

"""Queries over rule reports and specification documents of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import query, table
from lodestone.sources import reports, specs


@query(r"""WITH d AS (SELECT p_partkey, p_brand, p_size, '{"at":[' || p_size || ',' || (p_size // 2) || '.' || (p_size % 2 * 5) || '],"severity":"error","type":"clearance"}' AS a,
    '{"file_top":"' || p_brand || '.gbr","items":["z","/a/b"],"severity":"warning","type":"annulus"}' AS b FROM part)
    SELECT p_partkey, '{"board_file":"' || p_brand || '.pcb","note":"\u00e9 \"' || p_brand || '\"","nulls":[null,{},[]],"violations":[' || CASE WHEN a < b THEN a || ',' || b ELSE b || ',' || a END || ']}' AS canonical FROM d""")
def canonical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule report for each part, of names, times, paths and lists in changing order, in canonical form."""
    text = lambda c: F.col(c).cast("string")
    half = F.concat(F.floor(F.col("p_size") / 2).cast("string"), F.lit("."), (F.col("p_size") % 2 * 5).cast("string"))
    a = F.concat(F.lit('{"type": "clearance", "severity": "error", "Time": 1, "at": ['), text("p_size"), F.lit(", "), half, F.lit("0]}"))
    b = F.concat(F.lit('{"type": "annulus", "severity": "warning", "items": ["z", "/a/b"], "file_top": "out\\\\'), text("p_brand"), F.lit('.gbr", "source": {"x": [1]}}'))
    both = F.when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit(", "), b)).otherwise(F.concat(b, F.lit(", "), a))
    doc = F.concat(F.lit('{"violations": ['), both, F.lit('], "date": "'), text("p_partkey"), F.lit('", "nulls": [null, {}, []], "board_file": "/boards/'), text("p_partkey"), F.lit("/"), text("p_brand"), F.lit('.pcb", "note": "é \\"'), text("p_brand"), F.lit('\\""}'))
    return reports.canonical(table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc")), "doc", ["p_partkey"])


_SPEC = {"name": "string", "trace": {"w": "int"}, "layers": [{"t": "int"}]}


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification for each part: every fifth with a name that isn't known, every seventh without a layer's thickness."""
    text = lambda c: F.col(c).cast("string")
    more = F.when(F.col("p_partkey") % 5 == 0, ', "depth": 1').otherwise("")
    second = F.when(F.col("p_partkey") % 7 == 0, "{}").otherwise('{"t": 2}')
    doc = F.concat(F.lit('{"name": "'), text("p_brand"), F.lit('", "trace": {"w": '), text("p_size"), more, F.lit('}, "layers": [{"t": 1}, '), second, F.lit("]}"))
    return table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))


@query("SELECT p_partkey, p_brand AS name, p_size AS w, 2 AS n_layers FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def spec_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications without faults, read strictly."""
    own = specs.read(_specs(spark, sf_dir).where("p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"), "doc", _SPEC)
    return own.select("p_partkey", "spec.name", F.col("spec.trace.w").alias("w"), F.size("spec.layers").alias("n_layers"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'unknown trace.depth' WHEN p_partkey % 5 <> 0 THEN 'missing layers[1].t' ELSE 'missing layers[1].t, unknown trace.depth' END AS faults FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def spec_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the other specifications."""
    own = specs.read(_specs(spark, sf_dir), "doc", _SPEC, strict=False).where(F.size("faults") > 0)
    return own.select("p_partkey", F.array_join("faults", ", ").alias("faults"))

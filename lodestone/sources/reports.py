"""Canonical rule reports: JSON documents as text that is the same whenever they say the same, without Python.

Documents are taken apart level by level by VARIANT and put together from the deepest level upwards: a node's text is made
of its children's, which are grouped by document and parent, so a group is never more than a part of one document.

Canonical text: names in order, no spaces, non-ASCII characters as \\u escapes, numbers with a fraction or exponent as the
shortest decimal that gives the same double. Names that tell when, where and by which version a report was made go with
what they hold. Strings under names of paths, and absolute paths under any name, keep their last part only. Lists
whose order means nothing are sorted by their items' text; other lists keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import cut, dealt

#: Names that go, whatever their case.
UNSTABLE = ("date", "time", "timestamp", "generated_at", "kicad_version", "host", "source", "schema_version")
#: Names of paths, besides what begins or ends like one.
PATHS = ("path", "file", "filename", "source_file", "board_file")
PATH_LIKE = r"(_path|_file)$|^(path_|file_)"
#: How an absolute path begins.
ABSOLUTE = r"^(/|[a-zA-Z]:\\\\|\\\\\\\\)"
#: Lists whose order means nothing.
UNORDERED = ("violations", "unconnected_items", "schematic_parity")
#: Levels that a document may have, as Spark's own parser allows them.
DEEPEST = 1000
#: Documents that a task takes apart, about.
DEAL = 10_000


def quoted(text: Column) -> Column:
    """Text as a JSON string of ASCII characters only."""
    code = lambda c: F.ascii(c)  # noqa: E731  the whole code point
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}

    def escaped(c: Column) -> Column:
        over = code(c) - 0x10000
        out = F.when(code(c).between(0x20, 0x7E), c).when(over < 0, unit(code(c))).otherwise(F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00)))
        for plain, mark in named.items():
            out = F.when(c == plain, F.lit(mark)).otherwise(out)
        return out

    spelled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^ !#-\[\]-~]'), spelled).otherwise(text), F.lit('"'))


def shortest(number: Column) -> Column:
    """A double as the shortest decimal: plain from 0.0001 up to 1e16, else with an exponent of two digits at least."""
    text = number.cast("string")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    exponent = F.concat(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(power.isNull(), text).when(power.between(-4, 15), plain).otherwise(exponent)


def _leaf(value: Column, kind: Column, path: Column) -> Column:
    """The text of a value that is no object or list; path tells whether its name is one of paths, and is null in a list."""
    text = value.try_cast("string")
    last = F.when(text.contains("/"), F.substring_index(text, "/", -1)).otherwise(F.substring_index(text, "\\", -1))
    fraction = (kind == "DOUBLE") | (kind == "FLOAT") | kind.rlike(r"^DECIMAL\(\d+,[1-9]") | kind.rlike(r"^DECIMAL\(1?\d,0\)")
    string = quoted(F.when(path | (path.isNotNull() & text.rlike(ABSOLUTE)), last).otherwise(text))
    return F.when(kind == "VOID", "null").when(kind == "STRING", string).when(fraction, shortest(F.try_variant_get(value, "$", "double"))).otherwise(text)


def _node(frame: DataFrame) -> DataFrame:
    """Adds kind (OBJECT, ARRAY or a leaf's type) and a leaf's text."""
    own = frame.withColumn("kind", F.schema_of_variant("v")).withColumn("kind", F.when(F.col("kind").startswith("OBJECT"), "OBJECT").when(F.col("kind").startswith("ARRAY"), "ARRAY").otherwise(F.col("kind")))
    return own.withColumn("text", F.when(~F.col("kind").isin("OBJECT", "ARRAY"), _leaf(F.col("v"), F.col("kind"), F.col("path"))))


def canonical(frame: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys.., canonical) of every row: null for a null document, for text that isn't JSON, and where an object repeats a name.

    Whole numbers stay as they are; -0.0 becomes 0.0, as VARIANT has no negative zero in decimals. Joins are by sorting:
    the sizes that Spark expects of nodes are those of the documents' files, and a side as small as that would go through the driver.
    """
    spark = frame.sparkSession
    own = cut(frame.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("doc"), F.col(column).alias("v")))
    own = cut(dealt(own, "doc", DEAL).withColumn("v", F.try_parse_json("v")))
    # path: null in a list, where strings stay as they are; under: the name that a list goes by
    now = own.where("v IS NOT NULL").select("doc", F.lit("").alias("parent"), F.lit("0").alias("id"), F.lit("").alias("name"), F.lit(0).alias("place"), F.lit("").alias("under"), F.lit(False).alias("path"), "v")
    levels = [cut(_node(now.withColumn("path", F.lit(None).cast("boolean"))))]
    for _ in range(DEEPEST):
        inner = levels[-1].where("kind IN ('OBJECT', 'ARRAY')").select("doc", F.col("id").alias("parent"), "under", "v", (F.col("kind") == "OBJECT").alias("named"))
        rows = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(~F.col("named") | ~F.lower("key").isin(*UNSTABLE))
        path = F.when(F.col("named"), F.lower("key").isin(*PATHS) | F.lower("key").rlike(PATH_LIKE))
        name = F.when(F.col("named"), F.col("key"))
        now = rows.select("doc", "parent", F.concat("parent", F.lit("."), F.col("pos").cast("string")).alias("id"), F.coalesce(name, F.lit("")).alias("name"), F.col("pos").alias("place"), F.coalesce(name, "under").alias("under"), path.alias("path"), F.col("value").alias("v"))
        now = _node(now)
        now = cut(now.withColumn("v", F.when(F.col("text").isNull(), F.col("v"))))
        if now.isEmpty():
            break
        levels.append(now)
    done = None
    for level in reversed(levels):
        part = level.select("doc", "parent", "id", "name", "place", "under", "kind", "text")
        if done is not None:
            items = done.groupBy("doc", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "place", "text"))).alias("items"))
            part = part.join(items.hint("merge"), ["doc", "id"], "left")
            texts = F.transform("items", lambda x: x["text"])
            fields = F.transform("items", lambda x: F.concat(quoted(x["name"]), F.lit(":"), x["text"]))
            listed = F.array_join(F.when(F.col("under").isin(*UNORDERED), F.array_sort(texts)).otherwise(texts), ",")
            whole = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), F.coalesce(F.array_join(fields, ","), F.lit("")), F.lit("}"))).when(F.col("kind") == "ARRAY", F.concat(F.lit("["), F.coalesce(listed, F.lit("")), F.lit("]")))
        else:
            whole = F.when(F.col("kind") == "OBJECT", "{}").when(F.col("kind") == "ARRAY", "[]")
        done = part.select("doc", "parent", "name", "place", F.coalesce("text", whole).alias("text"))
    return own.join(done.select("doc", F.col("text").alias("canonical")).hint("merge"), "doc", "left").select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "canonical")

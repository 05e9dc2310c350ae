"""Specification documents in a column, read strictly where they lie: no document passes the driver.

`known` gives the type of each name: a Spark type's text, a mapping for an object, or a list of one such entry for a list.
Names that it doesn't know and names that a document lacks are found at whatever depth, with their path. Levels are those of
`known`, so the checks are one expression for each row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Known = str | Mapping[str, object] | list


def schema(known: Known) -> str:
    """The type of a document, as Spark writes it."""
    if isinstance(known, Mapping):
        return "struct<" + ",".join(f"`{name}`:{schema(inner)}" for name, inner in known.items()) + ">"
    if isinstance(known, list):
        return f"array<{schema(known[0])}>"
    return known


def _faults(text: Column, known: Known, path: Column) -> Column:
    """Faults of a value, given as JSON text, as an array of text."""
    if isinstance(known, Mapping):
        is_object = F.ltrim(text).startswith("{")
        have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
        under = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), name)
        names = F.array(*[F.lit(n) for n in known]).cast("array<string>")
        unknown = F.transform(F.array_except(have, names), lambda n: F.concat(F.lit("unknown "), under(n)))
        missing = F.transform(F.array_except(names, have), lambda n: F.concat(F.lit("missing "), under(n)))
        # values of an object as the JSON texts that they are
        values = F.from_json(text, "map<string,string>")
        inner = [_faults(F.try_element_at(values, F.lit(n)), k, under(F.lit(n))) for n, k in known.items() if not isinstance(k, str)]
        return F.when(text.isNull(), F.array().cast("array<string>")).when(is_object, F.concat(unknown, missing, *inner)).otherwise(F.array(F.concat(F.lit("no object "), path)))
    if isinstance(known, list):
        items = F.from_json(text, "array<string>")
        each = F.flatten(F.transform(items, lambda x, i: _faults(x, known[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(text.isNull(), F.array().cast("array<string>")).when(F.ltrim(text).startswith("["), each).otherwise(F.array(F.concat(F.lit("no list "), path)))
    return F.array().cast("array<string>")


def faults(text: Column, known: Known) -> Column:
    """What is wrong with a document, in order: unknown and missing names, objects and lists that are something else. Text that isn't JSON, and null, have the one fault "no document"; a null within a document has none."""
    readable = F.try_parse_json(text).isNotNull()
    return F.when(readable, F.array_sort(_faults(text, known, F.lit("")))).otherwise(F.array(F.lit("no document")))


def read(frame: DataFrame, column: str, known: Known, strict: bool = True) -> DataFrame:
    """The frame with `spec` (the document as a struct, null where it has faults) and `faults`. Strict: an action fails at the first document with faults, and names them."""
    found = frame.withColumn("faults", faults(F.col(column), known))
    good = F.size("faults") == 0
    otherwise = F.raise_error(F.concat(F.lit("a specification has faults: "), F.array_join("faults", ", "))).cast(schema(known)) if strict else F.lit(None)
    return found.withColumn("spec", F.when(good, F.from_json(F.col(column), schema(known))).otherwise(otherwise))

"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units by kind, in the base unit (nanometres, millidegrees, hertz, picoseconds).
UNITS = {
    "length": {"nm": "1", "um": "1000", "mm": "1000000", "mil": "25400"},
    "angle": {"mdeg": "1", "deg": "1000"},
    "frequency": {"hz": "1", "khz": "1000", "mhz": "1000000", "ghz": "1000000000"},
    "time": {"ps": "1", "ns": "1000", "us": "1000000", "ms": "1000000000"},
}
#: Lines of layer plots that tell when they were made, or are comments; time stamps and UUIDs of boards.
LAYER_NOISE = r"^G04|(?i:creation\s*date|creation\s*time)"
BOARD_STAMPS = r"\((tstamp|uuid)\s+[^)]+\)"
_QUANTITY = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def parse_quantity(text: Column, kind: str) -> Column:
    """A number with a unit as whole base units; null for what isn't one, or isn't whole after scaling. Exact decimals, no floating point."""
    number, unit = F.regexp_extract(text, _QUANTITY, 1), F.lower(F.regexp_extract(text, _QUANTITY, 2))
    scale = F.lit(None).cast("decimal(10,0)")
    for name, factor in UNITS[kind].items():
        scale = F.when(unit == name, F.lit(factor).cast("decimal(10,0)")).otherwise(scale)
    scale = F.when(unit == "", F.lit("1").cast("decimal(10,0)")).otherwise(scale)
    value = F.when(number != "", number).cast("decimal(27,9)") * scale
    return F.when(value == F.floor(value), value.cast("bigint"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def format_bytes(n: Column) -> Column:
    """Bytes with one decimal in the largest unit below 1024 of it."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.floor(n / 1024**k * 10 + 0.5) / 10)).otherwise(out)
    return out


def format_bytes_listing(n: Column) -> Column:
    """Bytes as listings show them: whole below 1024, one decimal for KB and MB, two for GB, the largest unit; ties go to the even digit."""
    shown = lambda k, places, unit: F.format_string(f"%.{places}f {unit}", F.bround(n / 1024**k, places))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, shown(1, 1, "KB")).when(n < 1024**3, shown(2, 1, "MB")).otherwise(shown(3, 2, "GB"))


def format_bytes_report(n: Column) -> Column:
    """Bytes as retention reports show them: divided by 1024 without a rest until less remains, with a decimal that is always 0."""
    out = F.concat(F.floor(n / 1024**5).cast("string"), F.lit(".0 PB"))
    for k, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(F.abs(F.floor(n / 1024**k)) < 1024, F.concat(F.floor(n / 1024**k).cast("string"), F.lit(f".0 {unit}"))).otherwise(out)
    return out


def age_days(created: Column, as_of: Column) -> Column:
    """Days between two timestamps as a number."""
    return (F.unix_micros(as_of) - F.unix_micros(created)) / 86_400_000_000


def base32_prefix(hex_digest: Column, size: int = 12) -> Column:
    """The first characters of the lowercase base32 form of a hex digest, by bit arithmetic: five bits for each."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz234567")
    bits = F.lpad(F.conv(F.substring(hex_digest, 1, 15), 16, 2), 60, "0")
    return F.concat(*[F.substring(letters, F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(min(size, 12))])


def canonical_text(text: Column) -> Column:
    """Text without what differs from run to run: timestamps and UUIDs become marks, line ends are one kind, spaces are single and trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?", "<time>")
    out = F.regexp_replace(out, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def _lines(text: Column, skip: str) -> Column:
    """Trimmed lines that aren't empty and don't match, each with a line end."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^[ \t\f\x0B]+|[ \t\f\x0B]+$", ""))
    return F.array_join(F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(skip)), lambda x: F.concat(x, F.lit("\n"))), "")


def canonical_layers(text: Column) -> Column:
    """Layer plots without comments (G04) and lines that tell when they were made."""
    return _lines(text, LAYER_NOISE)


def canonical_drills(text: Column) -> Column:
    """Drill files without comments."""
    return _lines(text, "^;")


def canonical_boards(text: Column) -> Column:
    """Board files whose time stamps and UUIDs have lost their values."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), BOARD_STAMPS, "($1)")


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)

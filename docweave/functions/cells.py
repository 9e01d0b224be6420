"""Decoding and encoding of CSV cells as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error texts name the type so.
NAMES = {"int": "an integer", "bigint": "a long", "smallint": "a short", "tinyint": "a byte", "float": "a float", "double": "a double", "boolean": "a boolean", "date": "a date", "timestamp": "a timestamp"}
_WHOLE = r"^[+-]?[0-9]+$"
_REAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?\s*$|^\s*[+-]?(NaN|Infinity)\s*$"
_DURATION = r"^\s*(-?[0-9]+)\s*(nanoseconds?|nanos?|ns|microseconds?|micros?|us|milliseconds?|millis?|ms|seconds?|secs?|s|minutes?|mins?|m|hours?|h|days?|d)\s*$"


def decode(cell: Column, kind: str, fmt: str | None = None) -> Column:
    """The typed value, or null where the cell doesn't decode. Numbers are taken whole, without padding;
    booleans are true or false in either case."""
    if kind == "boolean":
        return F.when(F.lower(cell).isin("true", "false"), F.lower(cell) == "true")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(cell.rlike(_WHOLE), cell.try_cast(kind))
    if kind in ("float", "double"):
        return F.when(cell.rlike(_REAL), F.trim(cell).try_cast(kind))
    if kind == "char":
        return F.when(F.length(cell) == 1, cell)
    if kind == "unit":
        return F.when(cell == "", F.lit(True))
    if kind == "uuid":
        return F.when(cell.rlike("^[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}$"), F.lower(cell))
    if kind in ("uri", "url"):
        return F.when(F.try_parse_url(cell, F.lit("PROTOCOL")).isNotNull() | F.lit(kind == "uri") & ~cell.rlike(r"[\s<>\"{}|\\^`]"), cell)
    if kind == "duration":
        unit = F.lower(F.regexp_extract(cell, _DURATION, 2))
        nanos = F.when(unit.startswith("n"), 1).when(unit.rlike("^(us|mic)"), 1_000).when(unit.rlike("^(ms|mil)"), 1_000_000).when(unit.startswith("s"), 1_000_000_000).when(unit.rlike("^m"), 60_000_000_000).when(unit.startswith("h"), 3_600_000_000_000).otherwise(86_400_000_000_000)
        return F.when(cell.rlike(_DURATION), F.regexp_extract(cell, _DURATION, 1).try_cast("bigint") * nanos.cast("bigint"))
    if kind == "date":
        return F.try_to_date(cell, fmt or "yyyy-MM-dd")
    if kind in ("timestamp", "timestamp_ntz"):
        return (F.try_to_timestamp(cell, F.lit(fmt)) if fmt else F.try_to_timestamp(cell)).cast(kind)
    return cell if kind == "string" else cell.try_cast(kind)


def decode_or_error(cell: Column, kind: str, fmt: str | None = None) -> Column:
    """struct(value, error)."""
    value = decode(cell, kind, fmt)
    return F.struct(value.alias("value"), F.when(value.isNull(), F.concat(F.lit("unable to decode '"), F.coalesce(cell, F.lit("")), F.lit(f"' as {NAMES.get(kind, kind)}"))).alias("error"))


def decode_optional(cell: Column, kind: str, fmt: str | None = None) -> Column:
    """struct(value, error), where an empty or missing cell is null without an error."""
    got = decode_or_error(cell, kind, fmt)
    empty = cell.isNull() | (cell == "")
    return F.struct(F.when(~empty, got["value"]).alias("value"), F.when(~empty, got["error"]).alias("error"))


def first_of(cell: Column, *kinds: str) -> Column:
    """The first decoding that works, as text."""
    return F.coalesce(*[decode(cell, k).cast("string") for k in kinds])


def one_of(cell: Column, *values: str) -> Column:
    """The cell if it is one of these literals."""
    return F.when(cell.isin(*values), cell)


def escape(cell: Column, separator: str = ",", mode: str = "auto") -> Column:
    """The cell as CSV text. auto quotes what holds the separator, a quote or a line feed; always; never."""
    cell = F.coalesce(cell, F.lit(""))
    if mode == "never":
        return cell
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    if mode == "always":
        return quoted
    return F.when(cell.contains(separator) | cell.contains('"') | cell.contains("\n"), quoted).otherwise(cell)

"""Dataclasses as Spark schemas: names and defaults for decoding rows."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import typing

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string", bytes: "binary", datetime.date: "date", datetime.datetime: "timestamp", decimal.Decimal: "decimal(38,18)"}


def _kind(hint) -> tuple[str, bool]:
    args = typing.get_args(hint)
    optional = type(None) in args
    base = next((a for a in args if a is not type(None)), hint) if args else hint
    return KINDS[base], optional


def fields(cls: type) -> list[tuple[str, str, str, bool, object]]:
    """(attribute, column name, type, optional, default) of each field; metadata {"name": ...} renames a column."""
    hints = typing.get_type_hints(cls)
    return [(f.name, f.metadata.get("name", f.name), *_kind(hints[f.name]), f.default) for f in dataclasses.fields(cls)]


def schema(cls: type) -> str:
    return ", ".join(f"`{name}` {kind}" for _, name, kind, _, _ in fields(cls))


def decode(df: DataFrame, cls: type, source: str = "row") -> DataFrame:
    """Typed columns of a headed row of strings: defaults fill what is empty, and decode_error says what fails."""
    from docweave.functions import cells as C

    columns: list[Column] = []
    errors: list[Column] = []
    for attr, name, kind, optional, default in fields(cls):
        cell = F.col(f"{source}.`{name}`")
        got = C.decode_optional(cell, kind) if optional or default is not dataclasses.MISSING else C.decode_or_error(cell, kind)
        value = got["value"]
        if default is not dataclasses.MISSING and default is not None:
            value = F.when(cell.isNull() | (cell == ""), F.lit(default).cast(kind)).otherwise(value)
        columns.append(value.alias(attr))
        errors.append(got["error"])
    return df.select("*", *columns, F.coalesce(*errors).alias("decode_error"))

"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import csv as C


def csv(df: DataFrame, path: str, separator: str = ",", header: bool = True, always: bool = False) -> None:
    df.write.option("sep", separator).option("header", header).option("quoteAll", always).option("escape", '"').csv(path)


def csv_text(df: DataFrame, path: str, columns: list[str], separator: str = ",", mode: str = "auto") -> None:
    """Lines with this package's quoting rules."""
    C.encode(df, columns, separator, mode).select("csv").write.text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)

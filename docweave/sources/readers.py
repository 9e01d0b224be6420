"""Readers. Each gives rows that the operators take; none reads more than Spark's own sources push down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings that Spark's decode() takes.
ENCODINGS = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "ascii": "US-ASCII"}
#: Where Latin-9 differs from Latin-1 (fixed values).
LATIN9 = {"¤": "€", "¦": "Š", "¨": "š", "´": "Ž", "¸": "ž", "¼": "Œ", "½": "œ", "¾": "Ÿ"}


def csv(spark: SparkSession, path: str, separator: str = ",", header: bool = False, literal_quotes: bool = False, schema: str | None = None) -> DataFrame:
    """Rows by Spark's reader, in whole files (a quoted cell may span lines); all columns are strings unless a
    schema says otherwise; rows that don't fit go to _corrupt_record."""
    r = spark.read.option("sep", separator).option("quote", "" if literal_quotes else '"').option("escape", '"').option("multiLine", True).option("header", header)
    return (r.schema(schema) if schema else r).csv(path)


def csv_lines(spark: SparkSession, path: str, separator: str = ",", header: bool = False) -> DataFrame:
    """The same for files without quoted line ends, which Spark may split."""
    return spark.read.option("sep", separator).option("escape", '"').option("header", header).csv(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc: one JSON text a line."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("doc"))


def whole_texts(spark: SparkSession, path: str, encoding: str = "utf8") -> DataFrame:
    """path and doc: one text a file (JSON with many values, XML with many roots, CSV with line numbers)."""
    files = spark.read.format("binaryFile").load(path)
    if encoding == "latin9":
        text = F.translate(F.decode("content", "ISO-8859-1"), "".join(LATIN9), "".join(LATIN9.values()))
    else:
        text = F.decode("content", ENCODINGS[encoding])
    return files.select("path", text.alias("doc"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path and data: CBOR or MessagePack, one blob a file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.option("rowTag", row_tag).xml(path)


def literal(spark: SparkSession, *docs: str) -> DataFrame:
    """Inline documents."""
    return spark.createDataFrame([(d,) for d in docs], "doc string")

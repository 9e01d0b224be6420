"""CSV operators. A raw row is an array of strings; a headed row is a struct of named columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import cells as C

ROWS = "struct<rows:array<struct<line:bigint,cells:array<string>>>,error:string>"


class CsvError(ValueError):
    pass


def parse_rows(text: str, separator: str = ",", literal_quotes: bool = False) -> Iterator[tuple[int, list[str]]]:
    """(line, cells) of each row. Empty lines are skipped but counted; CRLF and LF end a row, a lone CR is data;
    a quoted cell may span lines."""
    at, end, line, start, row = 0, len(text), 1, 1, []
    while at < end or row:
        quoted = not literal_quotes and text.startswith('"', at)
        if quoted:
            parts, at = [], at + 1
            while True:
                close = text.find('"', at)
                if close < 0:
                    raise CsvError(f"unexpected end of input in a quoted cell (line {line})")
                parts.append(text[at:close])
                at = close + 1
                if not text.startswith('"', at):
                    break
                parts.append('"')
                at += 1
            cell = "".join(parts)
            line += cell.count("\n")
        else:
            stop = min((p for p in (text.find(separator, at), text.find("\n", at)) if p >= 0), default=end)
            cell, at = text[at:stop], stop
            if text.startswith("\n", at) and cell.endswith("\r"):
                cell = cell[:-1]
        if text.startswith(separator, at):
            row.append(cell)
            at += 1
            if at >= end:
                row.append("")
                yield start, row
                return
            continue
        if quoted and text.startswith("\r\n", at):
            at += 1
        if at < end and text[at] != "\n":
            raise CsvError(f"unexpected character after a quoted cell (line {line})")
        at += 1
        if row or cell or quoted:
            yield start, [*row, cell]
        line += 1
        start, row = line, []


def _parsed(df: DataFrame, text: str, separator: str, literal_quotes: bool) -> DataFrame:
    def whole(t):
        out, it = [], parse_rows(t or "", separator, literal_quotes)
        try:
            for r in it:
                out.append(r)
        except CsvError as e:
            return out, str(e)
        return out, None

    df = df.withColumn("dw_r", F.udf(whole, ROWS, useArrow=True)(F.col(text)))
    return df.withColumn("csv_error", F.col("dw_r.error"))


def rows(df: DataFrame, text: str, separator: str = ",", literal_quotes: bool = False) -> DataFrame:
    """A row for each CSV row of each text, with line and cells; csv_error says why a text stops early."""
    return _parsed(df, text, separator, literal_quotes).withColumn("dw_x", F.explode("dw_r.rows")).select("*", "dw_x.*").drop("dw_r", "dw_x")


def with_headers(df: DataFrame, headers: list[str], cells: str = "cells") -> DataFrame:
    """Adds row, a struct of named cells, and header_error where the width differs (row is null then)."""
    fits = F.size(cells) == len(headers)
    named = F.struct(*[F.get(F.col(cells), F.lit(i)).alias(h) for i, h in enumerate(headers)])
    return df.withColumn("row", F.when(fits, named)).withColumn("header_error", F.when(~fits, F.concat(F.lit("row has "), F.size(cells).cast("string"), F.lit(f" cells, headers are {len(headers)}"))))


def first_headers(df: DataFrame, text: str, separator: str = ",", literal_quotes: bool = False) -> DataFrame:
    """Rows of each text below its first row, whose cells name the columns: row is a map of named cells,
    header_error says where the width differs (row is null then). Texts may have different headers."""
    parsed = _parsed(df, text, separator, literal_quotes)
    parsed = parsed.withColumn("headers", F.get("dw_r.rows", F.lit(0))["cells"])
    below = parsed.withColumn("dw_x", F.explode(F.slice("dw_r.rows", 2, F.greatest(F.size("dw_r.rows"), F.lit(1))))).select("*", "dw_x.*").drop("dw_r", "dw_x")
    fits = F.size("cells") == F.size("headers")
    unique = F.size(F.array_distinct("headers")) == F.size("headers")
    wrong = F.when(~unique, F.lit("duplicate headers")).when(~fits, F.concat(F.lit("row has "), F.size("cells").cast("string"), F.lit(" cells, headers are "), F.size("headers").cast("string")))
    return below.withColumn("header_error", wrong).withColumn("row", F.when(F.col("header_error").isNull(), F.map_from_arrays("headers", "cells")))


def skip_headers(df: DataFrame, text: str, separator: str = ",", literal_quotes: bool = False) -> DataFrame:
    """Rows of each text without its first."""
    parsed = _parsed(df, text, separator, literal_quotes)
    return parsed.withColumn("dw_x", F.explode(F.slice("dw_r.rows", 2, F.greatest(F.size("dw_r.rows"), F.lit(1))))).select("*", "dw_x.*").drop("dw_r", "dw_x")


def decode_columns(df: DataFrame, kinds: dict[str, str], source: str = "row", strict: bool = False) -> DataFrame:
    """Adds a typed column for each name, and decode_error: the first failure (with strict, raised)."""
    got = {name: C.decode_or_error(F.col(f"{source}.`{name}`"), kind.removesuffix("?")) if not kind.endswith("?") else C.decode_optional(F.col(f"{source}.`{name}`"), kind.removesuffix("?")) for name, kind in kinds.items()}
    error = F.when(F.col(source).isNotNull(), F.coalesce(*[g["error"] for g in got.values()]))
    if strict:
        error = F.when(error.isNull(), error).otherwise(F.raise_error(error).cast("string"))
    return df.select("*", *[g["value"].alias(n) for n, g in got.items()], error.alias("decode_error"))


def decode_positions(df: DataFrame, kinds: list[str], cells: str = "cells") -> DataFrame:
    """The same by position, as _0, _1, ..."""
    names = [f"_{i}" for i in range(len(kinds))]
    return decode_columns(with_headers(df, names, cells), dict(zip(names, kinds)))


def encode_row(cells: Column, separator: str = ",", mode: str = "auto") -> Column:
    """One CSV line (without its end) from an array of strings."""
    return F.array_join(F.transform(cells, lambda c: C.escape(c, separator, mode)), separator)


def encode(df: DataFrame, columns: list[str], separator: str = ",", mode: str = "auto", out: str = "csv") -> DataFrame:
    return df.withColumn(out, F.concat_ws(separator, *[C.escape(F.col(c).cast("string"), separator, mode) for c in columns]))


def header_line(columns: list[str], separator: str = ",", mode: str = "auto") -> Column:
    return encode_row(F.array(*map(F.lit, columns)), separator, mode)


def checked_row(cells: Column, headers: list[str], separator: str = ",", mode: str = "auto") -> Column:
    """struct(csv, error): a line, or an error where the width isn't that of the headers."""
    fits = F.size(cells) == len(headers)
    error = F.concat(F.lit("row has "), F.size(cells).cast("string"), F.lit(f" cells, headers are {len(headers)}"))
    return F.struct(F.when(fits, encode_row(cells, separator, mode)).alias("csv"), F.when(~fits, error).alias("error"))


def collect_text(line: Column, order: Column, head: Column | None = None, newline: str = "\n") -> Column:
    """An aggregate: a group's lines as one text in the order given, each with its end, under a header line."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: F.concat(x["l"], F.lit(newline)))
    text = F.array_join(body, "")
    return text if head is None else F.concat(head, F.lit(newline), text)


# Accessors on an array of cells; an index out of range changes nothing, as the whole row is at hand.


def at(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i))


def as_type(cells: Column, i: int, kind: str) -> Column:
    unknown = F.size(cells) <= i
    got = C.decode_or_error(at(cells, i), kind)
    return F.struct(got["value"].alias("value"), F.when(unknown, F.lit(f"unknown index {i}")).otherwise(got["error"]).alias("error"))


def modify_at(cells: Column, i: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(cells, lambda c, k: F.when(k == i, f(c)).otherwise(c))


def updated_at(cells: Column, i: int, value: str) -> Column:
    return modify_at(cells, i, lambda c: F.lit(value))


def delete_at(cells: Column, i: int) -> Column:
    """Null when nothing would be left."""
    left = F.filter(cells, lambda c, k: k != i)
    return F.when(F.size(left) > 0, left)


def set_cell(headers: list[str], cells: Column, name: str, value: Column) -> tuple[list[str], Column]:
    """Replaces the named cell, or appends it."""
    if name in headers:
        return headers, modify_at(cells, headers.index(name), lambda c: value)
    return [*headers, name], F.concat(cells, F.array(value))


def to_map(headers: list[str], cells: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, headers)), cells)

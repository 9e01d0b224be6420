"""CBOR and MessagePack operators on binary columns, in Arrow batches. Bytes that don't decode give null;
the validate functions say why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.functions import cbor as C
from docweave.functions import items as I
from docweave.functions import jsontext as J
from docweave.functions import msgpack as M
from docweave.functions import typed


ITEMS = "array<struct<kind:string,value:string>>"


def _udf(f: Callable, kind: str):
    def safe(x):
        try:
            return None if x is None else f(x)
        except (C.CborError, M.MsgpackError, J.JsonError, RecursionError):
            return None

    return F.udf(safe, kind, useArrow=True)


def cbor_to_json(data: Column) -> Column:
    """JSON texts of all values, one a line."""
    return _udf(lambda b: "\n".join(J.compact(C.to_json(x)) for x in C.items(bytes(b))), "string")(data)


def json_to_cbor(doc: Column) -> Column:
    return _udf(lambda t: b"".join(C.encode(C.from_json(v)) for v in J.values(t)), "binary")(doc)


def cbor_diagnostic(data: Column) -> Column:
    return _udf(lambda b: "\n".join(C.diagnostic(x) for x in C.items(bytes(b))), "string")(data)


def cbor_validate(data: Column) -> Column:
    return _udf(lambda b: C.validate(bytes(b)), "string")(data)


def cbor_encode(row: Column) -> Column:
    """A struct (through its JSON form) as a CBOR map of definite length."""
    return _udf(lambda t: C.encode(J.to_python(J.parse(t))), "binary")(F.to_json(row, {"ignoreNullFields": "false"}))


def msgpack_encode(row: Column) -> Column:
    """A struct (through its JSON form) as a MessagePack map."""
    return _udf(lambda t: M.encode(J.to_python(J.parse(t))), "binary")(F.to_json(row, {"ignoreNullFields": "false"}))


def json_to_msgpack(doc: Column) -> Column:
    return _udf(lambda t: b"".join(M.encode(J.to_python(v)) for v in J.values(t)), "binary")(doc)


def msgpack_to_json(data: Column) -> Column:
    """JSON texts of all values, one a line."""
    return _udf(lambda b: "\n".join(J.compact(J.from_python(M.plain(x))) for x in M.values(bytes(b))), "string")(data)


def msgpack_validate(data: Column) -> Column:
    return _udf(lambda b: M.validate(bytes(b)), "string")(data)


def decode_as(json_text: Column, schema: str) -> Column:
    """The typed row of a decoded value."""
    return F.from_json(json_text, schema)


def cbor_items(data: Column) -> Column:
    """Flat items of the bytes, heads as they come."""
    return _udf(lambda b: list(I.cbor(bytes(b))), ITEMS)(data)


def cbor_from_items(items: Column, checked: bool = True) -> Column:
    """Bytes of items; with checked, null unless they are whole values."""
    return _udf(lambda xs: I.to_cbor(((x[0], x[1]) for x in xs), checked), "binary")(items)


def msgpack_items(data: Column) -> Column:
    return _udf(lambda b: list(I.msgpack(bytes(b))), ITEMS)(data)


def msgpack_from_items(items: Column, checked: bool = True) -> Column:
    return _udf(lambda xs: I.to_msgpack(((x[0], x[1]) for x in xs), checked), "binary")(items)


def msgpack_serialize(df: DataFrame, columns: list[str], out: str = "data") -> DataFrame:
    """The columns as a MessagePack map by name, typed: binary as bin, timestamps as the timestamp extension."""
    schema = df.select(*columns).schema

    def run(x):
        return M.encode(typed.to_msgpack(x, schema))

    return df.withColumn(out, _udf(run, "binary")(F.struct(*columns)))


def msgpack_deserialize(df: DataFrame, data: str, schema: str, out: str = "row") -> DataFrame:
    """The first value of the bytes as a struct of the schema, and msgpack_error: another kind of value, a number
    beyond its type, bytes that aren't MessagePack."""
    kind = StructType.fromDDL(schema)

    def run(b):
        try:
            return None if b is None else (typed.from_msgpack(next(M.values(bytes(b)), None), kind), None)
        except M.MsgpackError as e:
            return None, str(e)

    got = F.udf(run, StructType().add("value", kind).add("error", "string"), useArrow=True)(F.col(data))
    return df.withColumn("dw_d", got).withColumn(out, F.col("dw_d.value")).withColumn("msgpack_error", F.col("dw_d.error")).drop("dw_d")

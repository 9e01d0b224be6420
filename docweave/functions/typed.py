"""Values of Spark's types to MessagePack values and back, by schema."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import types as T

from docweave.functions import msgpack as M

EPOCH = datetime.datetime(1970, 1, 1)
_RANGE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def to_msgpack(x, kind: T.DataType):
    """Structs become maps by name, timestamps the extension of their own, floats 4 bytes, decimals strings."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: to_msgpack(v, f.dataType) for f, v in zip(kind.fields, (x[f.name] for f in kind.fields) if isinstance(x, dict) else x)}
    if isinstance(kind, T.ArrayType):
        return [to_msgpack(v, kind.elementType) for v in x]
    if isinstance(kind, T.MapType):
        pairs = x.items() if isinstance(x, dict) else x
        return M.Pairs(tuple((to_msgpack(k, kind.keyType), to_msgpack(v, kind.valueType)) for k, v in pairs))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # Spark hands instants over without a zone, in the worker's local time
        at = x.astimezone(datetime.timezone.utc).replace(tzinfo=None) if isinstance(kind, T.TimestampType) else x
        micros = (at - EPOCH) // datetime.timedelta(microseconds=1)
        return M.Timestamp(micros // 1_000_000, micros % 1_000_000 * 1000)
    if isinstance(kind, T.FloatType):
        return M.Float32(x)
    if isinstance(kind, T.BinaryType):
        return bytes(x)
    if isinstance(x, (decimal.Decimal, datetime.date)):
        return str(x)
    return x


def from_msgpack(x, kind: T.DataType):
    """Raises MsgpackError for another kind of value or a number beyond the type; nil and missing fields are null."""
    if x is None:
        return None
    wrong = M.MsgpackError(f"{type(x).__name__} where {kind.simpleString()} is expected")
    if isinstance(kind, T.StructType):
        if not isinstance(x, M.Pairs):
            raise wrong
        got = {k: v for k, v in x.items if isinstance(k, str)}
        return {f.name: from_msgpack(got.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        if type(x) is not list:
            raise wrong
        return [from_msgpack(v, kind.elementType) for v in x]
    if isinstance(kind, T.MapType):
        if not isinstance(x, M.Pairs):
            raise wrong
        return {from_msgpack(k, kind.keyType): from_msgpack(v, kind.valueType) for k, v in x.items}
    if type(kind) in _RANGE:
        if type(x) is not int:
            raise wrong
        if not -(1 << _RANGE[type(kind)]) <= x < 1 << _RANGE[type(kind)]:
            raise M.MsgpackError(f"{x} exceeds {kind.simpleString()}")
        return x
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if not isinstance(x, M.Timestamp):
            raise wrong
        return EPOCH.replace(tzinfo=datetime.timezone.utc if isinstance(kind, T.TimestampType) else None) + datetime.timedelta(seconds=x.seconds, microseconds=x.nanos // 1000)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        if isinstance(x, M.Float32):
            return x.value
        if type(x) in (int, float):
            return float(x)
        raise wrong
    if isinstance(kind, T.DecimalType):
        try:
            return decimal.Decimal(x)
        except (TypeError, ValueError, decimal.InvalidOperation):
            raise wrong from None
    if isinstance(kind, T.DateType):
        try:
            return datetime.date.fromisoformat(x)
        except (TypeError, ValueError):
            raise wrong from None
    want = {T.StringType: str, T.BinaryType: bytes, T.BooleanType: bool}.get(type(kind))
    if want is None or type(x) is not want:
        raise wrong
    return x

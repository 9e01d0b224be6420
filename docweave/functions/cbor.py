"""CBOR (RFC 7049) values, diagnostic notation, and JSON both ways."""

from __future__ import annotations

import base64
import math
import struct
from dataclasses import dataclass
from decimal import Decimal

from docweave.functions import jsontext as J


class CborError(ValueError):
    pass


@dataclass(frozen=True)
class Tag:
    number: int
    value: object


@dataclass(frozen=True)
class Simple:
    value: int


@dataclass(frozen=True)
class Float:
    """A float and the bytes it took."""

    value: float
    size: int


@dataclass(frozen=True)
class Pairs:
    """A map with any keys; indefinite says how it was written."""

    items: tuple
    indefinite: bool = False


class Items(list):
    indefinite = False


class Chunks(list):
    """An indefinite string, as its chunks."""


UNDEFINED = Simple(23)
_BREAK = object()
DEPTH = 500


def _head(data: bytes, at: int) -> tuple[int, int | None, int, int]:
    """major type, argument (None if indefinite), low bits, next place."""
    if at >= len(data):
        raise CborError("unexpected end of input")
    major, low = data[at] >> 5, data[at] & 31
    if low < 24:
        return major, low, low, at + 1
    if low < 28:
        n = 1 << (low - 24)
        if at + 1 + n > len(data):
            raise CborError("unexpected end of input")
        return major, int.from_bytes(data[at + 1 : at + 1 + n]), low, at + 1 + n
    if low == 31 and major in (2, 3, 4, 5, 7):
        return major, None, low, at + 1
    raise CborError(f"additional information {low} is reserved")


def _item(data: bytes, at: int, depth: int = 0):
    if depth > DEPTH:
        raise CborError("nested too deep")
    major, n, low, at = _head(data, at)
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n is None:
            out = Chunks()
            while True:
                m, k, _, _ = _head(data, at)
                if m == 7 and k is None:
                    return out, at + 1
                if m != major or k is None:
                    raise CborError("a chunk of the same kind and definite length is expected")
                x, at = _item(data, at, depth + 1)
                out.append(x)
        if at + n > len(data):
            raise CborError("unexpected end of input")
        raw = data[at : at + n]
        try:
            return (raw if major == 2 else raw.decode()), at + n
        except UnicodeDecodeError:
            raise CborError("a text string isn't UTF-8") from None
    if major in (4, 5):
        out, left = Items(), math.inf if n is None else n * (major - 3)
        out.indefinite = n is None
        while left > 0:
            x, at = _item(data, at, depth + 1)
            if x is _BREAK:
                if n is not None or major == 5 and len(out) % 2:
                    raise CborError("unexpected break")
                break
            out.append(x)
            left -= 1
        return (out, at) if major == 4 else (Pairs(tuple(zip(out[::2], out[1::2])), n is None), at)
    if major == 6:
        x, at = _item(data, at, depth + 1)
        if x is _BREAK:
            raise CborError("unexpected break")
        return Tag(n, x), at
    if n is None:
        return _BREAK, at
    if low in (25, 26, 27):
        size = 1 << (low - 24)
        return Float(struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], data[at - size : at])[0], size), at
    if low == 24 and n < 32:
        raise CborError(f"simple value {n} takes no second byte")
    return {20: False, 21: True, 22: None}.get(n, Simple(n)), at


def items(data: bytes):
    """All values of the bytes, tags and floats as they are."""
    at = 0
    while at < len(data):
        x, at = _item(data, at)
        if x is _BREAK:
            raise CborError("unexpected break")
        yield x


def validate(data: bytes) -> str | None:
    """Why the bytes aren't CBOR, or None."""
    try:
        for _ in items(data):
            pass
    except CborError as e:
        return str(e)
    return None


def value(x):
    """High-level value: strings joined, bignums (unsigned bytes) as int, decimal fractions as Decimal, other tags kept."""
    if isinstance(x, Chunks):
        return (b"" if x and isinstance(x[0], bytes) else "").join(x) if x else b""
    if isinstance(x, Tag):
        v = value(x.value)
        if x.number in (2, 3) and isinstance(v, bytes):
            return int.from_bytes(v) if x.number == 2 else -1 - int.from_bytes(v)
        if x.number == 4 and isinstance(v, list) and len(v) == 2 and all(isinstance(i, int) for i in v):
            return Decimal(v[1]).scaleb(v[0])
        return Tag(x.number, v)
    if isinstance(x, Pairs):
        return Pairs(tuple((value(k), value(v)) for k, v in x.items))
    if isinstance(x, list):
        return [value(v) for v in x]
    return x.value if isinstance(x, Float) else x


def _length(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | low]) + n.to_bytes(size)
    raise CborError("a length takes more than 8 bytes")


def encode(x) -> bytes:
    """Definite containers; ints as short as they go, beyond 64 bits as bignums; floats of 8 bytes unless Float."""
    if x is None or isinstance(x, bool):
        return {False: b"\xf4", True: b"\xf5", None: b"\xf6"}[x]
    if isinstance(x, int):
        n = x if x >= 0 else -1 - x
        if n < 1 << 64:
            return _length(0 if x >= 0 else 1, n)
        return encode(Tag(2 if x >= 0 else 3, n.to_bytes((n.bit_length() + 7) // 8)))
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, Float):
        return bytes([{2: 0xF9, 4: 0xFA, 8: 0xFB}[x.size]]) + struct.pack({2: ">e", 4: ">f", 8: ">d"}[x.size], x.value)
    if isinstance(x, Decimal):
        sign, digits, exponent = x.as_tuple()
        return encode(Tag(4, [exponent, int("".join(map(str, digits))) * (-1 if sign else 1)]))
    if isinstance(x, bytes):
        return _length(2, len(x)) + x
    if isinstance(x, str):
        raw = x.encode()
        return _length(3, len(raw)) + raw
    if isinstance(x, Chunks):
        return bytes([(2 if x and isinstance(x[0], bytes) else 3) << 5 | 31]) + b"".join(map(encode, x)) + b"\xff"
    if isinstance(x, (Pairs, dict)):
        pairs = x.items if isinstance(x, Pairs) else tuple(x.items())
        body = b"".join(encode(k) + encode(v) for k, v in pairs)
        return b"\xbf" + body + b"\xff" if isinstance(x, Pairs) and x.indefinite else _length(5, len(pairs)) + body
    if isinstance(x, list):
        body = b"".join(map(encode, x))
        return b"\x9f" + body + b"\xff" if getattr(x, "indefinite", False) else _length(4, len(x)) + body
    if isinstance(x, Tag):
        return _length(6, x.number) + encode(x.value)
    if isinstance(x, Simple):
        return bytes([0xE0 | x.value]) if x.value < 24 else bytes([0xF8, x.value])
    raise CborError(f"no CBOR for {type(x).__name__}")


def diagnostic(x) -> str:
    """RFC 7049 diagnostic notation."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, int):
        return str(x)
    if isinstance(x, Float):
        name = "NaN" if math.isnan(x.value) else ("-" if x.value < 0 else "") + "Infinity" if math.isinf(x.value) else repr(x.value)
        return f"{name}_{ {2: 1, 4: 2, 8: 3}[x.size] }"
    if isinstance(x, bytes):
        return f"h'{x.hex().upper()}'"
    if isinstance(x, str):
        return f'"{x}"'
    if isinstance(x, Chunks):
        return "(_ " + ", ".join(map(diagnostic, x)) + ")"
    if isinstance(x, Pairs):
        return ("{_ " if x.indefinite else "{") + ", ".join(f"{diagnostic(k)}: {diagnostic(v)}" for k, v in x.items) + "}"
    if isinstance(x, list):
        return ("[_ " if getattr(x, "indefinite", False) else "[") + ", ".join(map(diagnostic, x)) + "]"
    if isinstance(x, Tag):
        return f"{x.number}({diagnostic(x.value)})"
    return "undefined" if x == UNDEFINED else f"simple({x.value})"


def to_json(x, how: int = 21):
    """JSON value: bytes by the nearest tag 21 (base64url), 22 (base64) or 23 (base16), big numbers as numbers."""
    if isinstance(x, Chunks):
        return to_json(value(x), how)
    if isinstance(x, Tag):
        if x.number in (21, 22, 23):
            return to_json(x.value, x.number)
        v = value(x)
        return J.Num(v) if isinstance(v, (int, Decimal)) else to_json(x.value, how)
    if isinstance(x, bytes):
        return {21: lambda: base64.urlsafe_b64encode(x).decode().rstrip("="), 22: lambda: base64.b64encode(x).decode(), 23: lambda: x.hex().upper()}[how]()
    if isinstance(x, Pairs):
        out = J.Obj()
        for k, v in x.items:
            k = to_json(k, how)
            out.append((k if type(k) is str else J.compact(k), to_json(v, how)))
        return out
    if isinstance(x, list):
        return [to_json(v, how) for v in x]
    if isinstance(x, (Float, float)):
        f = x.value if isinstance(x, Float) else x
        return J.Num(repr(f)) if math.isfinite(f) else ("NaN" if math.isnan(f) else "Infinity" if f > 0 else "-Infinity")
    if isinstance(x, Simple):
        return "undefined" if x == UNDEFINED else f"simple({x.value})"
    return J.Num(x) if isinstance(x, int) and not isinstance(x, bool) else x


def from_json(v):
    """CBOR of a JSON value: indefinite containers; whole numbers as ints, fractions as the least float that is exact,
    else a decimal fraction."""
    if isinstance(v, J.Obj):
        return Pairs(tuple((k, from_json(x)) for k, x in v), True)
    if isinstance(v, list):
        out = Items(from_json(x) for x in v)
        out.indefinite = True
        return out
    if isinstance(v, J.Num):
        d = Decimal(v)
        if d == d.to_integral_value() and d.adjusted() < 400:
            return int(d)
        for size, code in ((4, ">f"), (8, ">d")):
            try:
                f = struct.unpack(code, struct.pack(code, float(d)))[0]
            except OverflowError:
                continue
            if math.isfinite(f) and Decimal(repr(f)) == d:
                return Float(f, size)
        return d
    return v

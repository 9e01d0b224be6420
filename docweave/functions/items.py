"""Flat items of CBOR and MessagePack bytes: (kind, text) pairs, one for each header, and bytes from items.

Containers and tags come before what they hold, with their size or number as text; byte strings are in hex.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from docweave.functions import cbor as C
from docweave.functions import msgpack as M

Item = tuple[str, str | None]
_STRINGS = {2: ("bytes", "start_bytes"), 3: ("text", "start_text")}
_FLOATS = {25: (">e", "float16"), 26: (">f", "float32"), 27: (">d", "float64")}
_NAMED = {20: "false", 21: "true", 22: "null", 23: "undefined"}


def cbor(data: bytes) -> Iterator[Item]:
    """Heads are read alone: whether items nest rightly is for validation to say."""
    at = 0
    while at < len(data):
        major, n, low, at = C._head(data, at)
        if major < 2:
            yield ("uint", str(n)) if major == 0 else ("nint", str(-1 - n))
        elif major in _STRINGS:
            if n is None:
                yield _STRINGS[major][1], None
                continue
            raw = data[at : at + n]
            if len(raw) < n:
                raise C.CborError("unexpected end of input")
            at += n
            try:
                yield _STRINGS[major][0], raw.hex() if major == 2 else raw.decode()
            except UnicodeDecodeError:
                raise C.CborError("a text string isn't UTF-8") from None
        elif major in (4, 5):
            yield ("array" if major == 4 else "map"), None if n is None else str(n)
        elif major == 6:
            yield "tag", str(n)
        elif n is None:
            yield "break", None
        elif low in _FLOATS:
            form, kind = _FLOATS[low]
            size = struct.calcsize(form)
            yield kind, repr(struct.unpack(form, data[at - size : at])[0])
        else:
            yield (_NAMED[n], None) if n in _NAMED else ("simple", str(n))


def to_cbor(items: Iterable[Item], checked: bool = True) -> bytes:
    """With checked, raises CborError unless the items are whole values."""
    out = bytearray()
    for kind, s in items:
        if kind in ("uint", "nint"):
            n = int(s)
            if (n < 0) != (kind == "nint"):
                raise C.CborError(f"{s} is no {kind}")
            out += C._length(int(kind == "nint"), n if n >= 0 else -1 - n)
        elif kind in ("bytes", "text"):
            out += C.encode(bytes.fromhex(s) if kind == "bytes" else s)
        elif kind in ("start_bytes", "start_text", "break"):
            out.append({"start_bytes": 0x5F, "start_text": 0x7F, "break": 0xFF}[kind])
        elif kind in ("array", "map"):
            major = 4 if kind == "array" else 5
            out += bytes([major << 5 | 31]) if s is None else C._length(major, int(s))
        elif kind == "tag":
            out += C._length(6, int(s))
        elif kind.startswith("float"):
            out += C.encode(C.Float(float(s), int(kind[5:]) // 8))
        elif kind == "simple":
            out += C.encode(C.Simple(int(s)))
        else:
            code = next((k for k, name in _NAMED.items() if name == kind), None)
            if code is None:
                raise C.CborError(f"no item: {kind}")
            out.append(0xE0 | code)
    if checked and (wrong := C.validate(bytes(out))):
        raise C.CborError(wrong)
    return bytes(out)


def msgpack(data: bytes) -> Iterator[Item]:
    for x in M.values(data):
        yield from _msgpack(x)


def _msgpack(x) -> Iterator[Item]:
    if x is None or isinstance(x, bool):
        yield {None: "nil", True: "true", False: "false"}[x], None
    elif isinstance(x, int):
        yield "int", str(x)
    elif isinstance(x, float):
        yield "float64", repr(x)
    elif isinstance(x, M.Float32):
        yield "float32", repr(x.value)
    elif isinstance(x, str):
        yield "str", x
    elif isinstance(x, bytes):
        yield "bin", x.hex()
    elif isinstance(x, M.Timestamp):
        yield "timestamp", f"{x.seconds}:{x.nanos}"
    elif isinstance(x, M.Ext):
        yield "ext", f"{x.kind}:{x.data.hex()}"
    elif isinstance(x, M.Pairs):
        yield "map", str(len(x.items))
        for k, v in x.items:
            yield from _msgpack(k)
            yield from _msgpack(v)
    else:
        yield "array", str(len(x))
        for v in x:
            yield from _msgpack(v)


def to_msgpack(items: Iterable[Item], checked: bool = True) -> bytes:
    """With checked, raises MsgpackError unless the items are whole values."""
    out = bytearray()
    for kind, s in items:
        if kind in ("array", "map"):
            out += M._sized(int(s), (0x90, 15) if kind == "array" else (0x80, 15), {2: 0xDC, 4: 0xDD} if kind == "array" else {2: 0xDE, 4: 0xDF})
            continue
        if kind in ("timestamp", "ext"):
            a, b = s.split(":")
            x = M.Timestamp(int(a), int(b)) if kind == "timestamp" else M.Ext(int(a), bytes.fromhex(b))
        elif kind in ("nil", "true", "false"):
            x = {"nil": None, "true": True, "false": False}[kind]
        elif kind in ("int", "float32", "float64", "str", "bin"):
            x = {"int": int, "float32": lambda t: M.Float32(float(t)), "float64": float, "str": str, "bin": bytes.fromhex}[kind](s)
        else:
            raise M.MsgpackError(f"no item: {kind}")
        out += M.encode(x)
    if checked and (wrong := M.validate(bytes(out))):
        raise M.MsgpackError(wrong)
    return bytes(out)

"""MessagePack values, with extensions and the three timestamp forms."""

from __future__ import annotations

import struct
from dataclasses import dataclass


class MsgpackError(ValueError):
    pass


@dataclass(frozen=True)
class Ext:
    kind: int
    data: bytes


@dataclass(frozen=True)
class Timestamp:
    seconds: int
    nanos: int = 0


@dataclass(frozen=True)
class Pairs:
    items: tuple


@dataclass(frozen=True)
class Float32:
    value: float


DEPTH = 500
#: Formats with a length of so many bytes: kind, size.
_SIZED = {0xC4: ("bin", 1), 0xC5: ("bin", 2), 0xC6: ("bin", 4), 0xD9: ("str", 1), 0xDA: ("str", 2), 0xDB: ("str", 4), 0xDC: ("array", 2), 0xDD: ("array", 4), 0xDE: ("map", 2), 0xDF: ("map", 4), 0xC7: ("ext", 1), 0xC8: ("ext", 2), 0xC9: ("ext", 4)}
_NUMBER = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def _item(data: bytes, at: int, depth: int = 0):
    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise MsgpackError(f"unexpected end of input at {at}")
        at += n
        return data[at - n : at]

    if depth > DEPTH:
        raise MsgpackError("nested too deep")
    b = take(1)[0]
    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if b in _NUMBER:
        x = struct.unpack(_NUMBER[b], take(struct.calcsize(_NUMBER[b])))[0]
        return (Float32(x) if b == 0xCA else x), at
    if 0xD4 <= b <= 0xD8:
        kind, n = "ext", 1 << (b - 0xD4)
    elif b in _SIZED:
        kind, size = _SIZED[b]
        n = int.from_bytes(take(size))
    elif b < 0x90:
        kind, n = "map", b & 15
    elif b < 0xA0:
        kind, n = "array", b & 15
    elif b < 0xC0:
        kind, n = "str", b & 31
    else:
        raise MsgpackError(f"0x{b:02x} is reserved (at {at - 1})")
    if kind == "bin":
        return take(n), at
    if kind == "str":
        try:
            return take(n).decode(), at
        except UnicodeDecodeError:
            raise MsgpackError("a string isn't UTF-8") from None
    if kind == "ext":
        code = struct.unpack(">b", take(1))[0]
        raw = take(n)
        return (_timestamp(raw) if code == -1 else Ext(code, raw)), at
    out = []
    for _ in range(n * (2 if kind == "map" else 1)):
        x, at = _item(data, at, depth + 1)
        out.append(x)
    return (out if kind == "array" else Pairs(tuple(zip(out[::2], out[1::2])))), at


def _timestamp(raw: bytes) -> Timestamp:
    if len(raw) == 4:
        return Timestamp(int.from_bytes(raw))
    if len(raw) == 8:
        n = int.from_bytes(raw)
        t = Timestamp(n & (1 << 34) - 1, n >> 34)
    elif len(raw) == 12:
        t = Timestamp(int.from_bytes(raw[4:], signed=True), int.from_bytes(raw[:4]))
    else:
        raise MsgpackError(f"a timestamp of {len(raw)} bytes")
    if t.nanos > 999_999_999:
        raise MsgpackError("nanoseconds exceed 999999999")
    return t


def values(data: bytes):
    at = 0
    while at < len(data):
        x, at = _item(data, at)
        yield x


def validate(data: bytes) -> str | None:
    """Why the bytes aren't MessagePack, or None."""
    try:
        for _ in values(data):
            pass
    except MsgpackError as e:
        return str(e)
    return None


def _sized(n: int, fix: tuple[int, int] | None, codes: dict[int, int]) -> bytes:
    if fix and n <= fix[1]:
        return bytes([fix[0] | n])
    for size, code in codes.items():
        if n < 1 << (8 * size):
            return bytes([code]) + n.to_bytes(size)
    raise MsgpackError("a length takes more than 4 bytes")


def encode(x) -> bytes:
    """The shortest format of each value."""
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if -32 <= x < 128:
            return struct.pack(">b", x)
        for code, fmt, low, high in ((0xCC, ">B", 0, 8), (0xCD, ">H", 0, 16), (0xCE, ">I", 0, 32), (0xCF, ">Q", 0, 64)) if x >= 0 else ((0xD0, ">b", 7, 0), (0xD1, ">h", 15, 0), (0xD2, ">i", 31, 0), (0xD3, ">q", 63, 0)):
            if (x >> high == 0) if x >= 0 else x >= -(1 << low):
                return bytes([code]) + struct.pack(fmt, x)
        raise MsgpackError("an integer takes more than 8 bytes")
    if isinstance(x, Float32):
        return b"\xca" + struct.pack(">f", x.value)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _sized(len(raw), (0xA0, 31), {1: 0xD9, 2: 0xDA, 4: 0xDB}) + raw
    if isinstance(x, bytes):
        return _sized(len(x), None, {1: 0xC4, 2: 0xC5, 4: 0xC6}) + x
    if isinstance(x, (Pairs, dict)):
        pairs = x.items if isinstance(x, Pairs) else tuple(x.items())
        return _sized(len(pairs), (0x80, 15), {2: 0xDE, 4: 0xDF}) + b"".join(encode(k) + encode(v) for k, v in pairs)
    if isinstance(x, (list, tuple)):
        return _sized(len(x), (0x90, 15), {2: 0xDC, 4: 0xDD}) + b"".join(map(encode, x))
    if isinstance(x, Timestamp):
        if x.nanos == 0 and 0 <= x.seconds < 1 << 32:
            raw = x.seconds.to_bytes(4)
        elif 0 <= x.seconds < 1 << 34:
            raw = (x.nanos << 34 | x.seconds).to_bytes(8)
        else:
            raw = x.nanos.to_bytes(4) + x.seconds.to_bytes(8, signed=True)
        return encode(Ext(-1, raw))
    if isinstance(x, Ext):
        n = len(x.data)
        head = bytes([0xD4 + n.bit_length() - 1]) if n in (1, 2, 4, 8, 16) else _sized(n, None, {1: 0xC7, 2: 0xC8, 4: 0xC9})
        return head + struct.pack(">b", x.kind) + x.data
    raise MsgpackError(f"no MessagePack for {type(x).__name__}")


def plain(x):
    """JSON-like data: bytes in hex, timestamps as [seconds, nanos], extensions as [kind, hex]."""
    if isinstance(x, Pairs):
        return {k if isinstance(k, str) else str(plain(k)): plain(v) for k, v in x.items}
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, bytes):
        return x.hex()
    if isinstance(x, Float32):
        return x.value
    if isinstance(x, Timestamp):
        return [x.seconds, x.nanos]
    return [x.kind, x.data.hex()] if isinstance(x, Ext) else x

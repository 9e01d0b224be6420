"""JSON texts as Python values that keep key order, duplicate keys and the source text of numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator


class Num(str):
    """A number, as its source text."""

    __slots__ = ()


class Obj(list):
    """An object: a list of (key, value) pairs."""

    __slots__ = ()


class JsonError(ValueError):
    pass


def _constant(name: str):
    raise JsonError(f"unexpected {name}")


_DECODER = json.JSONDecoder(parse_int=Num, parse_float=Num, parse_constant=_constant, object_pairs_hook=Obj, strict=True)
_WS = " \t\n\r"


def values(text: str) -> Iterator[object]:
    """All top-level values of a text; they need no separator."""
    at, end = 0, len(text)
    while True:
        while at < end and text[at] in _WS:
            at += 1
        if at >= end:
            return
        try:
            value, at = _DECODER.raw_decode(text, at)
        except (json.JSONDecodeError, RecursionError) as e:
            raise JsonError(str(e)) from None
        yield value


def parse(text: str):
    """The only value of a text."""
    got = list(values(text))
    if len(got) != 1:
        raise JsonError(f"{len(got)} values where one is expected")
    return got[0]


def tokens(value) -> Iterator[tuple[str, str | None]]:
    """(kind, text) tokens in document order."""
    todo: list[tuple[str | None, object]] = [(None, value)]
    while todo:
        name, v = todo.pop()
        if name is not None:
            yield name, v
        elif isinstance(v, Obj):
            yield "start_object", None
            todo.append(("end_object", None))
            for k, x in reversed(v):
                todo += [(None, x), ("key", k)]
        elif isinstance(v, list):
            yield "start_array", None
            todo.append(("end_array", None))
            todo += [(None, x) for x in reversed(v)]
        else:
            yield kind(v), scalar(v)


def kind(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "boolean"
    if isinstance(value, Obj):
        return "object"
    if isinstance(value, list):
        return "array"
    return "number" if isinstance(value, Num) else "string"


def scalar(value) -> str | None:
    """A scalar's text: numbers as written, strings unquoted; None for null and containers."""
    if value is None or isinstance(value, list):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def from_tokens(stream: Iterator[tuple[str, str | None]]) -> Iterator[object]:
    """Values of a token stream; the inverse of tokens()."""
    stack: list = []
    keys: list = []
    for k, text in stream:
        if k in ("start_object", "start_array"):
            stack.append(Obj() if k == "start_object" else [])
            keys.append(None)
            continue
        if k == "key":
            keys[-1] = text
            continue
        if k in ("end_object", "end_array"):
            value = stack.pop()
            keys.pop()
        else:
            value = {"null": None, "boolean": text == "true", "number": Num(text or ""), "string": text}[k]
        if not stack:
            yield value
        elif isinstance(stack[-1], Obj):
            stack[-1].append((keys[-1], value))
        else:
            stack[-1].append(value)
    if stack:
        raise JsonError("unexpected end of input")


_ESCAPES = {'"': '\\"', "\\": "\\\\", "/": "\\/", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quote(s: str) -> str:
    """A JSON string with / and everything but printable ASCII escaped."""
    if s.isalnum() and s.isascii():
        return f'"{s}"'
    out = []
    for c in s:
        if e := _ESCAPES.get(c):
            out.append(e)
        elif " " <= c <= "~":
            out.append(c)
        else:
            units = c.encode("utf-16-be", "surrogatepass").hex()
            out += [f"\\u{units[i : i + 4]}" for i in range(0, len(units), 4)]
    return f'"{"".join(out)}"'


def compact(value) -> str:
    """Text without white space, of a value nested however deep."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Text):
            out.append(v)
        elif isinstance(v, Obj):
            out.append("{")
            todo.append(_Text("}"))
            for i in range(len(v) - 1, -1, -1):
                todo += [v[i][1], _Text(f"{',' if i else ''}{quote(v[i][0])}:")]
        elif isinstance(v, list):
            out.append("[")
            todo.append(_Text("]"))
            for i in range(len(v) - 1, -1, -1):
                todo += [v[i], _Text(",")] if i else [v[i]]
        else:
            out.append("null" if v is None else quote(v) if type(v) is str else scalar(v))
    return "".join(out)


class _Text(str):
    """What is written as it is."""


def pretty(value, width: int = 100, indent: int = 2) -> str:
    """Containers on one line where they fit in the width, else an element a line."""

    def flat(v) -> str:
        if isinstance(v, Obj):
            return "{" + ", ".join([f"{quote(k)}: {flat(x)}" for k, x in v]) + "}"
        if isinstance(v, list):
            return "[" + ", ".join([flat(x) for x in v]) + "]"
        return compact(v)

    def lay(v, column: int, level: int, rest: int) -> str:
        one = flat(v)
        if not isinstance(v, list) or not v or column + len(one) + rest <= width:
            return one
        pad = " " * (indent * (level + 1))
        lines = []
        for i, x in enumerate(v):
            head, x = (f"{quote(x[0])}: ", x[1]) if isinstance(v, Obj) else ("", x)
            comma = i < len(v) - 1
            lines.append(pad + head + lay(x, len(pad) + len(head), level + 1, comma) + "," * comma)
        a, b = "{}" if isinstance(v, Obj) else "[]"
        return a + "\n" + "\n".join(lines) + "\n" + " " * (indent * level) + b

    return lay(value, 0, 0, 0)


def to_python(value):
    """Plain Python data: later duplicates of a key win, numbers become int or float."""
    if isinstance(value, Obj):
        return {k: to_python(v) for k, v in value}
    if isinstance(value, list):
        return [to_python(v) for v in value]
    if isinstance(value, Num):
        return int(value) if value.lstrip("-").isdigit() else float(value)
    return value


def from_python(data):
    if isinstance(data, dict):
        return Obj((str(k), from_python(v)) for k, v in data.items())
    if isinstance(data, (list, tuple)) and not isinstance(data, Obj):
        return [from_python(v) for v in data]
    if isinstance(data, (int, float)) and not isinstance(data, bool):
        return Num(json.dumps(data))
    return data


def merge_patch(target, patch, keep_nulls: bool = False):
    """RFC 7396: objects merge key by key, null deletes; with keep_nulls, null for a missing key is kept as it is."""
    if not isinstance(patch, Obj):
        return patch
    out = Obj(target) if isinstance(target, Obj) else Obj()
    for k, v in patch:
        at = next((i for i, (name, _) in enumerate(out) if name == k), None)
        if v is None:
            if at is not None:
                del out[at]
            elif keep_nulls:
                out.append((k, None))
        elif at is None:
            out.append((k, v if keep_nulls else merge_patch(None, v)))
        else:
            out[at] = (k, merge_patch(out[at][1], v, keep_nulls))
    return out

"""jq subset: paths (., .f, .["f"], .[i], .[a:b] with b excluded, .., [] to iterate), pipes, and constructors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from docweave.functions.jsontext import JsonError, Num, Obj
from docweave.plans.scanner import Scanner
from docweave.plans.steps import Child, Descend, Index, Iterate, PathError, Range, Step, select

_IDENT = r"[a-zA-Z][a-zA-Z0-9_-]*"
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


@dataclass(frozen=True)
class Path:
    """A selection; `then` builds from each value selected."""

    steps: tuple[Step, ...]
    then: Jq | None = None

    @property
    def iterates(self) -> bool:
        return any(isinstance(s, (Iterate, Descend, Range)) for s in self.steps)


@dataclass(frozen=True)
class Array:
    items: tuple[Jq, ...]


@dataclass(frozen=True)
class Object:
    fields: tuple[tuple[str, Jq], ...]


@dataclass(frozen=True)
class Scalar:
    value: object


Jq = Path | Array | Object | Scalar


def parse(text: str) -> Jq:
    s = Scanner(text, " \t\r\n")
    q = _jq(s)
    s.end()
    return q


def _jq(s: Scanner) -> Jq:
    if (c := _constructor(s)) is not None:
        return c
    steps = _filter(s)
    while s.take("|"):
        if (c := _constructor(s)) is not None:
            return Path(tuple(steps), c)
        steps += _filter(s)
    return Path(tuple(steps))


def _string(s: Scanner) -> str:
    s.expect('"')
    text = s.match(r'(?:[^"\\]|\\["\\])*')
    s.expect('"')
    return text.replace('\\"', '"').replace("\\\\", "\\")


def _constructor(s: Scanner) -> Jq | None:
    if s.take("["):
        items = [] if s.peek("]") else [_jq(s)]
        while s.take(","):
            items.append(_jq(s))
        s.expect("]")
        return Array(tuple(items))
    if s.take("{"):
        fields = []
        while not s.peek("}"):
            key = _string(s)
            s.expect(":")
            fields.append((key, _jq(s)))
            if not s.take(","):
                break
        s.expect("}")
        if sum(isinstance(q, Path) and q.iterates for _, q in fields) > 1:
            raise PathError("an object constructor takes one iterator at most", s.at)
        return Object(tuple(fields))
    if s.peek('"'):
        return Scalar(_string(s))
    if s.peek("."):
        return None
    for word, value in (("true", True), ("false", False), ("null", None)):
        if s.take(word):
            return Scalar(value)
    return Scalar(Num(s.match(_NUMBER, "a query")))


def _filter(s: Scanner) -> list[Step]:
    steps: list[Step] = []
    s.skip()
    if s.take(".."):
        steps.append(Descend(every=True))
    elif not s.peek("."):
        raise PathError("a filter is expected", s.at)
    while True:
        if s.take("."):
            if (name := s.match(_IDENT)) is not None:
                steps.append(Child((name,)))
        elif not s.peek("["):
            return steps
        while s.peek("["):
            steps.append(_access(s))


def _access(s: Scanner) -> Step:
    s.expect("[")
    if s.take("]"):
        return Iterate()
    if s.peek('"'):
        out: Step = Child((_string(s),))
    elif s.take(":"):
        out = Range(None, s.int() - 1)
    else:
        low = s.int()
        out = Index((low,))
        if s.take(":"):
            high = s.match("[0-9]+")
            if high is None:
                out = Range(low, None)
            elif int(high) < low:
                raise PathError("a slice needs its first index below its second", s.at)
            elif int(high) > low:
                out = Range(low, int(high) - 1)
    s.expect("]")
    return out


def run(q: Jq, value) -> Iterator[object]:
    """All results. What an array can't find is left out, what an object can't find is null."""
    match q:
        case Path(steps, None):
            yield from (v for _, v in select(value, steps))
        case Path(steps, then):
            for _, v in select(value, steps):
                yield from run(then, v)
        case Array(items):
            yield [v for i in items for v in run(i, value)]
        case Scalar(v):
            yield v
        case Object(fields):
            many = [(k, f) for k, f in fields if isinstance(f, Path) and f.iterates]
            if len(many) > 1:
                raise JsonError("an object constructor takes one iterator at most")
            fixed = {k: next(iter(run(f, value)), None) for k, f in fields if not many or k != many[0][0]}
            for x in run(many[0][1], value) if many else [None]:
                yield Obj((k, x if many and k == many[0][0] else fixed[k]) for k, _ in fields)

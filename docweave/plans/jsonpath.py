"""JSONPath subset: $, .name, ..name, .*, ..*, ["name"], [i], [a:b] (both ends included), [*]."""

from __future__ import annotations

from docweave.plans.scanner import Scanner
from docweave.plans.steps import Child, Descend, Index, Iterate, PathError, Range, Step

_IDENT = r"[a-zA-Z_$][a-zA-Z_0-9$-]*"


def parse(text: str) -> tuple[Step, ...]:
    s = Scanner(text)
    s.expect("$")
    steps: list[Step] = []
    while not s.done():
        if s.take(".."):
            steps.append(Descend(None if s.take("*") else (s.match(_IDENT, "a name or *"),)))
        elif s.take("."):
            steps.append(Child(None if s.take("*") else (s.match(_IDENT, "a name or *"),)))
        else:
            s.expect("[")
            steps.append(_inside(s))
            s.expect("]")
    if not steps:
        raise PathError("a location is expected after $", s.at)
    return tuple(steps)


def _inside(s: Scanner) -> Step:
    if s.take("*"):
        return Iterate(arrays_only=True)
    if s.take('"'):
        name = s.match(r'[^"]*')
        s.expect('"')
        return Child((name,))
    if s.take(":"):
        return Range(None, s.int())
    low = s.int()
    if s.take(":"):
        high = s.match(r"[0-9]+")
        return Range(low, int(high) if high else None)
    return Index((low,))

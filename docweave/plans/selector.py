"""The selector language: .name, .["a","b"], .[1,4], .[a:b] (both ends included), .[], with ! (mandatory) and ? (lenient),
as text and as a builder: root.field("a").iterate.index(1).range(0, 2).steps."""

from __future__ import annotations

import json

from docweave.plans.scanner import Scanner
from docweave.plans.steps import Child, Index, Iterate, Range, Step

_STRING = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"'


def parse(text: str) -> tuple[Step, ...]:
    s = Scanner(text, " \t\r\n")
    steps: list[Step] = []
    s.expect(".")
    if s.done():
        return ()
    while True:
        steps.append(_step(s))
        if s.done():
            return tuple(steps)
        s.expect(".")


def _step(s: Scanner) -> Step:
    if not s.take("["):
        name = s.match(r"[^\W\d]\w*", "a name or [")
        mandatory = s.take("!")
        return Child((name,), not s.take("?"), mandatory)
    if s.take("]"):
        return Iterate(not s.take("?"))
    if s.peek('"'):
        names = [json.loads(s.match(_STRING, "a string"))]
        while s.take(","):
            names.append(json.loads(s.match(_STRING, "a string")))
        s.expect("]")
        mandatory = s.take("!")
        return Child(tuple(names), not s.take("?"), mandatory)
    first = s.int()
    if s.take(":"):
        last = s.int()
        s.expect("]")
        mandatory = s.take("!")
        return Range(first, last, not s.take("?"))
    places = [first]
    while s.take(","):
        places.append(s.int())
    s.expect("]")
    mandatory = s.take("!")
    return Index(tuple(places), not s.take("?"), mandatory)


class Builder:
    """Steps one by one; `mandatory` and `lenient` change the last one."""

    def __init__(self, steps: tuple[Step, ...] = ()):
        self.steps = steps

    def _with(self, s: Step) -> Builder:
        return Builder((*self.steps, s))

    def _changed(self, **how) -> Builder:
        last = self.steps[-1]
        return Builder((*self.steps[:-1], type(last)(**{**last.__dict__, **how})))

    def field(self, *names: str) -> Builder:
        return self._with(Child(names, True))

    def index(self, *places: int) -> Builder:
        return self._with(Index(places, True))

    def range(self, low: int, high: int) -> Builder:
        return self._with(Range(low, high, True))

    @property
    def iterate(self) -> Builder:
        return self._with(Iterate(True))

    @property
    def mandatory(self) -> Builder:
        return self._changed(mandatory=True)

    @property
    def lenient(self) -> Builder:
        return self._changed(strict=False)


root = Builder()

"""XPath subset: / and // axes, names with * and prefixes, attribute predicates with ==, !=, &&, ||, ! and
parentheses, and alternatives with |."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from docweave.functions.xmltext import Element
from docweave.plans.scanner import Scanner

_NC = r"[^\W\d][\w.\-]*"
Test = Callable[[dict[str, str]], bool]


@dataclass(frozen=True)
class Location:
    descendant: bool
    prefix: str | None  # None: any
    local: str | None
    test: Test | None = None

    def fits(self, e: Element) -> bool:
        return (self.prefix is None or e.prefix == self.prefix) and (self.local is None or e.local == self.local) and (self.test is None or self.test(e.attrs))


Path = tuple[Location, ...]


def parse(text: str) -> tuple[Path, ...]:
    s = Scanner(text, " \t\r\n")
    paths = [_path(s)]
    while s.take("|"):
        paths.append(_path(s))
    s.end()
    return tuple(paths)


def _path(s: Scanner) -> Path:
    out = []
    while not out or s.peek("/"):
        deep = s.take("//")
        if not deep:
            s.expect("/")
        prefix: str | None = None
        local: str | None = None
        if s.take("*"):
            if s.take(":"):
                local = s.match(_NC, "a name")
        else:
            local = s.match(_NC, "a name or *")
            if s.take(":"):
                prefix, local = local, None if s.take("*") else s.match(_NC, "a name or *")
        test = None
        if s.take("["):
            test = _or(s)
            s.expect("]")
        out.append(Location(deep, prefix, local, test))
    return tuple(out)


def _or(s: Scanner) -> Test:
    a = _and(s)
    if s.take("||"):
        b = _or(s)
        return lambda attrs: a(attrs) or b(attrs)
    return a


def _and(s: Scanner) -> Test:
    a = _atom(s)
    if s.take("&&"):
        b = _and(s)
        return lambda attrs: a(attrs) and b(attrs)
    return a


def _atom(s: Scanner) -> Test:
    if s.take("("):
        a = _or(s)
        s.expect(")")
        return a
    if s.take("!"):
        a = _atom(s)
        return lambda attrs: not a(attrs)
    s.expect("@")
    name = s.match(rf"{_NC}(?::{_NC})?", "an attribute")
    for op, same in (("==", True), ("!=", False)):
        if s.take(op):
            s.expect('"')
            value = s.match('[^"]*')
            s.expect('"')
            return lambda attrs: name in attrs and (attrs[name] == value) is same
    return lambda attrs: name in attrs


def select(root: Element, paths: tuple[Path, ...], max_matches: int | None = None, max_nesting: int | None = None) -> list[tuple[str, Element]]:
    """(path, element) of each match in document order; an element that several alternatives match comes once.
    max_nesting 0 keeps the topmost ones."""
    out: list[tuple[str, Element]] = []

    def walk(e: Element, trail: str, open_: frozenset, inside: int) -> None:
        # (path, place): what still has to match from this element down
        follow, hit = set(), False
        for p, i in open_:
            here = paths[p][i]
            if here.descendant:
                follow.add((p, i))
            if here.fits(e):
                if i + 1 == len(paths[p]):
                    hit = True
                else:
                    follow.add((p, i + 1))
        if hit and (max_nesting is None or inside <= max_nesting):
            out.append((trail, e))
        if not follow:
            return
        for k, kid in enumerate(x for x in e.kids if isinstance(x, Element)):
            walk(kid, f"{trail}/{kid.name}[{k}]", frozenset(follow), inside + hit)

    walk(root, f"/{root.name}", frozenset((p, 0) for p in range(len(paths))), 0)
    return out if max_matches is None else out[:max_matches]


def matches(roots: Iterator[Element], paths: tuple[Path, ...], **how) -> Iterator[tuple[str, Element]]:
    for r in roots:
        yield from select(r, paths, **how)

"""A pretty-printer over a stream of layout events: text, lines that become spaces where a group fits, and indents.

An event is (kind, text): "text"; "line" (a line break, or a space in a group that fits) and "linebreak" (a break,
or nothing); "softline" and "softbreak" (each decides alone: a space or nothing if the next text fits); "indent"
and "dedent"; "open" and "close" of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

Event = tuple[str, str]
_FLAT = {"line": " ", "softline": " ", "linebreak": "", "softbreak": ""}


def text(s: str) -> list[Event]:
    return [("text", s)]


def line() -> list[Event]:
    return [("line", "")]


def linebreak() -> list[Event]:
    return [("linebreak", "")]


def softline() -> list[Event]:
    return [("softline", "")]


def softbreak() -> list[Event]:
    return [("softbreak", "")]


def group(events: Iterable[Event]) -> list[Event]:
    return [("open", ""), *events, ("close", "")]


def indented(events: Iterable[Event]) -> list[Event]:
    return [("indent", ""), *events, ("dedent", "")]


def words(s: str) -> list[Event]:
    """The words of a text with a soft line between them."""
    out: list[Event] = []
    for w in s.split():
        out += [*(softline() if out else []), *text(w)]
    return out


class LayoutError(ValueError):
    pass


def render(events: Iterable[Event], width: int = 100, indent: int = 2) -> str:
    return "".join(pieces(list(events), width, indent))


def pieces(events: list[Event], width: int, indent: int) -> Iterator[str]:
    flat, reach = _measure(events)
    column, level, modes = 0, 0, []
    for i, (kind, s) in enumerate(events):
        if kind == "text":
            column += len(s)
            yield s
        elif kind == "open":
            modes.append(bool(modes) and modes[-1] or column + flat[i] <= width)
        elif kind == "close":
            modes.pop()
        elif kind in ("indent", "dedent"):
            level += 1 if kind == "indent" else -1
        else:
            space = _FLAT[kind]
            stays = bool(modes) and modes[-1] or kind.startswith("soft") and column + len(space) + reach[i] <= width
            column = column + len(space) if stays else indent * level
            yield space if stays else "\n" + " " * (indent * level)


def _measure(events: list[Event]) -> tuple[list[int], list[int]]:
    """Of each event: the width of the group that it opens, on one line; the width of the text up to the next line."""
    flat, reach, opened, total, ahead = [0] * len(events), [0] * len(events), [], 0, 0
    for i, (kind, s) in enumerate(events):
        total += len(_FLAT.get(kind, s))
        if kind == "open":
            opened.append((i, total))
        elif kind == "close":
            if not opened:
                raise LayoutError("a group is closed that isn't open")
            j, before = opened.pop()
            flat[j] = total - before
        elif kind not in _FLAT and kind not in ("text", "indent", "dedent"):
            raise LayoutError(f"no layout event: {kind}")
    if opened:
        raise LayoutError("a group is left open")
    for i in range(len(events) - 1, -1, -1):
        reach[i] = ahead
        ahead = 0 if events[i][0] in _FLAT else ahead + len(events[i][1])
    return flat, reach

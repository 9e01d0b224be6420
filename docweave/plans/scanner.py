"""A small text scanner for the query parsers."""

from __future__ import annotations

import re

from docweave.plans.steps import PathError


class Scanner:
    def __init__(self, text: str, space: str = ""):
        self.text, self.at, self.space = text, 0, space

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in self.space:
            self.at += 1

    def peek(self, s: str) -> bool:
        self.skip()
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def expect(self, s: str) -> None:
        if not self.take(s):
            raise PathError(f"expected {s!r}", self.at)

    def match(self, pattern: str, what: str | None = None) -> str | None:
        """The text at this place that the pattern takes; without one, an error if `what` is given."""
        self.skip()
        m = re.compile(pattern).match(self.text, self.at)
        if m is None:
            if what:
                raise PathError(f"expected {what}", self.at)
            return None
        self.at = m.end()
        return m[0]

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.text)

    def end(self) -> None:
        if not self.done():
            raise PathError(f"unexpected {self.text[self.at]!r}", self.at)

    def int(self) -> int:
        return int(self.match(r"[0-9]+", "a number"))

"""Cell decoders that combine. A decoder maps a cell to struct(value, error) and stays a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import cells


def _result(value: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"))


@dataclass(frozen=True)
class Decoder:
    run: Callable[[Column], Column]

    def __call__(self, cell: Column) -> Column:
        return self.run(cell)

    def map(self, f: Callable[[Column], Column]) -> Decoder:
        def run(cell: Column) -> Column:
            got = self(cell)
            return _result(F.when(got["error"].isNull(), f(got["value"])), got["error"])

        return Decoder(run)

    def check(self, test: Callable[[Column], Column], error: Callable[[Column], Column]) -> Decoder:
        """The value as it is where the test holds, else an error made from it."""

        def run(cell: Column) -> Column:
            got = self(cell)
            fails = got["error"].isNull() & ~F.coalesce(test(got["value"]), F.lit(False))
            return _result(F.when(got["error"].isNull() & ~fails, got["value"]), F.when(fails, error(got["value"])).otherwise(got["error"]))

        return Decoder(run)

    def emap(self, f: Callable[[Column], Column]) -> Decoder:
        """f gives struct(value, error) of the decoded value."""

        def run(cell: Column) -> Column:
            got = self(cell)
            then = f(got["value"])
            fine = got["error"].isNull()
            return _result(F.when(fine, then["value"]), F.when(fine, then["error"]).otherwise(got["error"]))

        return Decoder(run)

    def flat_map(self, f: Callable[[Column], Decoder]) -> Decoder:
        """The same cell by the decoder that f chooses for the value."""
        return Decoder(lambda cell: self.emap(lambda v: f(v)(cell))(cell))

    def or_else(self, other: Decoder) -> Decoder:
        """The first that works; both give the same type."""

        def run(cell: Column) -> Column:
            a, b = self(cell), other(cell)
            fine = a["error"].isNull()
            return _result(F.when(fine, a["value"]).otherwise(b["value"]), F.when(~fine, b["error"]))

        return Decoder(run)

    def either(self, other: Decoder) -> Decoder:
        """struct(left, right): right is tried where left fails."""

        def run(cell: Column) -> Column:
            a, b = self(cell), other(cell)
            fine = a["error"].isNull()
            both = F.struct(F.when(fine, a["value"]).alias("left"), F.when(~fine, b["value"]).alias("right"))
            error = F.when(~fine, b["error"])
            return _result(F.when(error.isNull(), both), error)

        return Decoder(run)

    def handle_error(self, value: Callable[[Column], Column]) -> Decoder:
        """A value made from the error in its place."""

        def run(cell: Column) -> Column:
            got = self(cell)
            return _result(F.when(got["error"].isNull(), got["value"]).otherwise(value(got["error"])), F.lit(None).cast("string"))

        return Decoder(run)


def of(kind: str, fmt: str | None = None) -> Decoder:
    return Decoder(lambda cell: cells.decode_or_error(cell, kind, fmt))


def optional(kind: str, fmt: str | None = None) -> Decoder:
    return Decoder(lambda cell: cells.decode_optional(cell, kind, fmt))


def const(value: object) -> Decoder:
    return Decoder(lambda cell: _result(F.lit(value), F.lit(None).cast("string")))


def enum(*names: str) -> Decoder:
    """One of these names."""
    said = ", ".join(names)
    return of("string").check(lambda v: v.isin(*names), lambda v: F.concat(F.lit("'"), v, F.lit(f"' is none of {said}")))

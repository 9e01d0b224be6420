"""Places of regular-expression matches in DataFrame functions, for operators 5 and 6.

Matches and the text between them come of two scans by the same pattern; their lengths, summed, are the
places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def running_ends(lengths: Column) -> Column:
    """Running sums of an array of ints, block by block: no step copies more than a block or a list of blocks."""
    empty = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    inner = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))

    def outer(acc, block):
        done = F.aggregate(block, empty(acc["at"]), inner)
        # a lambda is the only way to name a value here
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out"))), F.lit(0))

    return F.aggregate(blocks, empty(F.lit(0)), outer, lambda acc: acc["out"])


def with_places(df: DataFrame, text: str, matches: str, pattern: str, out: str, between: str | None = None) -> DataFrame:
    """Adds under `out` start, end and the match itself for each of the column `matches` (regexp_extract_all of the
    pattern); under `between`, if named, the texts around the matches (null without a match). What is used more
    than once is a column of its own, so the text is split once."""
    gaps, lengths = between or f"dw_{out}_gaps", f"dw_{out}_lengths"
    df = df.withColumn(gaps, F.when(F.size(matches) > 0, F.split(text, pattern, -1)))
    df = df.withColumn(lengths, F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.col(matches), lambda b, m: F.length(b) + F.length(m)))
    found = F.zip_with(running_ends(F.col(lengths)), F.col(matches), lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(out, F.when(F.size(matches) > 0, found).otherwise(none)).drop(lengths, *([] if between else [gaps]))


def shown(kind: str, spans: str | Column) -> Column:
    """kind:start:end strings of an array of places."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def bare(spans: str | Column) -> Column:
    """Just start and end of each place."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def passing(spans: Column, check: Callable[[Column], Column]) -> Column:
    """The places whose text passes the check."""
    return F.filter(spans, lambda s: check(s["value"]))

"""Operator 6: secret scans by patterns and by character Markov models; DataFrame functions alone.

Base spans come of three patterns, over whole texts. Two first-order Markov models over printable ASCII are
trained: one of random strings, on the values of all base spans, one of ordinary identifiers, on the whole
tokens of letters of all documents; equal strings are counted first, so that what is shuffled and taken apart
into pairs is each distinct string once. A token of MIN_CHARS or more that no base span meets is
added if the log-likelihood ratio of the models, summed and per character, passes its bounds. The ratios are
a table of 94 x 94 figures, which goes along as a constant.

Defined cases: null counts as empty (no spans); spans are in code points, end exclusive; without any base
span there is no model, and nothing is added; added spans have kind `random` and stand after the base kinds;
rows repeated whole each get their result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import spans
from docweave.llm.common import durable

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+[A-Za-z0-9+/_.=-]++"""
_ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Ordinary identifiers: whole tokens of letters alone.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{4,}+(?![A-Za-z0-9+/_=-])"
MIN_CHARS, MIN_SUM, MIN_MEAN = 20, 15.0, 0.5
_N = 94


def _value(s):
    return F.regexp_replace(s, _ASSIGN_HEAD, "")


PATTERNS = {"assign": (ASSIGN, lambda v: F.length(_value(v)) >= 6), "access": (ACCESS, lambda v: F.lit(True)), "hex": (HEX, lambda v: F.lit(True))}


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array of places (start, end, value) under each kind's name."""
    # all matches first: that step is compiled as a whole, those with lambdas aren't
    df = df.withColumns({f"dw_{k}": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for k, (pattern, _) in PATTERNS.items()})
    for kind, (pattern, check) in PATTERNS.items():
        df = spans.with_places(df, text, f"dw_{kind}", pattern, kind).drop(f"dw_{kind}")
        df = df.withColumn(kind, spans.passing(F.col(kind), check))
    return df


def _codes(value):
    """Places of a string's characters in printable ASCII, of others left out."""
    return F.filter(F.transform(F.split(value, ""), lambda c: F.ascii(c) - 33), lambda i: (i >= 0) & (i < _N))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of adjacent characters in the strings v, as i * 94 + j."""
    df = strings.groupBy("v").agg(F.count("*").alias("times")).select(_codes(F.col("v")).alias("c"), "times").where("size(c) > 1")
    pairs = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * _N + b)
    return df.select(F.explode(pairs).alias("pair"), "times").groupBy("pair").agg(F.sum("times").alias("n"))


def train(base: DataFrame, docs: DataFrame) -> list[float] | None:
    """The table of log-likelihood ratios (random against ordinary), or None without any secret."""
    values = base.select(F.explode(F.concat(F.transform("assign", lambda s: _value(s["value"])), F.transform("access", lambda s: s["value"]), F.transform("hex", lambda s: s["value"]))).alias("v"))
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("v"))
    # at most 94 x 94 rows each
    rand = {r["pair"]: r["n"] for r in _pairs(values).collect()}
    plain = {r["pair"]: r["n"] for r in _pairs(words).collect()}
    if not rand or not plain:
        return None
    table = []
    for i in range(_N):
        a = sum(rand.get(i * _N + j, 0) for j in range(_N))
        b = sum(plain.get(i * _N + j, 0) for j in range(_N))
        for j in range(_N):
            p = (rand.get(i * _N + j, 0) + 0.5) / (a + 0.5 * _N)
            q = (plain.get(i * _N + j, 0) + 0.5) / (b + 0.5 * _N)
            table.append(max(-6.0, min(6.0, math.log(p / q))))
    return table


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, an array of places for each base kind, and added places, of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    scanned = base_spans(rows.withColumn("m", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))))
    scanned = spans.with_places(scanned, "text", "m", TOKEN, "tokens")
    clear = lambda s: ~F.exists(F.concat(*KINDS), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    held = durable(scanned.select("doc_id", *KINDS, F.filter("tokens", clear).alias("tokens")))
    table = train(held, rows)
    if table is None:
        return held.select("doc_id", *KINDS, F.slice("tokens", 1, 0).alias("added"))
    ratios = F.expr("cast(split('" + ",".join(f"{x:.5f}" for x in table) + "', ',') as array<double>)")

    def random_like(s):
        codes = _codes(s["value"])
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(ratios, a * _N + b))
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
        return (F.size(codes) >= MIN_CHARS) & (total >= MIN_SUM) & (total >= MIN_MEAN * F.length(s["value"]))

    return held.select("doc_id", *KINDS, F.filter("tokens", random_like).alias("added"))


def digests(found: DataFrame) -> DataFrame:
    def ordered(kinds):
        def tag(i):
            return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))

        tagged = F.concat(*[F.transform(k, tag(i)) for i, k in enumerate(kinds)])
        name = F.array(*[F.lit("random" if k == "added" else k) for k in kinds])
        return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(ordered(KINDS), 256).alias("base_sha256"), ordered([*KINDS, "added"]).alias("spans"))

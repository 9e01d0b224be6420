"""Operator 5: personal data, by patterns and by bootstrapped contextual extraction; DataFrame functions alone.

Base spans: e-mail, IPv4, payment card (Luhn) and phone patterns, over whole texts. They are the seeds.
Every token with a digit or an @ is an instance; its pattern is the word before it (itself an instance or not;
none before a text's first) and its shape. Pattern
and instance scores are carried over the graph between them ROUNDS times: a pattern's confidence for a kind
is the mean of its distinct instances' scores, an instance's score is 1 for a seed and else
1 - product(1 - confidence) over its patterns. Patterns of MIN_CONFIDENCE and MIN_SUPPORT then name what
the base patterns missed. Every count covers all documents.

Defined cases: null counts as empty (no spans); spans are in code points, end exclusive; base spans are
never changed, and added ones never overlap them; rows repeated whole share their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm import spans
from docweave.llm.common import durable, hot_keys, hottest, join_hot

#: Possessive and anchored forms of the contract's patterns: the same matches, found in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone")
#: Classes are spelt out: Java is many times slower with \s inside of a negated class.
TOKEN = r"(?<!\S)[^ \t\n\x0B\f\r0-9@]*+[0-9@]\S*+"
_LAST_WORD = r"(?<!\S)(\S++)\s++\z"
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT = 3, 0.9, 5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


#: Pattern, check of a match, and what a text must have for any match: found much faster, as it begins with one character.
CHECKS = {
    "email": (EMAIL, lambda v: F.lit(True), r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]"),
    "ip": (IP, lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (CARD, lambda v: luhn(_digits(v)), r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": (PHONE, lambda v: F.length(_digits(v)).between(8, 15), r"\+[0-9][ ().0-9-]+[0-9]"),
}


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array of places (start, end, value) under each kind's name."""
    none = F.array().cast("array<string>")
    # all matches first: that step is compiled as a whole, those with lambdas aren't
    df = df.withColumns({f"dw_{k}": F.when(F.col(text).rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none) for k, (pattern, _, needs) in CHECKS.items()})
    for kind, (pattern, check, _) in CHECKS.items():
        df = spans.with_places(df, text, f"dw_{kind}", pattern, kind).drop(f"dw_{kind}")
        df = df.withColumn(kind, spans.passing(F.col(kind), check))
    return df


def _instances() -> Column:
    """An array of the tokens (column m, their places in `tokens`, the text `between` them) that have a digit or an @:
    `at` and `to` of the token, place without the punctuation around, and hashes of the identifier and of its
    pattern, the word before and the shape."""
    # the word before stands at the end of the text since the token before, or is that token; a text's first has ""
    word = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.get("between", i), _LAST_WORD, 1), F.lit("")), F.get("m", i - 1), F.lit(""))
    core = lambda v: F.regexp_replace(v, r"^[^0-9A-Za-z+]+|[^0-9A-Za-z]+$", "")
    lead = lambda v: F.length(F.regexp_extract(v, r"^[^0-9A-Za-z+]*", 0))
    tokens = F.transform("tokens", lambda s, i: F.struct(s["start"].alias("at"), s["end"].alias("to"), (s["start"] + lead(s["value"])).alias("start"), core(s["value"]).alias("value"), F.lower(word(i)).alias("before")))
    shape = lambda v: F.regexp_replace(F.regexp_replace(v, "[0-9]", "9"), "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F9]+", "a")
    named = lambda x: F.struct(x["at"], x["to"], x["start"], (x["start"] + F.length(x["value"])).alias("end"), F.xxhash64(x["value"]).alias("instance"), F.xxhash64(x["before"], F.left(shape(x["value"]), F.lit(200))).alias("pattern"))
    return F.transform(F.filter(tokens, lambda x: F.length(x["value"]) > 0), named)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a number `row` of its own, base places of each kind, and the instances `found`: one pass over the
    texts, after which no text is needed."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = base_spans(rows.withColumn("m", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))))
    rows = spans.with_places(rows, "text", "m", TOKEN, "tokens", "between")
    none = F.array().cast("array<struct<at:int,to:int,start:int,end:int,instance:bigint,pattern:bigint>>")
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *[spans.bare(k).alias(k) for k in KINDS], F.when(F.size("m") > 0, _instances()).otherwise(none).alias("found"))


def instances(rows: DataFrame) -> DataFrame:
    """A row for each instance of scan()'s rows, with the kind of the base span that its token meets as `seed`."""
    tokens = rows.select("row", F.explode("found").alias("x")).select("row", (2 * F.col("x.to") - 1).alias("order"), "x", F.lit(None).cast("struct<kind:string,end:int>").alias("span"))
    tagged = lambda k: F.transform(k, lambda s: F.struct((2 * s["start"]).alias("order"), F.struct(F.lit(k).alias("kind"), s["end"].alias("end")).alias("span")))
    kinds = F.concat(*[tagged(k) for k in KINDS])
    based = rows.where(F.size("found") > 0).select("row", F.explode(kinds).alias("k")).select("row", "k.order", F.lit(None).cast(tokens.schema["x"].dataType).alias("x"), "k.span")
    # spans that start before a token's end come before it; it meets one if some of them ends after its start
    before = Window.partitionBy("row").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    ends = {f"end_{k}": F.max(F.when(F.col("span.kind") == k, F.col("span.end"))).over(before) for k in KINDS}
    both = tokens.unionByName(based).withColumns(ends).where("x is not null")
    seed = F.coalesce(*[F.when(F.col(f"end_{k}") > F.col("x.at"), F.lit(k)) for k in KINDS])
    return both.select("row", "x.start", "x.end", "x.instance", "x.pattern", seed.alias("seed"))


def score(edges: DataFrame) -> DataFrame:
    """pattern and kind of the patterns that are trusted, from the graph's edges (pattern, instance, seed, n)."""
    instances, patterns = hot_keys(edges, "instance"), hot_keys(edges, "pattern")
    total = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT)
    seeds = edges.where("seed is not null").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("s"))
    scores, trusted = seeds, None
    for turn in range(ROUNDS):
        sums = join_hot(edges.drop("n"), scores, ["instance"], instances).groupBy("pattern", "kind").agg(F.sum("s").alias("s"))
        confidence = durable(sums.join(total, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("c")).where("c > 0.05"))
        trusted = confidence.where(F.col("c") >= MIN_CONFIDENCE).select("pattern", "kind")
        if turn < ROUNDS - 1:
            heard = join_hot(edges.drop("n").where("seed is null"), confidence, ["pattern"], patterns)
            scores = seeds.unionByName(heard.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("s")))
    return trusted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, an array of base places for each kind, and added places with their kind, of every row."""
    rows = durable(scan(docs, id_col, text_col))
    known = durable(instances(rows))
    edges = durable(known.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    times = edges.groupBy("pattern").agg(F.sum("n").alias("n"))
    hot = hottest(times, edges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    more = join_hot(known.where("seed is null"), score(edges), ["pattern"], hot).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("added"))
    out = rows.drop("found").join(more, "row", "left")
    return out.select("doc_id", *KINDS, F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("added"))


def _of_kind(added: str, kind: str) -> Column:
    return F.filter(added, lambda s: s["kind"] == kind)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns; then the counts of added spans of each kind, and of all spans."""
    base = F.concat(*[spans.shown(k, k) for k in KINDS])
    everything = F.concat(*[spans.shown(k, F.array_sort(F.concat(spans.bare(k), spans.bare(_of_kind("added", k))))) for k in KINDS])
    more = [F.size(_of_kind("added", k)).cast("long").alias(f"n_added_{k}") for k in KINDS]
    total = sum((F.size(k) for k in KINDS), F.size("added"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(everything, ",").alias("spans"), *more, total.cast("long").alias("n_spans"))

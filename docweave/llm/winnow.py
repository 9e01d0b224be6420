"""Operator 7: document fingerprints by winnowing, in DataFrame functions alone.

Words (parted by ASCII white space, lower-cased) give rolling GRAM-word hashes; of every WINDOW consecutive
hashes the least is chosen, the rightmost of equal ones, and kept with its position. So any run of
GRAM + WINDOW - 1 words that two texts share gives them a common hash. Hash and position share one long
(31 bits each, the position counted down), so the minimum settles ties by itself, and the window's minimum
comes of four doublings.

Defined cases: null counts as empty; an empty or wordless text has the empty fingerprint; fewer words than
GRAM give one hash of them all, fewer hashes than WINDOW one choice; likeness is the Jaccard index of the
hash sets, 1 for two empty ones and 0 for an empty and another; rows with a null id come first in the order,
equal ids are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM, DOUBLINGS = 5, 4
WINDOW = 1 << DOUBLINGS
_LOW = (1 << 31) - 1
_SPACE = " \t\n\x0b\x0c\r"


def _shifted_least(a: str, by: int) -> Column:
    n = F.size(a) - by
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), lambda x, y: F.least(x, y))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array `out` of chosen hashes and positions for the column `text`; see parts()."""
    w, g, m = (f"dw_{out}_{x}" for x in "wgm")
    df = df.withColumn(w, F.split(F.lower(F.btrim(F.col(text), F.lit(_SPACE))), "[ \\t\\n\\x0B\\f\\r]+"))
    at = lambda i, k: F.get(F.col(w), i + k)
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(F.lit(_LOW) - i)
    rolled = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: packed(F.xxhash64(*[at(i, k) for k in range(GRAM)]), i))
    whole = F.array(packed(F.xxhash64(w), F.lit(0)))
    df = df.withColumn(g, F.when((F.size(w) == 1) & (F.get(w, F.lit(0)) == ""), F.array().cast("array<bigint>")).when(F.size(w) < GRAM, whole).otherwise(rolled))
    df = df.withColumn(m, F.when(F.size(g) < WINDOW, F.filter(F.array(F.array_min(g)), lambda x: x.isNotNull())).otherwise(F.col(g)))
    # every step of the doubling is a column of its own, so that none is computed twice
    steps = []
    last = m
    for k in range(DOUBLINGS):
        step = f"{m}{k}"
        df = df.withColumn(step, F.when(F.size(g) < WINDOW, F.col(last)).otherwise(_shifted_least(last, 1 << k)))
        steps.append(step)
        last = step
    return df.withColumn(out, F.array_distinct(last)).drop(w, g, m, *steps)


def parts(fingerprint: str) -> Column:
    """hash (31 bits) and position (word, from 0) of each choice."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, 32).alias("hash"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).alias("at")))


def shown(fingerprint: str) -> Column:
    """Choices as hash@position (hash in hex), joined by one space."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws("@", F.hex(F.shiftright(x, 32)), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))), " ")


def _hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def with_next(df: DataFrame, key: str, text: str, columns: list[str], prepare=None) -> DataFrame:
    """Adds next_<c> for each of `columns`: its value in the next row by (key, text), the first row's for the
    last. The key's range is cut into buckets at existing keys; each bucket gets a copy of the next one's
    first rows, so one shuffle and a window within each bucket do. `prepare` runs on the dealt rows."""
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.approx_percentile(key, [i / n for i in range(n)], F.lit(max(10_000, 20 * n)))).first()[0] or []
    cuts = sorted(set(cuts)) or [0]
    array = F.expr("cast(split('" + ",".join(map(str, cuts)) + "', ',') as array<bigint>)")
    df = df.withColumn("dw_bucket", F.greatest(F.lit(0), F.size(F.filter(array, lambda x: x <= F.col(key))) - 1))
    starts = F.col(key) == F.get(array, F.col("dw_bucket"))
    before = F.when(F.col("dw_bucket") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("dw_bucket") - 1)
    own = F.struct(F.col("dw_bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("bucket"), F.lit(1).alias("guest"))
    df = df.withColumn("dw_place", F.explode(F.when(starts, F.array(own, guest)).otherwise(F.array(own))))
    df = df.drop("dw_bucket").withColumns({"dw_bucket": F.col("dw_place.bucket"), "dw_guest": F.col("dw_place.guest")}).drop("dw_place")
    df = df.repartition("dw_bucket")
    df = prepare(df) if prepare else df
    order = Window.partitionBy("dw_bucket").orderBy("dw_guest", key, text)
    df = df.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return df.where("dw_guest = 0").drop("dw_bucket", "dw_guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the chosen hashes of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return with_fingerprint(rows, "text", "print")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (its last half replaced from the next document's start)
    and the likenesses to the edited text and to the next document."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows = with_next(rows, "key", "text", ["text", "own"], lambda df: with_fingerprint(df, "text", "own"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("next_text"), half))).drop("text", "next_text", "key")
    rows = with_fingerprint(rows, "edited", "new")
    rows = rows.withColumns({"h": _hashes("own"), "h_new": _hashes("new"), "h_next": _hashes("next_own")})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"),
        shown("new").alias("edited_fingerprint"),
        likeness("h", "h_new").alias("near_edited"),
        likeness("h", "h_next").alias("near_next"),
    )

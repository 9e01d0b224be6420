"""Operator 10: MinHash near-dedup with tensored banding.

Each distinct set of five-word shingles has 2 * HALVES short keys of HALF_ROWS minhashes each, in two
collections A and B. A table's key is a pair of one key from A and one from B, so HALVES ** 2 tables cost
2 * HALVES * HALF_ROWS minhashes. With 14 and 2, a pair of sets with similarity 0.75 meets in some table
with probability (1 - (1 - 0.75 ** 2) ** 14) ** 2 > 0.99998.

Pairs are formed only where both half keys are shared with some other set. In each table entry the members
are compared with one of them (the least; later, another), on full sets, never all with all, where their minhashes
promise a link. Then the components are joined, and what still lies in different components and shares an entry
is compared pair by pair, whatever the minhashes say, but for pairs whose sizes and rarest shingles rule a link
out. So no link between different texts is lost to this economy.

Defined cases: null or wordless texts have an empty set and link with nothing; fewer words than five form
one shingle; equal sets collapse before anything else; repeated ids share their least component; rows with
null id have no component and aren't kept as a copy of anything (component null, kept true).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import durable, hot_keys, hottest, join_hot, join_spread, lean, release, small_side, text_rows

SHINGLE, HALVES, HALF_ROWS = 5, 14, 2
THRESHOLD_PERCENT = 75
#: Of 56 minhashes, pairs with fewer in common are put off: not read in full in the first two turns, but only in the last.
AGREE = 27
#: Ratio of the sizes at which a class of sizes starts and ends, in the search by rare shingles.
SIZE_STEP = 1.03
_WORDS = 200_000
_M = 2 * HALVES * HALF_ROWS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, _M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _M, dtype=np.uint64)
_MIX, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: bytes | None, hashes: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    tokens = text.lower().split() if text else []  # bytes: only A-Z changes, and only ASCII space parts
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * _P + w[i : len(w) - n + 1 + i]
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.unique(h ^ (h >> np.uint64(33)))


def minhashes(s: np.ndarray) -> np.ndarray:
    """The least of each of the _M permutations, upper 31 bits."""
    least = np.full(_M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048][None, :] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint64(31)
        x *= _MIX
        np.minimum(least, x.min(1), out=least)
    return (least >> np.uint64(33)).astype(np.int32)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets; null if empty) and the minhashes of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingles(text.as_py(), hashes)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minhashes(s) if len(s) else np.zeros(0, np.int32))
            ends = np.cumsum([0, *map(len, sigs)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "sig"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, sig array<int>")


def _entries(reps: DataFrame) -> DataFrame:
    """key and rep: table entries (pairs of half keys) that may hold two sets or more."""
    halves = F.array(*[F.xxhash64(*[F.col("sig")[i * HALF_ROWS + j] for j in range(HALF_ROWS)], F.lit(i)) for i in range(2 * HALVES)])
    half = reps.select("rep", F.posexplode(halves).alias("i", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    live = half.join(shared, "half").groupBy("rep").agg(F.collect_list(F.when(F.col("i") < HALVES, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("i") >= HALVES, F.col("half"))).alias("b"))
    live = live.where("size(a) > 0 and size(b) > 0")
    keyed = live.select("rep", F.explode("a").alias("x"), "b").select("rep", "x", F.explode("b").alias("y")).select("rep", F.xxhash64("x", "y").alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return keyed.join(many, "key")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep and its shingle set as bytes, for the documents in `wanted` (rep, set_key); a repeated id may have several."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            keep = []
            for i, (text, key) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2))):
                s = shingles(text.as_py(), hashes)
                if xxhash.xxh3_128_digest(s.tobytes()) == key.as_py():  # of repeated ids, the right text
                    keep.append((i, s.tobytes()))
            at = pa.array([i for i, _ in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([x for _, x in keep], pa.binary())], ["rep", "set_key", "items"])

    rows = text_rows(docs, id_col, text_col).join(small_side(wanted.select(F.col("rep").alias("doc_id"), "set_key"), 100 * wanted.count()), "doc_id")
    return rows.mapInArrow(run, "rep bigint, set_key binary, items binary").dropDuplicates(["rep", "set_key"]).drop("set_key")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are alike."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < THRESHOLD_PERCENT * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["a", "b"])

    left, right = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    # the repeated side comes last, so each set travels once to meet its pairs; a leader's set goes to its members' tasks
    return join_spread(pairs.join(left, "a"), right, "b", hot_keys(pairs, "b"), "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _rare_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components among `members` (rep, items, comp) that may be alike: two sets with
    similarity 0.75 share one of the rarest quarter of either's shingles, in any one order of shingles. A
    passage that many texts share is thus no ground to compare them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                same = [pa.array(np.full(len(items), batch.column(i)[row].as_py(), np.int64)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([same[0], same[1], pa.array(items), pa.array(np.full(len(items), len(items), np.int32))], ["rep", "comp", "s", "n"])

    rows = durable(members.select("rep", "items", "comp").mapInArrow(run, "rep bigint, comp bigint, s bigint, n int"))
    often = rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(often, "s").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("own"))
    least = F.ceil(F.col("n") * THRESHOLD_PERCENT / 100)  # shingles that a set must share with a partner
    rare = shared.withColumn("take", (F.size("own") - least + 1).cast("int")).where("take > 0")
    # what can still be shared from a shingle on, it included
    rare = rare.select("rep", "comp", "n", F.size("own").alias("m"), F.posexplode(F.slice("own", 1, F.col("take"))).alias("at", "x"))
    rare = durable(rare.select("rep", "comp", "n", "x.s", (F.col("m") - F.col("at")).alias("rest")))
    # a pair shares at most the lesser rest, so that (n + k) * 75 <= 175 * rest bounds the partner's size from above, as
    # 0.75 does from below: the larger looks only into these classes of size, SIZE_STEP wide
    size = lambda c: F.floor(F.log(c) / math.log(SIZE_STEP)).cast("int")
    most = F.least(F.col("n"), F.floor((100 + THRESHOLD_PERCENT) * F.col("rest") / THRESHOLD_PERCENT - F.col("n")))
    fewest = F.ceil(F.col("n") * THRESHOLD_PERCENT / 100)
    probe = rare.where(most >= fewest).withColumn("g", F.explode(F.sequence(size(fewest), size(most))))
    other = rare.select(F.col("rep").alias("b"), F.col("comp").alias("c"), "s", F.col("n").alias("k"), F.col("rest").alias("left"), size(F.col("n")).alias("g"))
    least = (100 + THRESHOLD_PERCENT) * F.least("rest", "left") >= THRESHOLD_PERCENT * (F.col("n") + F.col("k"))
    once = (F.col("k") < F.col("n")) | (F.col("k") == F.col("n")) & (F.col("rep") < F.col("b"))
    found = probe.join(other, ["s", "g"]).where(once & (F.col("comp") != F.col("c")) & (F.col("k") >= fewest) & least)
    return found.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node reachable) for the nodes of `edges` (a, b): large and small stars by turns."""
    e = durable(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size, before = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        # a star's hub is a hot key
        large = durable(join_hot(both, least.drop("n"), ["u"], hottest(least, 2 * size)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        fewer = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_hot(large, fewer.drop("n"), ["u"], hottest(fewer, large.count())).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        old, e = e, durable(small)
        release(old, least, large, fewer)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        size = now[0]
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _same_ids(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes that one repeated id with different texts belongs to."""
    ids = sigs.where("doc_id is not null").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct()
    least = ids.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b < hi").select("doc_id", "b")
    return ids.join(least, "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    sigs = durable(signatures(docs, id_col, text_col))
    first = F.min("doc_id")
    classes = sigs.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(first.alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    classes = durable(classes)
    # two different sets under one repeated id are one node, as they reach each other; pairs of it are tried with both
    entries = durable(_entries(classes.select("rep", "sig")).distinct())

    sig = classes.select("rep", "sig")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
        pairs = durable(pairs)
        return join_hot(pairs, sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), ["b"], hot_keys(pairs, "b")).where(agree >= AGREE).select("a", "b").distinct()

    sets = None
    links = durable(_same_ids(sigs, classes))
    links = None if links.isEmpty() else links
    comps = None if links is None else durable(components(links))
    for turn in range(0 if entries.isEmpty() else 3):
        own = entries.withColumn("comp", F.col("rep"))
        if comps is not None:
            own = entries.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            own = durable(own.join(mixed, "key"))
        if sets is None:
            members = durable(entries.select("rep").distinct().join(classes.select("rep", "set_key"), "rep"))
            sets = durable(_sets(docs, members, id_col, text_col))
        if turn == 0:
            leader = durable(own.groupBy("key").agg(F.min("rep").alias("b"), F.count("*").alias("n")))
            hot = hottest(leader, own.count())
            pairs = likely(join_hot(own, leader.drop("n"), ["key"], hot).where("rep != b").select(F.col("rep").alias("a"), "b").distinct())
        elif turn == 1:
            leader = own.groupBy("key").agg(F.min_by(F.struct("rep", "comp"), F.xxhash64("rep")).alias("l"), F.count("*").alias("n"))
            leader = durable(leader.select("key", F.col("l.rep").alias("b"), F.col("l.comp").alias("c"), "n"))
            hot = hottest(leader, own.count())
            pairs = likely(join_hot(own, leader.drop("n"), ["key"], hot).where("rep != b and comp != c").select(F.col("rep").alias("a"), "b").distinct())
        else:
            pairs = _rare_pairs(sets.join(own.select("rep", "comp").distinct(), "rep"))
        pairs = durable(pairs)
        if pairs.isEmpty():
            continue
        new = durable(_links(pairs, sets))
        links = new if links is None else links.unionByName(new)
        comps = durable(components(links))
    out = sigs.select("doc_id", "n_shingles", "set_key")
    where = classes.select("set_key", "rep")
    if comps is not None:
        where = where.join(comps, where["rep"] == comps["node"], "left").select("set_key", F.coalesce("comp", "rep").alias("rep"))
    out = out.join(where, "set_key", "left")
    component = F.coalesce("rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

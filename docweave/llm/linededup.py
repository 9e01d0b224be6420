"""Operator 2: line dedup with a suffix array built by distributed prefix doubling.

All documents' lines, in the order of doc_id and line, are one sequence of line ids. Doubling k ranks every
suffix by its first 2^k lines: the classes of equal ones are sorted by their pairs of ranks, by ranges, and
numbered in that order, so ranks stand as in the suffix array; suffixes that stand alone in their class are
settled and leave. The suffixes that share L lines (an interval of common prefixes L long) are those with the
same two ranks of 2^k <= L lines, at the run's start and 2^k before its end. In each interval the first run
stays, later copies are deleted.

A run counts if it lies in one document and has MIN_WORDS words. It is enough to look at the shortest such
runs that start, and that end, at each line: every longer repeated run is a union of those.

Defined cases: null text has no lines and stays as it is; rows repeated whole (id and text) are one copy
and share their result; rows with null id come first; text that loses nothing is returned unchanged,
whatever its line ends ("\\n" parts lines). A hot line or a huge group of copies is counted with partial
aggregation; what is known of a class with over a thousandth of the rows is sent to them by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import durable, hottest, join_hot, lean, small_batches, small_side

MIN_WORDS = 50


def _sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: line ids (128 bits each) and words of each line."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, counts = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = (text or b"").split(b"\n")
                lines.append([xxhash.xxh3_128_digest(x) for x in own])
                counts.append([len(x.split()) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))], ["id", "uid", "lines", "words"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_col).alias("uid"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "id bigint, uid bigint, lines array<binary>, words array<int>")


def shortest_runs(line: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (places) and lengths of the shortest runs of min_words words that start or end at each of
    these lines; a run doesn't cross a gap in the line numbers."""
    run = np.concatenate([[0], np.cumsum(np.diff(line) != 1)])
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(line)
    last = np.searchsorted(run, run, side="right")  # end of each line's stretch
    first = np.searchsorted(run, run, side="left")
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    ahead = np.flatnonzero(end <= last)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    back = np.flatnonzero(start >= first)
    starts = np.concatenate([ahead, start[back]])
    ends = np.concatenate([end[ahead], back + 1])
    pairs = np.unique(np.stack([starts, ends], 1), axis=0) if n and len(starts) else np.zeros((0, 2), int)
    return pairs[:, 0], pairs[:, 1] - pairs[:, 0]


def _ordered(classes: DataFrame, *keys: str) -> DataFrame:
    """Classes of suffixes with their `rank`: numbers that rise in the order of the keys, so a level's classes stand
    as in the suffix array. Whole classes are sorted, by ranges; so a hot one is one row."""
    return durable(classes.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, uid (hash of the text), at (line from 0) and n (lines) of each later copy of a run."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    seq = _sequences(docs, id_col, text_col).dropDuplicates(["id", "uid"]).repartitionByRange(parts, "id", "uid").sortWithinPartitions("id", "uid")
    # positions rise with id and line, since the partitions are ranges
    lines = seq.select("id", "uid", F.size("lines").alias("own"), F.posexplode(F.arrays_zip("lines", "words")).alias("line", "x"))
    lines = lines.select(F.monotonically_increasing_id().alias("pos"), "id", "uid", "line", F.col("own") - F.col("line"), F.col("x.lines").alias("key"), F.col("x.words").alias("words"))
    lines = durable(lines.toDF("pos", "id", "uid", "line", "left", "key", "words"))

    classes = _ordered(lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    active = durable(join_hot(lines, classes.drop("n"), ["key"], hottest(classes, lines.count())).drop("key"))

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ["id", "uid", "pos", "line", "n"]

        def made(t: pa.Table) -> pa.RecordBatch | None:
            pos, line, own, ids, uids = (t.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "line", "words", "doc", "uid"))
            # positions are consecutive within a document; a document's end is a gap, too
            gap = np.diff(pos) != 1
            gap |= line[1:] == 0
            stretch = pos + np.concatenate([[0], np.cumsum(gap)])
            starts, n = shortest_runs(stretch, own, min_words)
            if not len(starts):
                return None
            return pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(pa.array(starts)), pa.array(uids[starts]), pa.array(pos[starts]), pa.array(line[starts], pa.int32()), pa.array(n, pa.int32())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            docs_ = t.column("doc").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(docs_, docs_[-1], side="left"))  # the last document may go on
            held = t.slice(cut)
            if cut and (out := made(t.slice(0, cut))) is not None:
                yield out
        if held is not None and (out := made(held)) is not None:
            yield out

    # a document's first position names it
    by_doc = active.withColumn("doc", F.col("pos") - F.col("line")).select("id", "uid", "pos", "line", "words", "doc")
    by_doc = by_doc.repartition(parts, "doc").sortWithinPartitions("doc", "pos")
    wanted = durable(by_doc.mapInArrow(windows, "id bigint, uid bigint, pos bigint, line int, n int"))
    longest = wanted.agg(F.max("n")).first()[0] or 0

    ranks, found, k = active.select("pos", "left", "rank"), None, 0
    while (1 << k) <= longest:
        span = 1 << k
        level = wanted.where((F.col("n") >= span) & (F.col("n") < 2 * span))
        a, b = ranks.select("pos", F.col("rank").alias("r1")), ranks.select(F.col("pos").alias("pos2"), F.col("rank").alias("r2"))
        if span == 1:
            named = level.join(a, "pos").withColumn("r2", F.col("r1"))
        else:
            named = level.join(a, "pos").withColumn("pos2", F.col("pos") + F.col("n") - span).join(b, "pos2").drop("pos2")
        found = named if found is None else found.unionByName(named)
        k += 1
        if (1 << k) > longest:
            break
        pairs = durable(ranks.where(F.col("left") >= 2 * span).select("pos", "left", F.col("rank").alias("r1"), (F.col("pos") + span).alias("pos2")).join(b, "pos2").drop("pos2"))
        classes = _ordered(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1"), "r1", "r2")
        ranks = durable(join_hot(pairs, classes.drop("n"), ["r1", "r2"], hottest(classes, pairs.count())).select("pos", "left", "rank"))
    if found is None:
        return wanted.select("id", "uid", F.col("line").alias("at"), "n")
    found = durable(found)
    # the suffixes of one interval of common prefixes, n lines long, have both ranks in common
    keys = ["r1", "r2", "n"]
    intervals = durable(found.groupBy(*keys).agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1"))
    hot = hottest(intervals.select("r1", "r2", F.col("n").alias("long"), F.col("c").alias("n")), found.count())
    hot = hot and hot.select("r1", "r2", F.col("long").alias("n"))
    return join_hot(found, intervals.drop("c"), keys, hot).where("pos > first").select("id", "uid", F.col("line").alias("at"), "n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs cut from the text; dw_lines_deleted says how many lines went.
    A text that loses all its lines is empty."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    lost = runs.select("id", "uid", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line"))
    lost = lost.groupBy("id", "uid").agg(F.collect_set("line").alias("dw_lost")).select(F.col("id").alias("dw_id"), F.col("uid").alias("dw_uid"), "dw_lost")
    # while the lost lines' numbers are few, no text is shuffled
    lost = durable(lost)
    lost = small_side(lost, lost.agg(F.sum(4 * F.size("dw_lost") + 40)).first()[0])
    joined = docs.join(lost, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("dw_id")) & (F.xxhash64(text_col) == F.col("dw_uid")), "left")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lost_at = batch.schema.get_field_index(text_col), batch.schema.get_field_index("dw_lost")
            texts, gone = batch.column(at).to_pylist(), batch.column(lost_at).to_pylist()
            n = [len(g or ()) for g in gone]
            out = [t if not g else "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop]) for t, g in zip(texts, gone) for drop in (set(g or ()),)]
            columns = [c for i, c in enumerate(batch.columns) if i != lost_at]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], [*(x for x in batch.schema.names if x != "dw_lost"), "dw_lines_deleted"])

    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "dw_lost")
    return joined.mapInArrow(run, joined.drop("dw_lost").withColumn("dw_lines_deleted", F.lit(0).cast("long")).schema)

"""Operator 9: benchmark decontamination by n-gram windows.

Words are runs of ASCII letters and digits and of any non-ASCII characters, with A-Z lower-cased. A window
is WINDOW consecutive words of a benchmark item (an item of fewer words is one window). The windows' 64-bit
hashes form a broadcast set, sorted, beside the items' words; documents are scanned once, and every hit is
verified on the words themselves.

The broadcast is made only where the benchmark has at most BROADCAST_CHARS characters, which take 4 to 13
bytes each and 4 MB in a Python worker (a test holds it below 300 MB); beyond it, windows are joined as rows, by their
hashes, and hits verified likewise. Defined cases: null or wordless texts have no words and no hits; null items
are none; repeated rows each get their own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import durable, lean, small_batches, text_rows

WINDOW = 13
BROADCAST_CHARS = 16_000_000
_FILTER_BITS = 22
HITS = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
#: A-Z to a-z; ASCII that is no word character to space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_TABLE).split()


class _Words(dict):
    """64-bit hashes of words, of a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _hashed(tokens: list[bytes], known: _Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _windows(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * _P + w[i : len(w) - n + 1 + i]
    return h ^ (h >> np.uint64(32))


class WindowIndex:
    """Windows of the benchmark's items, for each length: sorted hashes, and where each window's words stand."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = ["" if i is None else str(i) for i, _ in items]
        known, blob, starts, first = _Words(), bytearray(), [], [0]
        hashes: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[np.ndarray]] = {}
        for _, text in items:
            tokens = words(text)
            ends = np.cumsum([len(t) + 1 for t in tokens], dtype=np.int64) if tokens else np.zeros(0, np.int64)
            starts.append(len(blob) + ends - [len(t) + 1 for t in tokens] if tokens else ends)
            blob += b"".join([t + b" " for t in tokens])
            if n := min(window, len(tokens)):
                hashes.setdefault(n, []).append(_windows(_hashed(tokens, known), n))
                places.setdefault(n, []).append(np.arange(first[-1], first[-1] + len(tokens) - n + 1, dtype=np.int64))
            first.append(first[-1] + len(tokens))
        self.blob, self.first = bytes(blob), np.array(first, np.int64)
        self.starts = np.concatenate([*starts, [len(blob)]]).astype(np.int64)
        self.tables = {}
        for n, parts in hashes.items():
            h, at = np.concatenate(parts), np.concatenate(places[n])
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables[n] = (h[order], at[order], maybe)

    def size(self) -> int:
        """Bytes that the index takes."""
        return len(self.blob) + self.first.nbytes + self.starts.nbytes + sum(x.nbytes for t in self.tables.values() for x in t)

    def scan(self, tokens: list[bytes], known: _Words) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the places of the items found."""
        hit, found = np.zeros(len(tokens), bool), set()
        w = _hashed(tokens, known) if self.tables else None
        for n, (hashes, places, maybe) in self.tables.items():
            if len(tokens) < n:
                continue
            own = _windows(w, n)
            for at in np.flatnonzero(maybe[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]):
                low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
                text = b" ".join(tokens[at : at + n]) + b" " if low < high else b""
                for place in places[low:high]:
                    if self.blob[self.starts[place] : self.starts[place + n]] == text:
                        hit[at : at + n] = True
                        found.add(int(np.searchsorted(self.first, place, "right")) - 1)
        return hit, found


def _row(n_words: int, n_hit: int, names: set[str]) -> tuple:
    return n_words, n_hit, hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _index(benchmark: DataFrame, window: int, broadcast_chars: int) -> WindowIndex | None:
    """The windows of a benchmark of bounded size, else None."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length(F.coalesce("text", F.lit(""))) + 40), F.lit(0))).first()[0]
    return None if size > broadcast_chars else WindowIndex([tuple(r) for r in items.collect()], window)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Hits of every document; see HITS for the columns."""
    if (found := _index(benchmark, window, broadcast_chars)) is None:
        return _joined(text_rows(docs, id_col, text_col), benchmark, window).drop("key")
    index = docs.sparkSession.sparkContext.broadcast(found)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, known = index.value, _Words()
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                tokens = words(text.as_py())
                hit, found = windows.scan(tokens, known)
                n, n_hit, sha, bad = _row(len(tokens), int(hit.sum()), {windows.names[p] for p in found})
                out.append((n, n_hit, len(found), sha, bad))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], HITS_NAMES)

    return text_rows(docs, id_col, text_col).mapInArrow(run, HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of docs that aren't contaminated. Each row is judged by its own text, even if ids repeat."""
    if (found := _index(benchmark, window, broadcast_chars)) is None:
        bad = _joined(text_rows(docs, id_col, text_col), benchmark, window).where("contaminated").select(F.col("doc_id").alias("dw_id"), F.col("key").alias("dw_key")).distinct()
        return docs.join(bad, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("dw_id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("dw_key")), "left_anti")
    index, place = docs.sparkSession.sparkContext.broadcast(found), docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, known = index.value, _Words()
        for batch in batches:
            clean = []
            for text in batch.column(place).cast(pa.string()).cast(pa.binary()):
                tokens = words(text.as_py())
                clean.append(not _row(len(tokens), int(windows.scan(tokens, known)[0].sum()), set())[3])
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


HITS_NAMES = [c.split()[0] for c in HITS.split(", ")]


def _joined(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The way for a benchmark too large to broadcast: the windows' hashes meet in a join, one row for each window
    of the benchmark; the documents that have some are then read again, and the windows compared by their words."""
    lowered = lambda c: F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda c: F.filter(F.split(lowered(c), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    gram = lambda at, n: F.array_join(F.slice("w", at, n), " ")

    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), split(F.col("text").cast("string")).alias("w")).withColumn("n", F.least(F.lit(window), F.size("w"))).where("n > 0")
    item = item.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: gram(i, F.col("n")))).alias("gram"))
    item = durable(item.groupBy("n", "gram").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("gram")))
    lengths = [r[0] for r in item.select("n").distinct().collect()] or [window]  # at most `window` values
    doc = rows.select("doc_id", F.xxhash64("text").alias("key"), split(F.col("text")).alias("w"))
    hashes = [F.when(F.size("w") >= n, _at_each(n, gram)).otherwise(F.array().cast("array<struct<n:int,at:int,h:bigint>>")) for n in lengths]
    met = doc.select("doc_id", "key", F.explode(F.concat(*hashes)).alias("x")).select("doc_id", "key", "x.*").join(item, ["n", "h"])
    met = met.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "n", "gram", "items")).alias("met")).select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "met")
    out = doc.join(met, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    out = out.withColumn("hits", F.filter("met", lambda x: gram(x["at"], x["n"]) == x["gram"]))
    n_words = F.size("w").cast("long")
    n_hit = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))), F.lit(0)).cast("long")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    out = out.select("doc_id", "key", n_words.alias("n_words"), n_hit.alias("n_hit"), found.alias("found"))
    return out.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "key")


def _at_each(n: int, gram):
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.xxhash64(gram(i, F.lit(n))).alias("h")))

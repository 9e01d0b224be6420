"""Operator 1: BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent symbols that occurs inside no vocabulary token can never be merged across, so a cut
there is certain. Words are cut at such pairs, the fragments are merged independently and their ids
concatenated. Only the last fragment of a word carries the end-of-word mark.

Words that the cache doesn't know are taken in blocks, each once. All their fragments are merged together, in
tables of one row a fragment: each round merges every row's pair of least rank, so that rows lose one symbol a
round and those of equal length lie in one table.

Defined cases: null text is encoded as the empty text (no ids, empty decoded text); very long words are
merged with a heap in n log n; repeated rows each get their own result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import lean, text_rows

ENCODED = "doc_id bigint, ids array<int>, decoded string"
#: Entries of a worker's cache before it becomes the older one, which bounds its memory.
CACHE = 100_000
#: Texts are gathered until they have so many words, which are then looked up (twice as many at once at most).
BLOCK = 50_000
#: Symbols of the longest fragment that is merged in a table.
WIDE = 40


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers file whose model is byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.texts = pa.array(self.tokens, pa.string())
        self.missing = len(self.tokens)
        self.size = self.missing + 1

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int32)
        self.rank_of = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        keys = np.fromiter(self.rank_of, np.int64, len(self.rank_of))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(self.rank_of.values(), np.int32, len(keys))[order], np.int32(_NEVER))

        # bytes at 0 to 255, bytes at the end of a word from 256
        self.symbols = np.array([vocab.get(_LETTERS[b] + end, self.missing) for end in ("", suffix) for b in range(256)], np.int32)
        self.first_ranks = self._rank(self.symbols[:, None], self.symbols[None, :]).ravel()
        self.joinable = np.zeros(65536, bool)
        for pair in {p for t in vocab for p in _pairs(t.removesuffix(suffix) if suffix else t)}:
            if pair[0] in _BYTE_OF and pair[1] in _BYTE_OF:
                self.joinable[_BYTE_OF[pair[0]] << 8 | _BYTE_OF[pair[1]]] = True

        self.added_re = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.marks = {t: np.int32(i).tobytes() for t, i in added.items()}
        self.chunks, self.older = dict(self.marks), {}

    @functools.cached_property
    def library(self):
        """The library's normalizer and pre-tokenizer, for chunks that need them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; _NEVER where they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(_NEVER))

    def _forced(self, data: np.ndarray) -> np.ndarray:
        """For each byte but the first: is the boundary before it forced?"""
        return ~self.joinable[data[:-1].astype(np.int32) << 8 | data[1:]]

    def cuts(self, word: str) -> list[bytes]:
        """The fragments of a word between forced boundaries."""
        data = word.encode()
        at = (np.flatnonzero(self._forced(np.frombuffer(data, np.uint8))) + 1).tolist()
        return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, rank, size, merged = len(symbols), self.rank_of.get, self.size, self.merged.item
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if live[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], right[i] = merged(r), False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank(symbols[x] * size + symbols[y])) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s, keep in zip(symbols, live) if keep]

    def _merge(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments one after the other, and how many each has: the pair of least rank first, from the left.
        Fragments are given by starts and sizes in the codes of their bytes."""
        symbols, ranks = self.symbols[codes], self.first_ranks[codes[:-1] << 9 | codes[1:]]
        counts, done = np.zeros(len(starts), np.int64), []
        for k in np.flatnonzero(sizes > WIDE).tolist():
            ids = np.array(self._merge_long(symbols[starts[k] : starts[k] + sizes[k]].tolist()), np.int32)
            done.append((np.array([k]), ids[None, :]))
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(1, WIDE + 2))
        rows = np.empty(0, np.int64)
        for width in range(WIDE, 0, -1):
            if not len(rows):
                table, rank = np.empty((0, width), np.int32), np.empty((0, width - 1), np.int32)
            more = order[bounds[width - 1] : bounds[width]]
            if len(more):
                at = starts[more][:, None] + np.arange(width)
                rows, table, rank = np.concatenate([rows, more]), np.concatenate([table, symbols[at]]), np.concatenate([rank, ranks[at[:, :-1]]])
            if width == 1:
                done.append((rows, table))
                break
            if not len(rows):
                continue
            i = rank.argmin(1)
            low = rank[np.arange(len(rows)), i]
            live = low < _NEVER
            if not live.all():
                done.append((rows[~live], table[~live]))
                rows, table, rank, i, low = rows[live], table[live], rank[live], i[live], low[live]
            n = np.arange(len(rows))
            table[n, i] = self.merged[low]
            table, rank = _without(table, n, i + 1), _without(rank, n, i)
            k = np.flatnonzero(i > 0)
            rank[k, i[k] - 1] = self._rank(table[k, i[k] - 1], table[k, i[k]])
            k = np.flatnonzero(i < width - 2)
            rank[k, i[k]] = self._rank(table[k, i[k]], table[k, i[k] + 1])
        for k, table in done:
            counts[k] = table.shape[1]
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for k, table in done:
            out[at[k][:, None] + np.arange(table.shape[1])] = table
        if (out == self.missing).any():
            raise KeyError("a byte that the vocabulary doesn't have")
        return out, counts

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        data = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(data == 10)
        data, ends = data[data != 10], ends - np.arange(len(ends))
        codes = data.astype(np.int32)
        codes[ends - 1] += 256
        cut = np.ones(len(data), bool)
        cut[1:] = self._forced(data)
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        ids, counts = self._merge(codes, starts, np.diff(starts, append=len(data)))
        total = np.cumsum(counts)[np.searchsorted(starts, ends) - 1]
        return ids, np.diff(total, prepend=0)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does for a file without a decoder: the tokens joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Decoded texts, whose ids lie one after the other between the ends."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.texts.take(pa.array(ids))), " ")

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a run without white space, by the library."""
        library = self.library
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))
        return [bytes([_BYTE_OF[c] for c in w]).decode() for w, _ in found]

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids (int32 bytes) of runs without white space. Latin-1 text without control characters, where nothing
        composes and each letter has one lower case, needs no call of the library."""
        plain = _PLAIN.fullmatch
        odd = [c for c in chunks if not plain(c)]
        if odd:
            chunks = [c for c in chunks if plain(c)]
        found = _PIECE.findall(" ".join([*chunks, ""]).lower())
        for c in odd:
            found += self.pieces(c)
            found.append(" ")
        number = {w: k for k, w in enumerate(dict.fromkeys([" ", *found]))}
        which = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        ids, counts = np.empty(0, np.int32), np.zeros(1, np.int64)
        if len(number) > 1:
            ids, counts = self._words(list(number)[1:])
            counts = np.concatenate([[0], counts])
        ids, sizes = _taken(ids, counts, which)
        data, bounds = ids.tobytes(), (4 * np.cumsum(sizes)[which == 0]).tolist()
        return {c: data[a:b] for c, a, b in zip(chunks + odd, [0, *bounds], bounds)}

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each part: a run without white space, or an added token."""
        if len(self.chunks) >= CACHE:
            self.chunks, self.older = dict(self.marks), self.chunks
        known, older = self.chunks, self.older
        new = set(parts).difference(known)
        again = {c: older[c] for c in new if c in older}
        known |= again
        if new := list(new.difference(again)):
            known |= self._new(new)
        got = list(map(known.__getitem__, parts))
        for c in new:
            if len(c) > 100:
                del known[c]
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other; their ends, from 0 on."""
        ids, ends = [], [np.zeros(1, np.int64)]
        parts: list[str] = []
        counts: list[int] = []

        def flush() -> None:
            sizes = [np.zeros(1, np.int64)]
            for at in range(0, len(parts), 2 * BLOCK):
                got = self._known(parts[at : at + 2 * BLOCK])
                ids.append(b"".join(got))
                sizes.append(np.fromiter(map(len, got), np.int64, len(got)) // 4)
            ends.append(ends[-1][-1] + np.cumsum(np.concatenate(sizes))[counts])
            parts.clear()
            counts.clear()

        for text in texts:
            parts += self._parts(text or "")
            counts.append(len(parts))
            if len(parts) >= BLOCK:
                flush()
        if counts:
            flush()
        return np.frombuffer(b"".join(ids), np.int32), np.concatenate(ends)

    def _parts(self, text: str) -> list[str]:
        if self.added_re is None or not self.added_re.search(text):
            return _split(text)
        out, at = [], 0
        for m in self.added_re.finditer(text):
            out += _split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + _split(text[at:])


def _split(text: str) -> list[str]:
    # str.split() also parts at \x1c-\x1f, which the normalizer doesn't take for white space
    return [x for x in _SPACE.split(text) if x] if _CONTROL.search(text) else text.split()


def _taken(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie one after the other in ids, those numbered by which, and their sizes."""
    starts, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())], sizes


def _without(table: np.ndarray, rows: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The table without one cell of each row."""
    keep = np.ones(table.shape, bool)
    keep[rows, column] = False
    return table[keep].reshape(len(table), -1) if len(table) else table[:, 1:]


_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_NEVER = 1 << 30
_PLAIN = re.compile("[!-~\\xa1-\\xff]+")
#: The file's pre-tokenizer pattern, for lower-cased Latin-1: contractions, letters, one number, anything else; and the spaces between chunks.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff]+|[0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]|\\x20|[^\\x20a-z0-9\\xaa\\xb2\\xb3\\xb5\\xb9\\xba\\xbc-\\xbe\\xdf-\\xf6\\xf8-\\xff]+")


def _byte_letters() -> list[str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as the letters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    return [letters[b] for b in range(256)]


_LETTERS = _byte_letters()
_BYTE_OF = {c: b for b, c in enumerate(_LETTERS)}


def _pairs(s: str) -> Iterator[str]:
    return map("".join, zip(s, s[1:]))


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each file and process, until it is released."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def loaded() -> int:
    """Encoders that this process holds."""
    return len(_LOADED)


def release(path: str) -> None:
    """Python workers outlive their tasks and go on to other operators: the tables (some 60 MB) go, and what was cached."""
    _LOADED.pop(path, None)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row; no shuffle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        try:
            for batch in batches:
                gc.disable()  # encoding makes no cycles, and the collector would run through the caches
                ids, ends = bpe.encode_all(batch.column(1).to_pylist())
                gc.enable()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists, bpe.decode_all(ids, ends)], ["doc_id", "ids", "decoded"])
        finally:
            gc.enable()
            release(tokenizer_path)

    return text_rows(docs, id_col, text_col).mapInArrow(run, ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    """Token counts and SHA-256 digests of what encode_decode returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

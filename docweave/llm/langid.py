"""Operator 8: language identification by multilingual mixture inference.

Training counts hashed byte trigrams of every labelled training document, for each language. A document is
taken for a mixture: expectation-maximisation estimates the languages' shares from its trigram likelihoods,
and the set of languages is the one of greatest penalised (BIC) likelihood. The model has BUCKETS figures
for each language and is all that is broadcast.

Defined cases: null, empty or letterless text is `und` with score 0; more than MAX_LANGUAGES languages are an error; rows without a language or id rule are
not trained on; without any training document every row is `und`; repeated rows each count and each get a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import lean, text_rows

BUCKETS = 1 << 15
ROUNDS = 12
UND = "und"
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: More languages than these are refused: the model is BUCKETS figures for each, in every worker.
MAX_LANGUAGES = 500
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; signs such as \u00bd and \u00b2 are numbers."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def grams(text: bytes) -> np.ndarray:
    """Bucket of each trigram of letters (ASCII lower-cased, other ASCII characters as one space)."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_TABLE).split()) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return code >> np.uint32(17)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (BUCKETS x languages), from all rows of `labelled`."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if lang is not None and text:
                    if lang not in total:
                        total[lang] = np.zeros(BUCKETS, np.int64)
                    total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    got = rows.where("lang is not null and text is not null").mapInArrow(count, "lang string, bucket int, n bigint")
    got = got.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if got.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # at most BUCKETS rows for each language
    sums = got.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in sums)
    table = np.full((BUCKETS, len(langs)), 0.5)
    for r in sums:
        table[r["b"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the columns of p (likelihoods) by expectation-maximisation, and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        share = share * (p.T @ (n / (p @ share))) / total
    return share, float(n @ np.log(p @ share))


def infer(log_p: np.ndarray, text: bytes) -> tuple[int, float, np.ndarray]:
    """Place of the largest language, its share, and the shares of all (zero outside the chosen set)."""
    counts = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    n, lp = counts[at].astype(np.float64), log_p[at].astype(np.float64)
    p = np.exp(lp - lp.max(1, keepdims=True))  # scaled by row: shares and differences stay
    shares, _ = mixture(p, n) if p.shape[1] > 1 else (np.ones(1), 0.0)
    order = np.argsort(-shares, kind="stable")
    best, chosen, penalty = -np.inf, (np.ones(1), order[:1]), 0.5 * np.log(max(2.0, n.sum()))
    total = n.sum()
    for k in range(1, len(order) + 1):
        if k > 1 and shares[order[k - 1]] * total < 0.5:  # not a trigram's worth
            break
        own, score = mixture(p[:, order[:k]], n) if k > 1 else (np.ones(1), float(n @ np.log(np.maximum(p[:, order[0]], 1e-300))))
        if score - k * penalty > best:
            best, chosen = score - k * penalty, (own, order[:k])
    out = np.zeros(p.shape[1])
    out[chosen[1]] = chosen[0]
    top = int(np.argmax(out))
    return top, float(min(1.0, max(0.0, out[top]))), out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, and langs (the chosen set with its shares); with keep, all columns of docs and these as dw_lang, dw_score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> tuple[list, list, list]:
        langs, log_p = held.value
        preds, scores, sets = [], [], []
        for text in texts.to_pylist():
            if not langs or not text or not has_letter(text):
                preds.append(UND), scores.append(0.0), sets.append([])
                continue
            top, score, shares = infer(log_p, text.encode())
            preds.append(langs[top]), scores.append(score)
            sets.append([{"lang": langs[i], "share": float(shares[i])} for i in np.flatnonzero(shares)])
        return preds, scores, sets

    if keep:
        place = docs.columns.index(text_col)

        @lean
        def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                preds, scores, _ = predict(batch.column(place).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "dw_lang", "dw_score"])

        schema = docs.limit(0).withColumns({"dw_lang": F.lit("").cast("string"), "dw_score": F.lit(0.0)}).schema
        return docs.mapInArrow(run_all, schema)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            preds, scores, sets = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "langs"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))

"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; run() writes
each stage's result as Parquet in the shared folder and reads it for the next. Stages but the last return
the columns of documents. Null and empty texts are `und` and go in the first stage; a document whose lines
all were copies of earlier ones goes in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, decontaminate, langid, linededup, neardup
from docweave.llm.common import durable, small_side, table
from docweave.llm.paths import word_bpe


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (no text or no letter); trained on the labelled rows whose ids are not held out."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model, keep=True).where(F.col("dw_lang") != langid.UND).drop("dw_lang", "dw_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated runs of lines; n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    cut = F.col("dw_lines_deleted") > 0
    out = out.where(~cut | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("dw_lines_deleted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id; of rows that repeat its id,
    which are one group, the one whose text hashes least. Rows without an id stay."""
    gone = durable(neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dw_id")).distinct())
    left = docs.join(small_side(gone, 50 * gone.count()), docs["doc_id"] == F.col("dw_id"), "left_anti")
    repeated = durable(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("dw_id")).agg(F.count("*").alias("dw_n")).where("dw_n > 1").drop("dw_n"))
    if repeated.isEmpty():
        return left
    repeated = small_side(repeated, 50 * repeated.count())
    again = left["doc_id"] == F.col("dw_id")
    one = left.join(repeated, again, "left_semi").groupBy(F.col("doc_id").alias("dw_id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")).alias("dw_row"))
    return left.join(repeated, again, "left_anti").unionByName(one.select("dw_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule hits go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text left."""
    return bpe.digests(bpe.encode_decode(docs, word_bpe()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encode", encode),
]

#: Language inference and subword encoding can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs

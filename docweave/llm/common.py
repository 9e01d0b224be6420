"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset and everything runs in one
    process (local tests), a temporary one; other executors couldn't read such a folder, so on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(sc, "_docweave_dir", None)
        if path is None:
            path = sc._docweave_dir = "file://" + tempfile.mkdtemp(prefix="docweave-")
    return path.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, and a lost
    executor costs nothing that was done before. The files go by release(), or else when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, fs = _file(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweave_path = path
    return out


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that durable() wrote, once nothing reads them any more (what came of them is written)."""
    for df in tables:
        if (path := getattr(df, "_docweave_path", None)) is not None:
            target, fs = _file(df.sparkSession, path)
            fs.delete(target, True)
            fs.cancelDeleteOnExit(target)


#: Largest table that is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16_000_000


def small_side(df: DataFrame, size: int | None) -> DataFrame:
    """df, marked for broadcast if its `size` in bytes (of all rows) keeps within BROADCAST_BYTES."""
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


#: A key with more than this share of a table's rows is hot; so a table has 1 / HOT_SHARE hot keys at most.
HOT_SHARE = 0.001
#: Below this, a share of a table's rows is no burden for one task.
HOT_ROWS = 50


def hot_keys(df: DataFrame, *keys: str) -> DataFrame | None:
    """The hot keys of df and their counts (n): 1 / HOT_SHARE rows at most, whatever the input. None if there is none."""
    return hottest(df.groupBy(*keys).agg(F.count("*").alias("n")), df.count())


def hottest(counts: DataFrame, total: int) -> DataFrame | None:
    """Of key counts (column n) that sum to total, those of hot keys; None if there is none."""
    rows = counts.where(F.col("n") > HOT_SHARE * total).collect() if total * HOT_SHARE > HOT_ROWS else []
    return counts.sparkSession.createDataFrame(rows, counts.schema) if rows else None


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """many JOIN few on keys, where few has a row for each key (or one for each of a few kinds): rows with the
    keys in `hot` meet theirs by broadcast, where they lie; all others by a join in which no key stands out."""
    if hot is None:
        return many.join(few, keys)
    hot = F.broadcast(hot.select(*keys))
    return many.join(F.broadcast(few.join(hot, keys, "left_semi")), keys).unionByName(many.join(hot, keys, "left_anti").join(few.join(hot, keys, "left_anti"), keys))


def join_spread(many: DataFrame, few: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """As join_hot, for rows of `few` too large to broadcast: a hot key's rows are dealt over as many parts as its
    count (n in `hot`) holds hot shares, by the column `by`, and its row of `few` is copied to each part."""
    if hot is None:
        return many.join(few, key)
    least = hot.agg(F.min("n")).first()[0]
    parts = hot.select(F.col(key).alias("dw_k"), F.ceil(2 * F.col("n") / least).cast("int").alias("dw_parts"))
    dealt = lambda df: df.join(F.broadcast(parts), df[key] == parts["dw_k"], "left").drop("dw_k")
    n = F.coalesce("dw_parts", F.lit(1))
    many = dealt(many).withColumn("dw_part", F.pmod(F.xxhash64(by), n).cast("int")).drop("dw_parts")
    few = dealt(few).withColumn("dw_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("dw_parts")
    return many.join(few, [key, "dw_part"]).drop("dw_part")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of an Arrow batch of whole texts, for this session, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):
        spark.conf.set(key, size)


Batches = Iterator[pa.RecordBatch]
#: Rows of a slice of an Arrow batch that is worked on at once.
SLICE = 500


def _sliced(batches: Batches) -> Batches:
    for batch in batches:
        for start in range(0, max(batch.num_rows, 1), SLICE):
            yield batch.slice(start, SLICE)


def lean(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f gets slices of SLICE rows, so that what it makes of whole texts stays small. (What a batch holds is bounded
    in rows and bytes by the session, spark.sql.execution.arrow.max...PerBatch.) Python workers outlive their
    tasks: at a task's end the memory that it took is given back."""

    @functools.wraps(f)
    def run(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(_sliced(batches))
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text under fixed names, so further columns and clashing names do no harm."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

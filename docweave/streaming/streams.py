"""Structured Streaming: a document a row makes every operator stateless, so each runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc: a line of the folder's files, as they come."""
    return spark.readStream.text(path).select(F.col("value").alias("doc"))


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def consume(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to a sink."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental maintenance: micro-batches of documents are put into a stored index, or into a stored table.

``ingest_index`` makes each batch a segment of the index: a batch costs what is in it, and the index can be searched
after each. ``ingest`` keeps texts only, from which an index can be built. There a batch is appended with its number as version. Reading takes, of each key, the row of the latest version; a row
without text says that the document is deleted. Appending is idempotent by batch: a batch that is run again after
a failure replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.sources.index import Index
from termloom.sources.segments import Segments


def append_batch(batch: DataFrame, version: int, path: str) -> None:
    """Write one batch of (key, text) as ``version``."""
    last = batch.groupBy("key").agg(F.max("text").alias("text"))  # of rows that share a key in a batch, the greatest
    last.write.mode("overwrite").parquet(f"{path}/version={version}")


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start taking in a stream of (key, text); all that is available is processed, then the query ends."""
    writer = stream.select("key", "text").writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of all documents that are not deleted."""
    versions = spark.read.parquet(path)
    latest = versions.groupBy("key").agg(F.max_by("text", "version").alias("text"))
    return latest.where(F.col("text").isNotNull())


def current_index(spark: SparkSession, path: str) -> Index:
    return Index.build(current(spark, path), "key", "text")


def ingest_index(stream: DataFrame, root: str, checkpoint: str, buckets: int = 16, order: str | None = None) -> StreamingQuery:
    """Start taking a stream of (key, text) into the segmented index at ``root``; a row without text deletes its key,
    and of a batch's rows of one key the last by ``order`` counts. All that is available is processed, then the query
    ends. A batch that is run again after a failure is not put in twice."""

    def take(batch: DataFrame, number: int) -> None:
        Segments.open(batch.sparkSession, root, buckets).apply(batch, "key", "text", order, number + 1)

    writer = stream.select("key", "text", *([order] if order else [])).writeStream.foreachBatch(take)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

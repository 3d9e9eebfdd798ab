"""Resumable appends: keys that a sink already holds are skipped, in batch and as a stream.

The reference has no streaming operator; this is its resume behaviour (first row of a key wins) as Spark runs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.evidence import latest_rows


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the sink doesn't hold yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_once(rows: DataFrame, path: str, key: str, order: list[Column]) -> int:
    """Appends the first row of every key that `path` lacks; returns how many keys the sink holds then. One writer at a time."""
    spark = rows.sparkSession
    first = latest_rows(rows, key, order)
    try:
        first = pending(first, spark.read.schema(rows.schema).parquet(path), key)
    except Exception as missing:  # the first run: the sink isn't there yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    first.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(key).distinct().count()


def stream_once(spark: SparkSession, source: str, schema, path: str, checkpoint: str, key: str, event_time: str, lateness: str) -> StreamingQuery:
    """File stream to Parquet that drops keys seen before within `lateness` of event time; state beyond that is released.

    Exactly once by the file sink's log and the checkpoint; restart it with the same checkpoint to resume.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    once = rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

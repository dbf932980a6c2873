"""Duplicates of a stream by the hash of their content, within a bounded time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_contents(rows: DataFrame, time: str, content: list[str], keep: str) -> DataFrame:
    """Rows with `content_hash`, of equal ones within `keep` the first that comes in; the state holds no longer."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp")).withColumn("content_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    return rows.withWatermark(time, keep).dropDuplicatesWithinWatermark(["content_hash"])


def run_available(stream: DataFrame, folder: str, time: str, content: list[str], keep: str) -> DataFrame:
    """Take in all that is there and give the table of first contents."""
    out = f"{folder}/rows"
    first_contents(stream, time, content, keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)

"""Ingest of a stream without repeats: rows whose key is new are appended, a batch a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, seen: DataFrame | None, key: str, order: str) -> DataFrame:
    """The first row of each key by the order column, if the key has not been seen, and its `copies` in the batch."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r"), F.count("*").alias("copies")).select("r.*", "copies")
    return first if seen is None else first.join(seen.select(key), key, "left_anti")


def run_available(stream: DataFrame, table: str, checkpoint: str, key: str, order: str) -> DataFrame:
    """Take in all that is there and give the table, with `batch` and `copies`.

    A batch overwrites its own folder and compares with the folders of earlier batches alone, so that a batch that is run
    again after a failure, or a query that is started again on the same folders, gives the same rows.
    """

    def take(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.read.parquet(table).where(F.col("batch") < number) if number else None
        new_rows(batch, seen, key, order).write.mode("overwrite").parquet(f"{table}/batch={number:08d}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return stream.sparkSession.read.parquet(table)

"""Additive totals that grow with each batch of a stream instead of being counted anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.sources.versions import VersionedTable


def counted(rows: DataFrame, keys: list[str], flags: dict[str, object]) -> DataFrame:
    """Rows, and rows for which each flag holds, by key; a null flag does not hold, null keys are a group of their own."""
    held = [F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias(name) for name, c in flags.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *held)


def add_batch(table: VersionedTable, batch: DataFrame, number: int, keys: list[str], flags: dict[str, object]) -> bool:
    """Add a batch to the totals as a new version; False, without effect, where it or a later one has been added.

    The version's note tells the batch, how many batches there were, their rows, and the rows of this one, so the
    totals and the counters come into force together.
    """
    table = VersionedTable(batch.sparkSession, table.path, table.partition_by)  # a stream's batches have a session of their own
    before = table.manifest()
    note = before["note"]
    if note.get("batch", -1) >= number:
        return False
    seen = Observation()
    delta = counted(batch.observe(seen, F.count(F.lit(1)).alias("rows")), keys, flags)
    sums = ["n", *flags]
    kind = StructType([*(StructField(k, batch.schema[k].dataType) for k in keys), *(StructField(s, LongType()) for s in sums)])
    both = table.read(before["version"] or None, kind).unionByName(delta)
    merged = both.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))

    def counters() -> dict:
        rows = seen.get.get("rows", 0)
        return {"batch": number, "ticks": note.get("ticks", 0) + 1, "total": note.get("total", 0) + rows, "last": rows}

    table.write(merged, counters)
    return True


def run_available(stream: DataFrame, table: VersionedTable, checkpoint: str, keys: list[str], flags: dict[str, object]) -> DataFrame:
    """Add all that is there, and give the totals. A query that is started again goes on where it was; the batch that it
    broke off in is added once, since a version names its batch."""

    def take(batch: DataFrame, number: int) -> None:
        add_batch(table, batch, number, keys, flags)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return table.read()

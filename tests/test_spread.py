"""Rows of a task do not grow with the tables."""

import glob

from pyspark.sql import functions as F

from quillon.operators import loads
from quillon.sources import tables


def test_mentions_are_spread_by_their_number(spark, sf, monkeypatch):
    n = tables.table(spark, sf, "lineitem").count()
    want = sorted(map(tuple, tables.mentions(spark, sf).collect()))
    for rows in (n // 20, n // 40):
        monkeypatch.setattr(tables, "ROWS", rows)
        m = tables.mentions(spark, sf)
        assert m.rdd.getNumPartitions() == -(-n // rows) and sorted(map(tuple, m.collect())) == want
        at = m.withColumn("at", F.spark_partition_id()).groupBy("post").agg(F.countDistinct("at").alias("n"))
        assert at.where("n > 1").count() == 0
        assert max(r["count"] for r in m.groupBy(F.spark_partition_id()).count().collect()) <= 2 * rows


def test_sync_writes_few_files_a_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 500)
    monkeypatch.setattr(loads, "BLOCK", 10)
    rows = spark.range(6000).select((F.col("id") * 700).alias("post"), F.explode(F.array(F.lit("exposure"), F.lit("condition"))).alias("kind"), F.concat(F.lit("x"), F.col("id") % 7).alias("name"))
    ledger = loads.ledger(spark, str(tmp_path / "ledger"))
    assert loads.sync(ledger, rows.where("post % 1400 = 0"))["mapped"] == 3000
    assert loads.sync(ledger, rows) == {"sync": 2, "mapped": 3000, "skipped": 3000}
    assert ledger.read().count() == 12000 and ledger.read().select("post", "kind").distinct().count() == 12000
    assert len(glob.glob(str(tmp_path / "ledger/data/*/*/*.parquet"))) > 5  # several tasks wrote

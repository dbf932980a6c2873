"""Table readers and the mapping of order tables onto safety-report shapes.

A post is an order, a product is a part's brand, an event is the supplier's nation, its organ system the region.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a task where rows are spread by their number, so that what a task holds does not grow with the tables (Spark
#: itself puts up to 64 MB of packed rows into one).
ROWS = 1 << 17


def spread(rows: DataFrame, n: int, *by) -> DataFrame:
    """Rows in tasks by the hash of `by`, about ROWS of the n rows in each."""
    return rows.repartition(max(1, -(-n // ROWS)), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post, posted_at, author, country, region, ae_flag, severity."""
    t = lambda n: table(spark, sf_dir, n)
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = people.select("c_custkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    orders = t("orders").select(
        F.col("o_orderkey").alias("post"), F.to_date("o_orderdate").alias("posted_at"), F.col("o_custkey").alias("author"),
        (F.col("o_orderstatus") == "F").alias("ae_flag"), F.col("o_orderpriority").alias("severity"),
    )
    return orders.join(people, F.col("author") == F.col("c_custkey")).drop("c_custkey")


def mentions(spark: SparkSession, sf_dir: str, month: str | None = None, fine: bool = False) -> DataFrame:
    """Distinct (post, drug, event, soc), of all posts or of one month (yyyy-MM); `fine` products are a brand and size.

    Rows are spread by post, so joins and groups by post go on from there."""
    t = lambda n: table(spark, sf_dir, n)
    drug = F.concat_ws("/", "p_brand", F.col("p_size").cast("string")) if fine else F.col("p_brand")
    parts = t("part").select("p_partkey", drug.alias("drug"))
    events = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    events = events.select("s_suppkey", F.col("n_name").alias("event"), F.col("r_name").alias("soc"))
    lines = t("lineitem").select(F.col("l_orderkey").alias("post"), "l_partkey", "l_suppkey")
    if month:
        start = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
        of_month = t("orders").where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < start + F.expr("interval 1 month")))
        lines = lines.join(of_month.select(F.col("o_orderkey").alias("post")), "post")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(events, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select("post", "drug", "event", "soc")
    return (rows if month else spread(rows, t("lineitem").count(), "post")).distinct()


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder; in local mode, without one, a
    temporary folder; on a cluster its absence is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quillon-")


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several joins read to the shared folder, and read it again: computed once, no lineage kept."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

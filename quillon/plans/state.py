"""Queries of what is kept between runs: rebuilt partitions, syncs, phases, totals and sequential looks, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import dma, loads, sinks
from quillon.sources.tables import materialised, mentions, posts, scratch, table
from quillon.sources.versions import VersionedTable
from quillon.streaming import looks, totals

from .operations import sql_critical
from .signals import BAG, POSTS


def snk08_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of one project rebuilt from scratch as a new version: its rows alone are written, reviewed states are kept."""
    signals = VersionedTable(spark, f"{scratch(spark)}/signals-{uuid.uuid4().hex}", partition_by="project")
    project = F.substring("drug", 7, 1).alias("project")
    rows = dma.pair_counts(mentions(spark, sf)).select("drug", "event", "a", F.when(F.col("a") % 2 == 0, "reviewed").otherwise("new").alias("state"), project)
    signals.write(rows)
    reviewed = signals.read().where("project = '1' and state = 'reviewed'").select("drug", "event", "state")
    of_ae = mentions(spark, sf).join(posts(spark, sf).where("ae_flag").select("post"), "post", "left_semi")
    fresh = dma.pair_counts(of_ae).select("drug", "event", "a", project).where("project = '1'")
    signals.replace("1", sinks.carried(fresh, reviewed, ["drug", "event"], {"state": "new"}).select("drug", "event", "a", "state", "project"))
    return signals.read().groupBy("project", "state").agg(F.count("*").alias("n"), F.sum("a").alias("a"))


def etl04_synced(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures and conditions of the posts before 1998, then a sync of all posts: the second adds the new ones alone."""
    m = mentions(spark, sf).join(posts(spark, sf).select("post", "posted_at"), "post")
    kinds = F.explode(F.array(F.struct(F.lit("exposure").alias("kind"), F.col("drug").alias("name")), F.struct(F.lit("condition").alias("kind"), F.col("event").alias("name")))).alias("k")
    rows = m.select("post", "posted_at", kinds).select("post", "posted_at", "k.*")
    synced = loads.ledger(spark, f"{scratch(spark)}/synced-{uuid.uuid4().hex}")
    loads.sync(synced, rows.where("posted_at < '1998-01-01'"))
    loads.sync(synced, rows)
    return synced.read().groupBy("sync", "kind", "name").agg(F.count("*").alias("n"))


def etl07_phases(spark: SparkSession, sf: str) -> DataFrame:
    """The phases of a load, each a versioned table that the next ones read: vocabulary, baseline, events and refreshed
    signals. The second run keeps them all."""
    files = tuple(f"{sf}/{t}.parquet" for t in ("lineitem", "part", "supplier", "nation", "region"))
    bag = lambda: mentions(spark, sf)
    phases = [
        loads.Phase("vocabulary", lambda read: bag().select(F.explode(F.array("drug", "event")).alias("name")).distinct(), inputs=files),
        loads.Phase("baseline", lambda read: dma.pair_counts(bag().where("post % 2 = 0")), inputs=files),
        loads.Phase("events", lambda read: bag().join(read("vocabulary").withColumnRenamed("name", "drug"), "drug", "left_semi"), needs=("vocabulary",), inputs=files),
        loads.Phase("refresh", lambda read: dma.pair_counts(read("events")).join(read("baseline").select("drug", "event"), ["drug", "event"], "left_anti"), needs=("events", "baseline")),
    ]
    folder = f"{scratch(spark)}/load-{uuid.uuid4().hex}"
    for _ in range(2):
        loads.run_phases(spark, folder, phases)
    return loads.runs(spark, folder).where("run = 2").select("phase", "status", "n")


def str06_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the events by type, added batch by batch of a stream of three files."""
    folder = f"{scratch(spark)}/totals-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events")
    rows.repartition(3, "event_id").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    flags = {"large": F.col("value") >= 100, "morning": F.hour("ts") < 12}
    return totals.run_available(stream, VersionedTable(spark, f"{folder}/table"), f"{folder}/state", ["event_type"], flags)


def str09_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential surveillance of each product, a look a month, as a stream: reports so far against 0.9 of those expected
    of its share, tested against the boundary at the counts so far."""
    m = mentions(spark, sf).join(posts(spark, sf).select("post", F.trunc("posted_at", "month").alias("look")), "post")
    by = materialised(m.groupBy("drug", "look").agg(F.count("*").alias("n")), "looks")
    share = by.groupBy("drug").agg(F.sum("n").alias("of_drug")).crossJoin(F.broadcast(by.agg(F.sum("n").alias("total"))))
    every = by.groupBy("look").agg(F.sum("n").alias("all"))
    # months are few however long the tables are
    rows = share.select("drug", (F.col("of_drug") / F.col("total")).alias("share")).crossJoin(F.broadcast(every)).join(by, ["drug", "look"], "left").fillna(0, ["n"])
    rows = materialised(rows.select("drug", F.col("look").cast("timestamp").alias("look"), "n", (F.col("all") * F.col("share") * 0.9).alias("expected")), "expected")
    folder = f"{scratch(spark)}/sequential-{uuid.uuid4().hex}"
    for period in ("look < '1997-07-01'", "look >= '1997-07-01' and look < '1999-07-01'", "look >= '1999-07-01'"):
        rows.where(period).repartition("drug").write.mode("append").parquet(f"{folder}/rows")  # files come in the order of time
    tested = looks.run_available(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/rows"), "drug", folder)
    four = [F.round(c, 6).alias(c) for c in ("mu", "llr", "max_llr", "critical")]
    return tested.select("drug", F.to_date("look").alias("look"), "looks", "c", *four, F.to_date("first_crossing").alias("first_crossing"))


QUERIES = {f.__name__: f for f in (snk08_rebuilt, etl04_synced, etl07_phases, str06_totals, str09_looks)}

ORACLES = {
    "snk08_rebuilt": f"""with b as (select drug, event, count(*) as a, substring(drug,7,1) as project from ({BAG}) group by all), old as (select *, case when a%2=0 then 'reviewed' else 'new' end as state from b),
f as (select x.drug, x.event, count(*) as a, substring(x.drug,7,1) as project from ({BAG}) x join orders on o_orderkey=x.post where o_orderstatus='F' group by all having substring(x.drug,7,1)='1'),
z as (select project, state, a from old where project!='1' union all select f.project, case when old.state='reviewed' then 'reviewed' else 'new' end, f.a from f left join old on old.drug=f.drug and old.event=f.event) select project, state, count(*) as n, sum(a)::bigint as a from z group by all""",
    "etl04_synced": f"""with b as (select * from ({BAG}) join (select post, case when posted_at<'1998-01-01' then 1 else 2 end as sync from ({POSTS})) using (post)),
x as (select distinct post, sync, 'exposure' as kind, drug as name from b union all select distinct post, sync, 'condition', event from b) select sync, kind, name, count(*) as n from x group by all""",
    "etl07_phases": f"""with b as ({BAG}), base as (select distinct drug, event from b where post%2=0), z as (select 'vocabulary' as phase, count(*) as n from (select drug from b union select event from b) union all select 'baseline', count(*) from base union all select 'events', count(*) from b
union all select 'refresh', count(*) from (select distinct drug, event from b) x where not exists (select 1 from base y where y.drug=x.drug and y.event=x.event)) select phase, 'kept' as status, n from z""",
    "str06_totals": "select event_type, count(*) as n, count(*) filter (where value>=100) as large, count(*) filter (where hour(ts)<12) as morning from events group by 1",
    "str09_looks": f"""with b as (select drug, date_trunc('month',posted_at)::date as look, count(*) as n from ({BAG}) join ({POSTS}) using (post) group by all), s as (select drug, sum(n)::double/(select sum(n) from b) as share from b group by 1), e as (select look, sum(n) as al from b group by 1),
r as (select s.drug, e.look, coalesce(n,0) as n, al, share from e cross join s left join b on b.drug=s.drug and b.look=e.look), c as (select drug, look, row_number() over w as looks, (sum(n) over w)::bigint as c, sum(al*share*0.9::double) over w as mu from r window w as (partition by drug order by look)),
l as (select *, case when c>mu and mu>0 then c*ln(c/mu)-(c-mu) else 0 end as llr, {sql_critical('c')} as cv from c), t as (select *, max(llr) over (partition by drug order by look) as best from l),
u as (select *, min(case when cv>0 and best>=cv then look end) over (partition by drug order by look) as first_crossing from t) select drug, look, looks, c, round(mu,6) as mu, round(llr,6) as llr, round(best,6) as max_llr, round(cv,6) as critical, first_crossing from u""",
}

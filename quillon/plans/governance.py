"""Label, lifecycle, benefit-risk, coverage and gate queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import dma
from quillon.sources.tables import mentions, posts, table

from .signals import BAG, FINE_BAG, MONTH, MONTH_BAG, POSTS, sql_cells, sql_measures

#: Fixed moves between states of a signal's life.
MOVES = {
    "new": ["under_evaluation", "rejected"],
    "under_evaluation": ["validated", "rejected"],
    "validated": ["prioritized", "rejected"],
    "prioritized": ["assessed", "rejected"],
    "assessed": ["closed", "rejected"],
}


def len23_label_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Tier of each signal against what labels list: boxed before listed before novel (product known) before unknown."""
    rows = dma.pair_counts(mentions(spark, sf, fine=True))
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("event"), "n_nationkey")
    known = mentions(spark, sf, fine=True).where(F.substring("drug", -1, 1).isin("1", "2", "3")).select("drug").distinct()
    out = rows.join(nation, "event").join(known.withColumn("known", F.lit(True)), "drug", "left")
    tier = F.when(F.col("known") & (F.col("n_nationkey") % 6 == 0), "boxed").when(F.col("known") & (F.col("n_nationkey") % 3 == 0), "in_label").when(F.col("known"), "novel").otherwise("unknown")
    return out.select("drug", "event", "a", tier.alias("tier"))


def len26_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed changes of state, legal and not, by state: orders' old and new states from their key."""
    states = [*MOVES, "closed", "rejected"]
    name = F.array(*(F.lit(s) for s in states))
    rows = table(spark, sf, "orders").select(F.element_at(name, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("state"), F.element_at(name, (F.col("o_custkey") % 7 + 1).cast("int")).alias("wanted"))
    moves = spark.createDataFrame([(s, t, True) for s, to in MOVES.items() for t in to], "state string, wanted string, legal boolean")
    return rows.join(F.broadcast(moves), ["state", "wanted"], "left").groupBy("state").agg(F.count("*").alias("n"), F.count_if("legal").alias("n_legal"))


def agg16_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each dimension of a map of presences, over posts."""
    p = posts(spark, sf)
    there = F.create_map(*(x for n, c in (("ae", F.col("ae_flag")), ("urgent", F.col("severity") == "1-URGENT"), ("asia", F.col("region") == "ASIA")) for x in (F.lit(n), c.cast("double"))))
    return p.select(F.explode(there).alias("dimension", "x")).groupBy("dimension").agg(F.round(F.avg("x"), 4).alias("coverage"))


def agg24_worst_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The worst verdict of each product and system, and the events that have it."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    soc = mentions(spark, sf).select("event", "soc").distinct()
    rank = F.when(F.col("strength") == "STRONG", 1).when(F.col("strength") == "MODERATE", 2).otherwise(3)
    ranked = rows.join(soc, "event").withColumn("rank", rank)
    worst = ranked.groupBy("drug", "soc").agg(F.min("rank").alias("rank"))
    return ranked.join(worst, ["drug", "soc", "rank"]).groupBy("drug", "soc", "rank").agg(F.concat_ws(",", F.array_sort(F.collect_set("event"))).alias("events"))


def sta31_benefit_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Number needed to harm, hazard and benefit units, and the verdict of their ratio."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    risk = F.when(F.col("strength") == "STRONG", 0.02).when(F.col("strength") == "MODERATE", 0.005).otherwise(0.001) * (1 + F.least("a", F.lit(60)) / 30)
    rows = rows.select("drug", "event", "a", F.round(1 / F.greatest(F.lit(1e-4), F.least(F.lit(0.5), risk))).cast("long").alias("nnh"))
    benefit, harm = F.lit(0.8 / 40), 1.0 / F.col("nnh")
    score = F.round(100 * (benefit - harm), 4)
    verdict = F.when((benefit / harm >= 1.8) & (score > 0), "Favourable").when(benefit / harm >= 0.8, "Uncertain").otherwise("Unfavourable")
    return rows.select("drug", "event", "nnh", score.alias("score"), verdict.alias("verdict"))


def win12_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by year before a fixed day, and how far each year lies from the others' mean."""
    days = F.datediff(F.lit("2001-08-01").cast("date"), "posted_at")
    by = posts(spark, sf).groupBy(F.floor(days / 365).alias("years_ago")).agg(F.count("*").alias("n"), F.count_if("ae_flag").alias("n_ae"))
    rest = by.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return by.crossJoin(F.broadcast(rest)).select("years_ago", "n", "n_ae", F.round(F.col("n") - (F.col("t") - F.col("n")) / (F.col("k") - 1), 3).alias("beyond_rest"))


def joi07_supporting(spark: SparkSession, sf: str) -> DataFrame:
    """Posts that support a strong signal, each with how many it supports."""
    strong = dma.disproportionality(mentions(spark, sf, fine=True)).where("strength = 'STRONG'").select("drug", "event")
    return mentions(spark, sf, fine=True).join(strong, ["drug", "event"], "left_semi").groupBy("post").agg(F.count("*").alias("n"))


def joi22_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's figures from the first source that has any: month, else all time."""
    month, ever = dma.pair_counts(mentions(spark, sf, MONTH).withColumn("drug", F.substring("drug", 1, 8))), dma.pair_counts(mentions(spark, sf))
    rows = month.withColumn("priority", F.lit(1)).unionByName(ever.withColumn("priority", F.lit(2)))
    return rows.groupBy("drug", "event").agg(F.min_by("a", "priority").alias("a"), F.min("priority").alias("priority"))


def prd05_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Posts through the four gates in order: a product, an event, a bad outcome, not low in severity; where each stops."""
    bag = mentions(spark, sf).groupBy("post").agg(F.countDistinct("drug").alias("drugs"), F.countDistinct("event").alias("events"))
    p = posts(spark, sf).join(bag, "post", "left").fillna(0, ["drugs", "events"])
    gate = F.when(F.col("drugs") == 0, "no product").when(F.col("events") < 2, "one event").when(~F.col("ae_flag"), "not adverse").when(F.col("severity") == "5-LOW", "low").otherwise("passed")
    return p.groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


def str_session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users: events with gaps below six hours, how many and how long."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("n").agg(F.count("*").alias("sessions"))


def str_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events by type in windows of two hours every hour, the largest of each type."""
    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("event_type", F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return w.groupBy("event_type").agg(F.max("n").alias("most"), F.count("*").alias("windows"))


QUERIES = {f.__name__: f for f in (
    len23_label_gap, len26_lifecycle, agg16_coverage, agg24_worst_verdict, sta31_benefit_risk, win12_yearly, joi07_supporting, joi22_fallback, prd05_gates, str_session_windows, str_sliding_windows,
)}

_fine = f"with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}"
_STATES = "['new','under_evaluation','validated','prioritized','assessed','closed','rejected']"
ORACLES = {
    "len23_label_gap": f"""with m as (select drug, event, count(*) as a from ({FINE_BAG}) group by all), k as (select distinct drug from ({FINE_BAG}) where right(drug,1) in ('1','2','3'))
select m.drug, event, a, case when k.drug is not null and n_nationkey%6=0 then 'boxed' when k.drug is not null and n_nationkey%3=0 then 'in_label' when k.drug is not null then 'novel' else 'unknown' end as tier from m join nation on n_name=event left join k on k.drug=m.drug""",
    "len26_lifecycle": f"""with x as (select {_STATES}[o_orderkey%7+1] as state, {_STATES}[o_custkey%7+1] as wanted from orders)
select state, count(*) as n, count(*) filter (where (state in ('new','under_evaluation','validated','prioritized','assessed') and wanted='rejected') or (state,wanted) in (('new','under_evaluation'),('under_evaluation','validated'),('validated','prioritized'),('prioritized','assessed'),('assessed','closed'))) as n_legal from x group by 1""",
    "agg16_coverage": f"with p as ({POSTS}) select 'ae' as dimension, round(avg(ae_flag::int),4) as coverage from p union all select 'urgent', round(avg((severity='1-URGENT')::int),4) from p union all select 'asia', round(avg((region='ASIA')::int),4) from p",
    "agg24_worst_verdict": f"""{_fine}, s as (select distinct n_name as event, r_name as soc from nation join region on n_regionkey=r_regionkey), r as (select drug, soc, event, case strength when 'STRONG' then 1 when 'MODERATE' then 2 else 3 end as rank from m join s using (event)),
w as (select *, min(rank) over (partition by drug, soc) as least from r) select drug, soc, rank, string_agg(event, ',' order by event) as events from w where rank=least group by all""",
    "sta31_benefit_risk": f"""{_fine}, r as (select drug, event, round(1/greatest(1e-4::double, least(0.5::double, (case strength when 'STRONG' then 0.02::double when 'MODERATE' then 0.005::double else 0.001::double end)*(1+least(a,60)/30::double))))::bigint as nnh from m),
v as (select *, 0.8::double/40 as bu, 1::double/nnh as hu from r) select drug, event, nnh, round(100*(bu-hu),4) as score, case when bu/hu>=1.8::double and round(100*(bu-hu),4)>0 then 'Favourable' when bu/hu>=0.8::double then 'Uncertain' else 'Unfavourable' end as verdict from v""",
    "win12_yearly": f"with b as (select floor((date '2001-08-01'-posted_at)/365.0::double)::bigint as years_ago, count(*) as n, count(*) filter (where ae_flag) as n_ae from ({POSTS}) group by 1), t as (select sum(n)::double as t, count(*) as k from b) select years_ago, n, n_ae, round(n-(t-n)/(k-1),3) as beyond_rest from b, t",
    "joi07_supporting": f"{_fine} select post, count(*) as n from bag join m using (drug, event) where strength='STRONG' group by 1",
    "joi22_fallback": f"with x as (select drug, event, count(*) as a, 1 as priority from ({MONTH_BAG}) group by all union all select drug, event, count(*), 2 from ({BAG}) group by all) select drug, event, first(a order by priority) as a, min(priority) as priority from x group by all",
    "prd05_gates": f"""with b as (select post, count(distinct drug) as drugs, count(distinct event) as events from ({BAG}) group by 1), p as (select x.*, coalesce(drugs,0) as drugs, coalesce(events,0) as events from ({POSTS}) x left join b using (post))
select case when drugs=0 then 'no product' when events<2 then 'one event' when not ae_flag then 'not adverse' when severity='5-LOW' then 'low' else 'passed' end as gate, count(*) as n from p group by 1""",
    "str_session_windows": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as f from events), s as (select user_id, sum(f) over (partition by user_id order by ts range unbounded preceding) as k from g),
c as (select user_id, k, count(*) as n from s group by all) select n, count(*) as sessions from c group by 1""",
    "str_sliding_windows": """with w as (select event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events), c as (select event_type, start, count(*) as n from w group by all) select event_type, max(n) as most, count(*) as windows from c group by 1""",
}

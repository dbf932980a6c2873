"""Series, report, text and streaming queries and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from quillon.operators import reports, texts, trends
from quillon.sources.tables import mentions, posts, scratch, table
from quillon.streaming import alerts

from .signals import BAG, POSTS


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("day", F.to_date("ts"))


def win01_daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    return trends.trend(trends.daily(_events(spark, sf), "event_type", "day"), "event_type")


def sta18_maxsprt(spark: SparkSession, sf: str) -> DataFrame:
    return trends.sequential_test(trends.daily(_events(spark, sf), "event_type", "day"), "event_type")


def agg13_control_chart(spark: SparkSession, sf: str) -> DataFrame:
    return trends.control_chart(_events(spark, sf), "day")


def len17_divergence(spark: SparkSession, sf: str) -> DataFrame:
    weekly = posts(spark, sf).groupBy(F.trunc("posted_at", "week").alias("week"), "ae_flag").agg(F.count("*").alias("n"))
    return trends.divergence(weekly.where("ae_flag"), weekly.where("not ae_flag"), "week")


def len29_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    weekly = _events(spark, sf).groupBy("event_type", F.trunc("day", "week").alias("week")).agg(F.count("*").alias("n"))
    return trends.trajectory(weekly, "event_type")


def agg04_headline(spark: SparkSession, sf: str) -> DataFrame:
    return reports.headline(posts(spark, sf))


def agg05_marginals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.marginals(posts(spark, sf))


def agg09_overview(spark: SparkSession, sf: str) -> DataFrame:
    return reports.overview(posts(spark, sf))


def agg11_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return reports.percentiles(_events(spark, sf), "event_type", "value")


def agg15_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.histogram(table(spark, sf, "lineitem"), F.col("l_discount") * 10)


def agg14_source_yield(spark: SparkSession, sf: str) -> DataFrame:
    host = F.parse_url("url", F.lit("HOST"))
    pages = table(spark, sf, "pages").withColumn("source", F.element_at(F.split(host, r"\."), -1))
    return pages.groupBy("source").agg(F.count("*").alias("n_pages"), F.countDistinct(host).alias("n_hosts"))


def agg26_author_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return reports.author_entropy(posts(spark, sf), "country", "author")


def agg28_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    symbols = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|]", ""))
    return reports.confusion(rows, F.col("quality") == 0, symbols * 50 > F.length("text"))


def top02_page(spark: SparkSession, sf: str) -> DataFrame:
    return reports.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10, 20)


def top04_triage(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf).where("ae_flag")
    return reports.page(rows.select("post", "severity", "country"), ["severity", "post"], 0, 12)


def sta34_completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    present = {"country": F.col("c_nationkey").isNotNull(), "patient": F.col("c_acctbal") > 0, "outcome": F.col("o_orderstatus") != "P", "dose": F.col("o_totalprice") > 100000, "indication": F.col("o_orderpriority") != "4-NOT SPECIFIED"}
    return rows.groupBy(reports.completeness(rows, present).alias("score")).agg(F.count("*").alias("n"))


def joi08_unreported(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def joi18_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("entry"))
    terms = nations.select(F.concat(F.substring("entry", 1, 3), F.substring("entry", 5, 40)).alias("term"))
    return texts.fuzzy(terms, nations)


def win15_content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return texts.first_by_hash(table(spark, sf, "documents"))


def sca_scrub(spark: SparkSession, sf: str) -> DataFrame:
    clean = texts.scrub(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(clean).alias("digest"), (F.col("text") != clean).alias("changed"))


def sca_strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(texts.strip_markup(F.col("html"))).alias("digest"))


def joi_shared_grams(spark: SparkSession, sf: str) -> DataFrame:
    return texts.shared_grams(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def sca_json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


def thread_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conv"), F.max("turn").alias("last_turn"))


def str01_stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, to the end of what is there."""
    folder = scratch(spark)
    rows = table(spark, sf, "events")
    reader = spark.readStream.schema(rows.schema)
    if rows.inputFiles()[0].endswith("/events.parquet"):  # one file: its folder is the stream's source
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        events = reader.parquet(f"{sf}/events.parquet")
    done = alerts.run_available(spark, events, folder)
    return done.groupBy(F.to_date("start").alias("day"), "event_type").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (
    win01_daily_trend, sta18_maxsprt, agg13_control_chart, len17_divergence, len29_trajectory, agg04_headline, agg05_marginals, agg09_overview, agg11_percentiles, agg15_histogram, agg14_source_yield,
    agg26_author_entropy, agg28_evaluation, top02_page, top04_triage, sta34_completeness, joi08_unreported, joi18_fuzzy, win15_content_dedupe, sca_scrub, sca_strip_markup, joi_shared_grams, sca_json_props,
    thread_turns, str01_stream_alerts,
)}

_SERIES = """d as (select event_type, cast(ts as date) as day, count(*) as n from events group by all), lim as (select event_type, min(day) as lo, max(day) as hi from d group by 1),
sp as (select event_type, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as day from lim), s as (select event_type, day, coalesce(n,0) as n from sp left join d using (event_type, day)),
r as (select *, row_number() over (partition by event_type order by day)-1 as i, count(*) over (partition by event_type) as days from s)"""
_FOLD = "list_reduce({0}, lambda x, y: 0.4::double*y+0.6::double*x)"
def sql_critical(n: str) -> str:
    """trends.critical_value in SQL."""
    steps = " ".join(f"when {n} <= {x1} then {y0}::double+({y1}::double-{y0}::double)*({n}-{x0})/({x1}-{x0})" for (x0, y0), (x1, y1) in zip(trends.CRITICAL, trends.CRITICAL[1:]))
    x, y = trends.CRITICAL[-1]
    return f"case when {n} <= 1 then 0 {steps} else {y}::double+{trends.TAIL}::double*ln({n}/{x}::double) end"


_cv = sql_critical("total")
_GRAM = "list_transform(generate_series(1, len(w)-7), lambda i: array_to_string(w[i:i+7], ' '))"


def _grams(source: str, key: str) -> str:
    return f"(select {key}, unnest(list_distinct({_GRAM})) as gram from (select {key}, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as w from {source}) where len(w) >= 8)"


ORACLES = {
    "win01_daily_trend": f"""with {_SERIES}, g as (select event_type, count(*) as days, regr_slope(n, i) as slope, avg(n) as mean, avg(n) filter (where i < days-1) as m, stddev_pop(n) filter (where i < days-1) as sd, max_by(n, day) as last, list(n::double order by day) as v from r group by 1),
q as (select event_type, days, round(coalesce(slope/(case when mean=0 then 1 else mean end),0),3) as trend_score, round({_FOLD.format('v')},3) as ewma, round({_FOLD.format('v[1:greatest(len(v)-1,1)]')},3) as expected, last, round((last-m)/greatest(sd, sqrt(m), 1::double),3) as z from g)
select *, days>=4 and z>=2 and last>=greatest(3::double, expected+2) as spike from q""",
    "sta18_maxsprt": f"""with {_SERIES}, c as (select *, (sum(n) over (partition by event_type order by day))::bigint as c, (sum(n) over (partition by event_type))::bigint as total, i+1 as look from r),
l as (select *, {_cv} as cv, total*0.8::double/days*look as mu from c), m as (select *, case when c>mu and mu>0 then c*ln(c/mu)-(c-mu) else 0 end as llr from l)
select event_type, max(total) as total, round(max(llr),3) as max_llr, round(max(cv),3) as critical, min(case when llr>=cv and cv>0 then look end)::int as first_crossing from m group by 1""",
    "agg13_control_chart": """with d as (select cast(ts as date) as day, count(*) as n from events group by 1), l as (select avg(n) as m, stddev_pop(n) as s from d)
select day, n, round(m+3*s,3) as ucl, round(greatest(0::double,m-3*s),3) as lcl, n>m+3*s or n<greatest(0::double,m-3*s) as breach from d, l""",
    "len17_divergence": f"""with w as (select date_trunc('week', posted_at)::date as week, ae_flag, count(*) as n from ({POSTS}) group by all),
b as (select week, coalesce(x.n,0) as x, coalesce(y.n,0) as y from (select week, n from w where ae_flag) x full join (select week, n from w where not ae_flag) y using (week)),
r as (select *, row_number() over (order by week)-1 as i, count(*) over () as weeks from b),
g as (select count(*) as weeks, max_by(x, week) as last, avg(x) filter (where i<weeks-1) as m, stddev_pop(x) filter (where i<weeks-1) as s, regr_slope(x,i) as slope, avg(y) filter (where i>=weeks-4) as tail, avg(y) as mean_y from r)
select weeks, last, round(case when s>0 then (last-m)/s else 0 end,3) as z, round(slope,4) as slope, round(tail/mean_y,3) as tail_ratio from g""",
    "len29_trajectory": """with w as (select event_type, date_trunc('week', ts)::date as week, count(*) as n from events group by all), l as (select *, lag(n) over (partition by event_type order by week) as before from w)
select *, case when before is null then 'new' when n>1.15::double*before then 'strengthening' when n<0.85::double*before then 'weakening' else 'stable' end as trajectory from l""",
    "agg04_headline": f"select count(*) as n_posts, count(*) filter (where ae_flag) as n_ae, count(*) filter (where severity in ('1-URGENT','2-HIGH')) as n_urgent, count(distinct author) as n_authors, round(count(*) filter (where ae_flag)::double/count(*),4) as ae_rate from ({POSTS})",
    "agg05_marginals": f"""with p as ({POSTS}) select 'region' as level, region as label, count(*) as n, count(*) filter (where ae_flag) as n_ae from p group by 2 union all select 'country', country, count(*), count(*) filter (where ae_flag) from p group by 2
union all select 'severity', severity, count(*), count(*) filter (where ae_flag) from p group by 2 union all select 'all', 'all', count(*), count(*) filter (where ae_flag) from p""",
    "agg09_overview": f"""with d as (select posted_at as day, count(*) as n, count(*) filter (where ae_flag) as n_ae from ({POSTS}) group by 1), k as (select count(*) as days from d)
select (case when days>156 then date_trunc('month',day) when days>90 then date_trunc('week',day) else day end)::date as start, case when days>156 then 'month' when days>90 then 'week' else 'day' end as grain, sum(n)::bigint as n, sum(n_ae)::bigint as n_ae from d, k group by 1, 2""",
    "agg11_percentiles": "select event_type, count(*) as n, round(quantile_cont(value,0.5),2) as p50, round(quantile_cont(value,0.9),2) as p90, round(quantile_cont(value,0.95),2) as p95 from events group by 1",
    "agg15_histogram": "with b as (select least(9, floor(l_discount*10*10))::int as band, count(*) as n from lineitem group by 1) select i::int as band, coalesce(n,0) as n from range(10) t(i) left join b on b.band=i",
    "agg14_source_yield": "with p as (select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages) select regexp_extract(host, '([^.]+)$', 1) as source, count(*) as n_pages, count(distinct host) as n_hosts from p group by 1",
    "agg26_author_entropy": f"""with n as (select country, author, count(*) as n from ({POSTS}) group by all), t as (select *, sum(n) over (partition by country) as total from n)
select country, max(total)::bigint as n_posts, round(case when max(total)>1 then -sum(n::double/total*log2(n::double/total))/log2(max(total)) else 0 end,4) as entropy from t group by 1""",
    "agg28_evaluation": """with x as (select quality=0 as t, (length(text)-length(regexp_replace(text,'[#*$%&|]','','g')))*50>length(text) as g from documents join labels using (doc_id)),
c as (select count(*) filter (where t and g) as tp, count(*) filter (where not t and g) as fp, count(*) filter (where t and not g) as fn from x)
select tp, fp, fn, round(tp::double/(tp+fp),4) as precision, round(tp::double/(tp+fn),4) as recall, round(2*(tp::double/(tp+fp))*(tp::double/(tp+fn))/((tp::double/(tp+fp))+(tp::double/(tp+fn))),4) as f1 from c""",
    "top02_page": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10",
    "top04_triage": f"select post, severity, country from ({POSTS}) where ae_flag order by severity, post limit 12",
    "sta34_completeness": """select round((case when c_nationkey is not null then 1 else 0.9::double end)*(case when c_acctbal>0 then 1 else 0.9::double end)*(case when o_orderstatus!='P' then 1 else 0.8::double end)*(case when o_totalprice>100000 then 1 else 0.9::double end)*(case when o_orderpriority!='4-NOT SPECIFIED' then 1 else 0.85::double end),3) as score, count(*) as n
from orders left join customer on o_custkey=c_custkey group by 1""",
    "joi08_unreported": "select o_orderstatus, count(*) as n from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey) group by 1",
    "joi18_fuzzy": """with t as (select n_name as entry, substring(n_name,1,3)||substring(n_name,5,40) as term from nation), p as (select distinct t.term, n.entry, levenshtein(upper(t.term),upper(n.entry)) as distance from t join t n on upper(t.term[1])=upper(n.entry[1]))
select term, entry, distance::int as distance from p where distance<=3 qualify row_number() over (partition by term order by distance, entry)=1""",
    "win15_content_dedupe": "with h as (select doc_id, md5(upper(regexp_replace(coalesce(text,''),'[^A-Za-z0-9]','','g'))) as h from documents) select doc_id, min(doc_id) over (partition by h) as first_id, doc_id=min(doc_id) over (partition by h) as kept from h",
    "sca_scrub": rf"with c as (select doc_id, text, regexp_replace(regexp_replace(text,'{texts.EMAIL}','[EMAIL]','g'),'{texts.IPV4}','[IP]','g') as clean from documents) select doc_id, md5(clean) as digest, text!=clean as changed from c",
    "sca_strip_markup": r"select page_id, md5(trim(regexp_replace(regexp_replace(html,'<[^>]+>',' ','g'),'[ \t\r\n]+',' ','g'))) as digest from pages",
    "joi_shared_grams": f"select doc_id, item_id, count(*) as n from {_grams('documents', 'doc_id')} join {_grams('benchmark', 'item_id')} using (gram) group by all",
    "sca_json_props": "select event_type, sum((props->>'$.k')::bigint)::bigint as k, count(*) as n from events group by 1",
    "thread_turns": "select role, count(*) as n, count(distinct conv_id) as n_conv, max(turn) as last_turn from conversations group by 1",
    "str01_stream_alerts": "with d as (select distinct user_id, event_type, date_trunc('hour', ts) as h from events) select h::date as day, event_type, count(*) as n from d group by all",
}

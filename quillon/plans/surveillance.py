"""Queries of gates, rebuilds, syncs, feeds and look-ups of signals, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.operators import dma, lenses, reports, scores, sinks, trends
from quillon.sources import feeds
from quillon.sources.tables import mentions, posts, scratch, table
from quillon.streaming import dedupe

from .signals import BAG, FINE_BAG, POSTS, SDR_PRR, sql_cells, sql_measures
from .signals import ORACLES as SIGNALS


def agg06_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language; short ones count as of an unknown one."""
    lang = F.when(F.length("text") >= 100, F.col("lang"))
    return table(spark, sf, "documents").groupBy(F.coalesce(lang, F.lit("Unknown")).alias("label")).agg(F.count("*").alias("n"))


def agg30_dominant(spark: SparkSession, sf: str) -> DataFrame:
    """The class with most signals above the weakest tier, the least name among equals."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True)).where("strength != 'WEAK'").groupBy(F.substring("drug", 1, 7).alias("class")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "class").limit(1)


def win10_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of weekly counts, z of the last week against all before, and the last four weeks' mean over the mean."""
    e = table(spark, sf, "events").groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    e = e.withColumn("i", F.row_number().over(w.orderBy("week"))).withColumn("weeks", F.count("*").over(w))
    by = e.groupBy("event_type").agg(
        F.max("weeks").alias("weeks"), F.regr_slope("n", "i").alias("slope"), F.max_by("n", "i").alias("last"), F.avg(F.when(F.col("i") < F.col("weeks"), F.col("n"))).alias("m"),
        F.stddev_pop(F.when(F.col("i") < F.col("weeks"), F.col("n"))).alias("s"), F.avg(F.when(F.col("i") > F.col("weeks") - 4, F.col("n"))).alias("tail"), F.avg("n").alias("mean"),
    )
    z = F.when((F.col("weeks") >= 4) & (F.col("s") > 0), F.round((F.col("last") - F.col("m")) / F.col("s"), 3))
    return by.select("event_type", "weeks", F.when(F.col("weeks") >= 4, F.round("slope", 4)).alias("slope"), z.alias("z"), F.round(F.col("tail") / F.col("mean"), 4).alias("tail_ratio"))


def set03_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics without the rows of excluded products; their posts stay."""
    return dma.disproportionality(mentions(spark, sf).where(~F.lower("drug").isin("brand#11", "brand#3"))).select("drug", "event", "a", "b", "c", "d", "prr")


def prd16_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Signals that pass the gates of a product: stricter ones within 24 months of its first report or in a media peak
    (the last seven days hold four times the seven before)."""
    m = mentions(spark, sf, fine=True).join(posts(spark, sf).select("post", "posted_at"), "post")
    m = m.crossJoin(F.broadcast(m.agg(F.max("posted_at").alias("as_of")))).withColumn("ago", F.datediff("as_of", "posted_at"))
    gate = m.groupBy("drug").agg(F.min("posted_at").alias("launch"), F.max("as_of").alias("as_of"), F.count_if(F.expr("ago < 7")).alias("last"), F.count_if(F.expr("ago >= 7 and ago < 14")).alias("before"))
    strict = (F.add_months("launch", 24) >= F.col("as_of")) | (F.col("last") >= 4 * F.greatest(F.col("before"), F.lit(1)))
    gate = gate.select("drug", strict.alias("strict"))
    rows = dma.disproportionality(m.select("post", "drug", "event")).join(gate, "drug")
    passed = (F.col("prr") >= F.when(F.col("strict"), 3).otherwise(2)) & (F.col("chi_square") >= F.when(F.col("strict"), 6).otherwise(4))
    return rows.groupBy("strict").agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.countDistinct("drug").alias("drugs"))


def prd18_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by bucket of their region's name; whole words alone are compared."""
    r = F.lower("region")
    bucket = F.when(r.rlike(r"\b(america|us|canada)\b"), "Americas").when(r.rlike(r"\b(europe|uk)\b"), "Europe").when(r.rlike(r"\b(asia|japan|india)\b"), "Asia").otherwise("Other")
    return posts(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def prd07_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    """Symptoms of each customer's orders, one of each by the first name it has (normalised, preferred, as written)."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.upper("o_orderpriority")).alias("normalized"), F.when(F.col("o_orderkey") % 3 == 1, F.lower("o_orderpriority")).alias("pt"), F.col("o_orderpriority").alias("text"))
    key = F.lower(F.coalesce("normalized", "pt", "text"))
    return o.groupBy("o_custkey").agg(F.size(F.collect_set(key)).cast("long").alias("n_symptoms"), F.count("*").alias("n"))


def joi03_known(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures and conditions of a person, concepts 0 and unknown ones left out, by pairs of distinct persons."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    concept = lambda c, n: F.when(F.col(c) % n != 1, F.col(c) % n)
    exposed = rows.select(F.col("o_custkey").alias("person"), concept("l_partkey", 9).alias("drug")).where("coalesce(drug, 0) != 0").distinct()
    ill = rows.select(F.col("o_custkey").alias("person"), concept("l_suppkey", 11).alias("event")).where("coalesce(event, 0) != 0").distinct()
    return exposed.join(ill, "person").groupBy("drug", "event").agg(F.count("*").alias("persons"))


def joi09_comparators(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged posts of a pair and all other flagged posts, by counts instead of a set difference for each pair."""
    flagged = posts(spark, sf).where("ae_flag").select("post")
    m = mentions(spark, sf).join(flagged, "post", "left_semi")
    by = m.groupBy("drug", "event").agg(F.count("*").alias("own"))
    return by.crossJoin(F.broadcast(flagged.agg(F.count("*").alias("every")))).select("drug", "event", "own", (F.col("every") - F.col("own")).alias("comparators"))


def joi10_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the first signal of their product and event or organ system; events come before systems."""
    m = mentions(spark, sf)
    signals = m.groupBy("drug", "event", "soc").agg(F.min("post").alias("id"))
    index = signals.select("drug", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lower("event").alias("name")), F.struct(F.lit(1).alias("rank"), F.lower("soc").alias("name")))).alias("k"), "id").select("drug", "k.*", "id")
    first = index.groupBy("drug", "name").agg(F.min_by("id", F.struct("rank", "id")).alias("signal"))
    asked = m.join(posts(spark, sf).select("post", "country", "region"), "post").select("drug", F.explode(F.array(F.lower("country"), F.lower("region"), F.lit("nowhere"))).alias("name")).distinct()
    return asked.join(first, ["drug", "name"], "left")


def gra07_best_metric(spark: SparkSession, sf: str) -> DataFrame:
    """The largest PRR of each class and event, and the product that has it, the last name among equals."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    best = rows.groupBy(F.substring("drug", 1, 7).alias("class"), "event").agg(F.max_by(F.struct("prr", "drug"), F.struct("prr", "drug")).alias("b"))
    return best.select("class", "event", "b.prr", "b.drug")


def gra08_enriched_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from products to proteins that a table of associations holds with a confidence of 0.7 or more."""
    p = table(spark, sf, "part")
    known = table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("drug"), F.concat(F.lit("P"), F.col("s_nationkey")).alias("protein"), F.round(F.col("s_suppkey") % 10 / 10.0, 1).alias("confidence"))
    known = known.groupBy("drug", "protein").agg(F.max("confidence").alias("confidence")).where("confidence >= 0.7")
    return p.select(F.col("p_brand").alias("drug")).distinct().join(known, "drug")


def sta25_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The excess of each stratum over its cohort, shared among its factors by how far each elevates the risk alone."""
    p = posts(spark, sf).withColumn("urgent", F.col("severity") == "1-URGENT").withColumn("even", F.col("author") % 2 == 0)
    total = p.agg(F.count_if("ae_flag").alias("ca"), F.count("*").alias("cn"))
    out = p.groupBy("country", "urgent", "even").agg(F.count_if("ae_flag").alias("a"), F.count("*").alias("n")).crossJoin(F.broadcast(total))
    out = out.withColumn("rem", scores.rem(F.col("a"), F.col("n"), F.col("ca"), F.col("cn")))
    factors = ["country", "urgent", "even"]
    for f in factors:
        own = p.groupBy(f).agg(F.count_if("ae_flag").alias("fa"), F.count("*").alias("fn"))
        own = own.crossJoin(F.broadcast(total)).select(f, F.greatest(scores.rem(F.col("fa"), F.col("fn"), F.col("ca"), F.col("cn")) - 1, F.lit(0.05)).alias(f"w_{f}"))
        out = out.join(own, f)
    weight = sum((F.col(f"w_{f}") for f in factors), F.lit(0.0))
    return out.select("country", "urgent", "even", "rem", *(F.round(F.col(f"w_{f}") / weight * (F.col("rem") - 1), 6).alias(f"by_{f}") for f in factors))


def sup03_annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Supporting posts of the strongest pairs by tier and confidence: the first three of each."""
    p = posts(spark, sf).select("post", F.substring("severity", 1, 1).cast("int").alias("tier"), F.round(F.col("author") % 100 / 100.0, 2).alias("confidence"))
    return dma.ranked(mentions(spark, sf).join(p, "post"), ["drug", "event"], ["tier", F.desc("confidence"), "post"], 3).select("drug", "event", "post", "tier", "confidence", "rank")


def sup24_top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dma.pair_counts(mentions(spark, sf)).orderBy(F.desc("a"), "drug", "event").limit(25)


def len06_lab_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the unmasking lab: one search word, one facet, sorted by outcome, tier and size."""
    rows = lenses.remine(mentions(spark, sf)).where(F.lower("drug").contains("brand#1") & (F.col("tier") == "evaluable"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in (("unmasked", 5), ("co_reported", 4), ("vanished", 3), ("amplified", 2), ("attenuated", 1), ("stable", 0)) for x in kv)), F.col("outcome"))
    return reports.page(rows.select("drug", "event", "excluded", "n_before", "outcome", "tier", rank.alias("rank")), [F.desc("rank"), F.desc("n_before"), "drug", "event"], 10, 20)


def etl05_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts seeded from all catalogues, the first domain that has a name winning, with stable ids."""
    p, n, r = table(spark, sf, "part"), table(spark, sf, "nation"), table(spark, sf, "region")
    parts = [(1, "Drug", p.select("p_brand")), (2, "Ingredient", p.select("p_name")), (3, "Condition", n.select("n_name")), (4, "Place", r.select("r_name")), (5, "Place", n.select("n_name"))]
    rows = None
    for rank, domain, df in parts:
        one = df.toDF("name").distinct().select(F.lit(rank).alias("rank"), F.lit(domain).alias("domain"), "name")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(F.lower("name").alias("name")).agg(F.min_by("domain", "rank").alias("domain"))
    return first.select("name", "domain", sinks.surrogate_key(F.concat_ws("|", "domain", "name")).alias("concept_id"))


def str04_content(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream: of equal contents within 30 days the first stays."""
    rows = table(spark, sf, "events")
    reader = spark.readStream.schema(rows.schema)
    one = rows.inputFiles()[0].endswith("/events.parquet")
    events = reader.option("pathGlobFilter", "events.parquet").parquet(sf) if one else reader.parquet(f"{sf}/events.parquet")
    out = dedupe.run_available(events, f"{scratch(spark)}/content-{uuid.uuid4().hex}", "ts", ["user_id", "event_type"], "30 days")
    return out.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


def sca27_calibrated_p(spark: SparkSession, sf: str) -> DataFrame:
    """One-sided p of each calibrated z, from the normal tail."""
    rows = lenses.calibrated(dma.disproportionality(mentions(spark, sf)), F.col("drug").isin("Brand#11", "Brand#12"))
    return rows.select("drug", "event", "z", F.round(special.normal_tail(F.col("z")), 4).alias("p"))


def sta40_severity(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    category = F.when(F.col("author") % 4 == 0, "Certain").when(F.col("author") % 4 == 1, "Probable").otherwise("Possible")
    return p.groupBy(scores.severity(F.col("severity").isin("1-URGENT", "2-HIGH"), category).alias("grade")).agg(F.count("*").alias("n"))


def sta47_label_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    value = scores.label_change((F.col("prr_low") >= 1) & (F.col("chi_square") >= 4) & (F.col("a") >= 3), F.length("event") == 8, F.col("ic025") > 0, F.col("a"), F.col("prr"))
    return rows.groupBy(value.alias("likelihood")).agg(F.count("*").alias("n"))


def src04_json(spark: SparkSession, sf: str) -> DataFrame:
    """Posts written as report files, wrapped and plain, and read back."""
    out = f"{scratch(spark)}/reports-{uuid.uuid4().hex}"
    rows = mentions(spark, sf).groupBy("post").agg(F.sort_array(F.collect_set("drug")).alias("drugs"), F.sort_array(F.collect_set("event")).alias("reactions"))
    rows.select(F.col("post").cast("string").alias("external_id"), "drugs", "reactions").write.json(out)
    read = spark.read.schema(feeds.REPORT).json(out)  # a report a line; the reader of whole files is tested apart
    return read.select("external_id", F.explode("drugs").alias("drug")).groupBy(F.lower("drug").alias("drug")).agg(F.countDistinct("external_id").alias("reports"))


def src06_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary written with bars and a header in capitals; the reader finds both out, and keeps two vocabularies."""
    out = f"{scratch(spark)}/vocabulary-{uuid.uuid4().hex}"
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("CONCEPT_ID"), F.col("p_name").alias("CONCEPT_NAME"), F.col("p_type").alias("VOCABULARY_ID"))
    p.write.option("header", True).option("sep", "|").csv(out)
    read = feeds.delimited(spark, out, ["SMALL", "ECONOMY"])
    return read.groupBy("vocabulary_id").agg(F.count("*").alias("n"), F.countDistinct("concept_name").alias("names"))


def src07_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A label table of seven columns, preferred terms and others, written and read back."""
    out = f"{scratch(spark)}/labels-{uuid.uuid4().hex}"
    m = mentions(spark, sf).select(F.col("post").cast("string"), "drug", "event").withColumn("kind", F.when(F.col("post").cast("long") % 2 == 0, "PT").otherwise("LLT"))
    m.select("post", F.lit("s"), F.lit("l"), "kind", F.lit("c"), "event", "drug").write.option("sep", "\t").csv(out)
    return feeds.label_pairs(spark, out)


def src25_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of two sections about each customer, split again."""
    c = table(spark, sf, "customer")
    note = F.concat(F.lit("History:\n "), F.col("c_mktsegment"), F.lit("\nPlan: see "), F.col("c_name"), F.lit(" again\n"))
    rows = c.select(F.explode(feeds.sections(note, ["history", "plan"])).alias("s")).select("s.name", "s.body")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("body").alias("bodies"))


QUERIES = {f.__name__: f for f in (
    agg06_labels, agg30_dominant, win10_slopes, set03_rows, prd16_gates, prd18_regions, prd07_symptoms, joi03_known, joi09_comparators, joi10_enriched, gra07_best_metric, gra08_enriched_edges, sta25_attribution,
    sup03_annotated, sup24_top_pairs, len06_lab_page, etl05_seeded, str04_content, sca27_calibrated_p, sta40_severity, sta47_label_change, src04_json, src06_delimited,
    src07_pairs, src25_sections,
)}

_fine = f"with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}"
_rem = lambda a, n: f"round((({a}+0.5::double)/({n}+1))/((ca+0.5::double)/(cn+1)),3)"
_weight = lambda f: f"(select {f}, greatest({_rem('count(*) filter (where ae_flag)', 'count(*)').replace('ca', 'max(ca)').replace('cn', 'max(cn)')}-1, 0.05::double) as w_{f} from p, tot group by {f})"
ORACLES = {
    "agg06_labels": "select case when length(text)>=100 then coalesce(lang,'Unknown') else 'Unknown' end as label, count(*) as n from documents group by 1",
    "agg30_dominant": f"{_fine} select substring(drug,1,7) as class, count(*) as n from m where strength!='WEAK' group by 1 order by n desc, class limit 1",
    "win10_slopes": """with e as (select event_type, date_trunc('week',ts)::date as week, count(*) as n from events group by all), r as (select *, row_number() over (partition by event_type order by week) as i, count(*) over (partition by event_type) as weeks from e),
b as (select event_type, max(weeks) as weeks, regr_slope(n,i) as slope, max_by(n,i) as last, avg(n) filter (where i<weeks) as m, stddev_pop(n) filter (where i<weeks) as s, avg(n) filter (where i>weeks-4) as tail, avg(n) as mean from r group by 1)
select event_type, weeks, case when weeks>=4 then round(slope,4) end as slope, case when weeks>=4 and s>0 then round((last-m)/s,3) end as z, round(tail/mean,4) as tail_ratio from b""",
    "set03_rows": f"with bag as (select * from ({BAG}) where lower(drug) not in ('brand#11','brand#3')), {sql_cells('bag')}, {sql_measures('cells', 'm')} select drug, event, a, b, c, d, prr from m",
    "prd16_gates": f"""{_fine}, d as (select drug, posted_at, (max(posted_at) over ()) as as_of from bag join ({POSTS}) using (post)), g as (select drug, min(posted_at) + interval 24 month >= max(as_of) or count(*) filter (where as_of-posted_at<7) >= 4*greatest(count(*) filter (where as_of-posted_at>=7 and as_of-posted_at<14),1) as strict from d group by 1)
select strict, count(*) as n, count(*) filter (where prr >= case when strict then 3 else 2 end and chi_square >= case when strict then 6 else 4 end) as passed, count(distinct drug) as drugs from m join g using (drug) group by 1""",
    "prd18_regions": f"select case when region='AMERICA' then 'Americas' when region='EUROPE' then 'Europe' when region='ASIA' then 'Asia' else 'Other' end as bucket, count(*) as n from ({POSTS}) group by 1",
    "prd07_symptoms": "select o_custkey, count(distinct lower(o_orderpriority)) as n_symptoms, count(*) as n from orders group by 1",
    "joi03_known": """with r as (select o_custkey as person, l_partkey%9 as d, l_suppkey%11 as e from lineitem join orders on l_orderkey=o_orderkey), x as (select distinct person, d as drug from r where d not in (0,1)), y as (select distinct person, e as event from r where e not in (0,1))
select drug, event, count(*) as persons from x join y using (person) group by all""",
    "joi09_comparators": f"with f as (select post from ({POSTS}) where ae_flag), b as (select drug, event, count(*) as own from ({BAG}) semi join f using (post) group by all) select drug, event, own, (select count(*) from f)-own as comparators from b",
    "joi10_enriched": f"""with s as (select drug, event, soc, min(post) as id from ({BAG}) group by all), i as (select drug, 0 as rank, lower(event) as name, id from s union all select drug, 1, lower(soc), id from s),
f as (select drug, name, id as signal from i qualify row_number() over (partition by drug, name order by rank, id)=1), a as (select distinct drug, unnest([lower(country), lower(region), 'nowhere']) as name from ({BAG}) join ({POSTS}) using (post)) select a.drug, a.name, signal from a left join f on f.drug=a.drug and f.name=a.name""",
    "gra07_best_metric": f"{_fine} select substring(drug,1,7) as class, event, prr, drug from m qualify row_number() over (partition by substring(drug,1,7), event order by prr desc, drug desc)=1",
    "gra08_enriched_edges": "with k as (select 'Brand#'||(s_suppkey%25+1) as drug, 'P'||s_nationkey as protein, max(round(s_suppkey%10/10.0::double,1)) as confidence from supplier group by all having max(round(s_suppkey%10/10.0::double,1))>=0.7) select drug, protein, confidence from (select distinct p_brand as drug from part) join k using (drug)",
    "sta25_attribution": f"""with p as (select *, severity='1-URGENT' as urgent, author%2=0 as even from ({POSTS})), tot as (select count(*) filter (where ae_flag) as ca, count(*) as cn from p),
s as (select country, urgent, even, {_rem('count(*) filter (where ae_flag)', 'count(*)').replace('ca', 'max(ca)').replace('cn', 'max(cn)')} as rem from p, tot group by 1,2,3), w as (select * from s join {_weight('country')} using (country) join {_weight('urgent')} using (urgent) join {_weight('even')} using (even))
select country, urgent, even, rem, """ + ", ".join(f"round(w_{f}/(w_country+w_urgent+w_even)*(rem-1),6) as by_{f}" for f in ("country", "urgent", "even")) + " from w",
    "sup03_annotated": f"with p as (select post, severity[1]::int as tier, round(author%100/100.0::double,2) as confidence from ({POSTS})), r as (select drug, event, post, tier, confidence, row_number() over (partition by drug, event order by tier, confidence desc, post) as rank from ({BAG}) join p using (post)) select * from r where rank<=3",
    "sup24_top_pairs": f"select drug, event, count(*) as a from ({BAG}) group by all order by a desc, drug, event limit 25",
    "len06_lab_page": f"""with r as ({SIGNALS['len05_remine']}), q as (select *, case outcome when 'unmasked' then 5 when 'co_reported' then 4 when 'vanished' then 3 when 'amplified' then 2 when 'attenuated' then 1 else 0 end as rank from r where contains(lower(drug),'brand#1') and tier='evaluable')
select drug, event, excluded, n_before, outcome, tier, rank from q order by rank desc, n_before desc, drug, event limit 20 offset 10""",
    "etl05_seeded": """with x as (select 1 as rank, 'Drug' as domain, p_brand as name from part union select 2, 'Ingredient', p_name from part union select 3, 'Condition', n_name from nation union select 4, 'Place', r_name from region union select 5, 'Place', n_name from nation),
f as (select lower(name) as name, domain from x qualify row_number() over (partition by lower(name) order by rank)=1) select name, domain, (('0x'||substring(sha256(domain||'|'||name),1,16))::ubigint & 9223372036854775807::ubigint)::bigint as concept_id from f""",
    "str04_content": "select event_type, count(distinct user_id) as users from events group by 1",
    "sta40_severity": f"with x as (select severity in ('1-URGENT','2-HIGH') as crit, author%4 in (0,1) as sure from ({POSTS})) select case when crit and sure then 'Critical' when crit then 'High' when sure then 'Medium' else 'Low' end as grade, count(*) as n from x group by 1",
    "sta47_label_change": f"{_fine}, x as (select round(least(0.95::double, case when {SDR_PRR} then 0.25::double else 0 end+case when length(event)=8 then 0.3::double else 0 end+case when ic025>0 then 0.25::double else 0 end+case when a>=5 then 0.1::double else 0 end+case when prr>=2 then 0.1::double else 0 end),2) as likelihood from m) select likelihood, count(*) as n from x group by 1",
    "src04_json": f"select lower(drug) as drug, count(distinct post) as reports from ({BAG}) group by 1",
    "src06_delimited": "select p_type as vocabulary_id, count(*) as n, count(distinct p_name) as names from part where p_type in ('SMALL','ECONOMY') group by 1",
    "src07_pairs": f"select distinct lower(drug) as drug, lower(event) as event from ({BAG}) where post%2=0",
    "src25_sections": "select 'history' as name, count(*) as n, count(distinct c_mktsegment) as bodies from customer union all select 'plan', count(*), count(distinct c_name) from customer",
}

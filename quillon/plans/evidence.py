"""Score, model, matching and maintenance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from quillon.operators import dma, models, scores
from quillon.sources.tables import mentions, posts, table

from .signals import BAG, FINE_BAG, POSTS, sql_cells, sql_measures


def _cues() -> dict:
    day = F.dayofmonth("o_orderdate")
    return {
        "temporal": F.col("o_orderstatus") == "F", "dechallenge": F.col("o_orderpriority") == "1-URGENT", "rechallenge": day <= 10, "confounder": F.col("o_orderpriority") == "5-LOW",
        "known": F.col("o_totalprice") > 200000, "prior": day > 25,
    }


def sta38_causality(spark: SparkSession, sf: str) -> DataFrame:
    rows, cues = table(spark, sf, "orders"), _cues()
    category = scores.causality_category(cues)
    grade = scores.severity(F.col("o_totalprice") > 150000, category)
    return rows.groupBy(category.alias("category"), grade.alias("severity")).agg(F.count("*").alias("n"), F.round(F.avg(scores.causality_score(cues)), 3).alias("score"))


def sta43_threads(spark: SparkSession, sf: str) -> DataFrame:
    """A thread is the posts of an author: flagged posts corroborate, finished ones contradict."""
    p = posts(spark, sf).withColumn("good", F.col("severity") == "5-LOW")
    by = p.groupBy("author").agg(F.count("*").alias("n"), F.count_if("ae_flag").alias("ae"), F.count_if(F.col("ae_flag") & ~F.col("good")).alias("yes"), F.count_if(~F.col("ae_flag") & F.col("good")).alias("no"))
    c = scores.thread_confidence(F.col("yes"), F.col("no"), F.col("ae"), F.col("n"))
    rated = by.withColumn("confidence", c)
    return rated.select("author", "n", "confidence", scores.thread_rating(F.col("confidence"), F.col("yes"), F.col("no"), F.col("ae")).alias("rating"))


def sta44_triangulation(spark: SparkSession, sf: str) -> DataFrame:
    signal = dma.disproportionality(mentions(spark, sf, fine=True))
    all_time = dma.pair_counts(mentions(spark, sf)).select(F.col("drug").alias("brand"), "event", F.col("a").alias("reports"))
    rows = signal.withColumn("brand", F.substring_index("drug", "/", 1)).join(all_time, ["brand", "event"])
    score, tier = scores.triangulation(F.col("strength"), F.col("prr"), F.col("chi_square"), F.col("a"), F.col("reports") >= 150, F.col("reports") - 90, F.col("a"), 8)
    return rows.select("drug", "event", "reports", score.alias("score"), tier.alias("tier"))


def sta24_risk_elevation(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation of flagged posts by country within its region."""
    p = posts(spark, sf)
    by = p.groupBy("region", "country").agg(F.count("*").alias("n"), F.count_if("ae_flag").alias("a"))
    cohort = by.groupBy("region").agg(F.sum("n").alias("cohort_n"), F.sum("a").alias("cohort_a"))
    return by.join(cohort, "region").select("region", "country", "n", "a", scores.rem(F.col("a"), F.col("n"), F.col("cohort_a"), F.col("cohort_n")).alias("rem"))


def sta45_lots(spark: SparkSession, sf: str) -> DataFrame:
    """Lots are suppliers: how far a product's mentions cluster in one."""
    rows = table(spark, sf, "lineitem").groupBy(F.pmod("l_partkey", F.lit(500)).alias("product"), F.col("l_suppkey").alias("lot")).agg(F.count("*").alias("n"))
    by = rows.groupBy("product").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    coefficient, flag = scores.lot_flag(F.col("top"), F.col("total"))
    return by.select("product", "top", "total", coefficient.alias("coefficient"), flag.alias("flagged"))


def sta29_self_controlled(spark: SparkSession, sf: str) -> DataFrame:
    """Relative incidence of events in the 7 days from a user's first, against the days after, by type."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    rows = e.withColumn("first", F.min("day").over(Window.partitionBy("user_id", "event_type"))).withColumn("risk", F.datediff("day", "first") < 7)
    by = rows.groupBy("event_type").agg(F.count_if("risk").alias("n_risk"), F.count_if(~F.col("risk")).alias("n_control"))
    ratio = ((F.col("n_risk") + 0.5) / 7) / ((F.col("n_control") + 0.5) / 23)
    return by.select("event_type", "n_risk", "n_control", F.round(ratio, 2).alias("relative_incidence"))


def agg22_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Verbatim terms collapse onto concepts: part types onto their last word."""
    p = table(spark, sf, "part").groupBy(F.col("p_type").alias("verbatim")).agg(F.count("*").alias("n"))
    concept = F.element_at(F.split("verbatim", " "), -1)
    return p.groupBy(concept.alias("concept")).agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"), F.max_by("verbatim", F.struct("n", "verbatim")).alias("main"))


def agg21_enum(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all lifecycle states, those without posts as 0."""
    states = spark.createDataFrame([(s,) for s in ("F", "O", "P", "R", "X")], "state string")
    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return states.join(n, "state", "left").fillna(0, ["n"])


def agg27_evidence_mix(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("severity").isin("1-URGENT", "2-HIGH"), 1).when(F.col("severity") == "3-MEDIUM", 2).otherwise(3)
    weight = F.when(tier == 1, 1.0).when(tier == 2, 0.7).otherwise(0.35)
    return posts(spark, sf).groupBy("region").agg(F.count_if(tier == 1).alias("l1"), F.count_if(tier == 2).alias("l2"), F.count_if(tier == 3).alias("l3"), F.round(F.avg(weight), 3).alias("weight"))


def joi04_last_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's last product, and the events of their posts by it."""
    rows = mentions(spark, sf, fine=True).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("post"), F.col("o_custkey").alias("person")), "post")
    last = rows.groupBy("person").agg(F.max_by("drug", F.struct("post", "drug")).alias("drug"))
    return rows.select("person", "event").distinct().join(last, "person").groupBy("drug", "event").agg(F.count("*").alias("n"))


def joi06_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """The first concept of each name in vocabulary order: the smallest part of a name by size, then key."""
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    return table(spark, sf, "part").withColumn("r", order).where("r = 1").select("p_brand", "p_partkey", "p_size")


def joi19_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The centroid nearest to each embedding, by inner product; a centroid per label is what is broadcast."""
    e = table(spark, sf, "embeddings").where("embedding is not null")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    dot = F.aggregate(F.zip_with("embedding", "c", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = e.select("vec_id", "embedding").join(F.broadcast(centroid)).select("vec_id", F.col("label").alias("nearest"), dot.alias("dot"))
    return scored.groupBy("vec_id").agg(F.max_by("nearest", "dot").alias("nearest"), F.round(F.max("dot"), 4).alias("dot"))


def prd01_facets(spark: SparkSession, sf: str) -> DataFrame:
    """A filter of many facets, sorted and paged, with nulls last."""
    rows = dma.disproportionality(mentions(spark, sf)).where((F.col("a") >= 50) & (F.col("prr") >= 1) & F.col("drug").ilike("%brand#1%") & (F.col("chi_square") >= 0.1))
    return rows.orderBy(F.desc_nulls_last("prr"), "drug", "event").limit(25).select("drug", "event", "a", "prr", "chi_square")


def prd19_brackets(spark: SparkSession, sf: str) -> DataFrame:
    age = F.col("c_acctbal") / 100
    bracket = F.when(age.isNull(), "UNKNOWN").when(age < 18, "PEDIATRIC").when(age >= 65, "GERIATRIC").otherwise("ADULT")
    return table(spark, sf, "customer").groupBy(bracket.alias("bracket")).agg(F.count("*").alias("n"))


def snk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot merge by key: newer rows replace, new rows are added, the rest stays."""
    base = table(spark, sf, "orders").where("o_orderkey % 3 != 0").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    change = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus"), F.lit(2).alias("version"))
    both = base.unionByName(change).groupBy("o_orderkey").agg(F.max_by(F.struct("o_orderstatus", "version"), "version").alias("r"))
    return both.select("o_orderkey", "r.o_orderstatus", "r.version")


def mla_adjusted_odds(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf).select("post", "region", F.col("ae_flag").cast("int").alias("ae"), F.col("severity").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent"))
    hit = mentions(spark, sf).where("drug in ('Brand#11', 'Brand#12', 'Brand#13')").select("post").distinct().withColumn("exposed", F.lit(1))
    rows = p.join(hit, "post", "left").fillna(0, ["exposed"])
    return models.adjusted_odds(rows, "region", "exposed", "ae", ["urgent"])


def mla_cox(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf).select("post", "region", F.datediff("posted_at", F.lit("1995-01-01").cast("date")).alias("days"), F.col("ae_flag").cast("int").alias("ae"))
    hit = mentions(spark, sf).where("drug = 'Brand#11'").select("post").distinct().withColumn("exposed", F.lit(1))
    return models.cox(p.join(hit, "post", "left").fillna(0, ["exposed"]), "region", "days", "ae", "exposed")


QUERIES = {f.__name__: f for f in (
    sta38_causality, sta43_threads, sta44_triangulation, sta24_risk_elevation, sta45_lots, sta29_self_controlled, agg22_synonyms, agg21_enum, agg27_evidence_mix, joi04_last_exposure, joi06_precedence,
    joi19_nearest, prd01_facets, prd19_brackets, snk_upsert, mla_adjusted_odds, mla_cox,
)}

_C = "o_orderstatus='F' as t, o_orderpriority='1-URGENT' as d, day(o_orderdate)<=10 as r, o_orderpriority='5-LOW' as c, o_totalprice>200000 as k, day(o_orderdate)>25 as p"
_SOCIAL = "(strength='STRONG' or (prr>=2 and chi_square>=4 and a>=3))"
_REG = "(reports>=150 or reports-90>=3)"
ORACLES = {
    "sta38_causality": f"""with o as (select *, {_C} from orders), x as (select *, case when t and d and r then 'Certain' when (t and d and not c) or (k and d) then 'Probable' when t or k or p then 'Possible' when c then 'Unlikely' else 'Unassessable' end as category,
round(greatest(0::double,least(1::double,t::int*0.35::double+d::int*0.25::double+r::int*0.3::double-c::int*0.2::double+k::int*0.2::double+p::int*0.15::double)),2) as s from o)
select category, case when o_totalprice>150000 and category in ('Certain','Probable') then 'Critical' when o_totalprice>150000 then 'High' when category in ('Certain','Probable') then 'Medium' else 'Low' end as severity, count(*) as n, round(avg(s),3) as score from x group by 1,2""",
    "sta43_threads": f"""with p as ({POSTS}), b as (select author, count(*) as n, count(*) filter (where ae_flag) as ae, count(*) filter (where ae_flag and severity!='5-LOW') as yes, count(*) filter (where not ae_flag and severity='5-LOW') as no from p group by 1),
c as (select *, round(greatest(0::double,least(1::double,0.35::double+0.55::double*((yes-0.6::double*no)/n)+0.1::double*ae/n)),3) as confidence from b)
select author, n, confidence, case when confidence>=0.72 and yes>=2 and no<=floor(yes/2) then 'Red' when confidence>=0.45 or (ae>=2 and yes>=1) then 'Amber' else 'Green' end as rating from c""",
    "sta44_triangulation": f"""with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}, f as (select drug as brand, event, count(*) as reports from ({BAG}) group by all), j as (select m.*, reports from m join f on split_part(m.drug,'/',1)=f.brand and m.event=f.event),
s as (select *, case when {_SOCIAL} then least(1::double,0.45::double+0.15::double*least(prr/5,1::double)+0.2::double*(case when strength='STRONG' then 1::double else 0.5::double end)) when prr>=1.5 and a>=2 then 0.35::double when a>=1 then 0.15::double else 0 end as so,
case when reports>=150 and reports-90>=10 then 0.95::double when {_REG} then 0.75::double when reports-90>=1 then 0.4::double else 0 end as re, case when a>=3 then least(1::double,a/10.0::double) else 0 end as w from j)
select drug, event, reports, round(least(1::double,0.35::double*so+0.4::double*re+0.25::double*w+case when {_SOCIAL} and {_REG} and a>=3 then 0.12::double else 0 end),8) as score,
case when {_SOCIAL} and {_REG} and a>=3 then 'CRITICAL_URGENT' when {_SOCIAL} and {_REG} then 'HIGH_EARLY_WARNING' when {_SOCIAL} and a<3 then 'EMERGENT_CHATTER' when {_REG} and not {_SOCIAL} then 'REGULATORY_ONLY' else 'INSUFFICIENT' end as tier from s""",
    "sta24_risk_elevation": f"""with b as (select region, country, count(*) as n, count(*) filter (where ae_flag) as a from ({POSTS}) group by all), c as (select region, sum(n) as cn, sum(a) as ca from b group by 1)
select region, country, n, a, round(((a+0.5::double)/(n+1))/((ca+0.5::double)/(cn+1)),3) as rem from b join c using (region)""",
    "sta45_lots": """with n as (select (l_partkey%500)::bigint as product, l_suppkey, count(*) as n from lineitem group by all), b as (select product, max(n) as top, sum(n)::bigint as total from n group by 1)
select *, round(top::double/total,3) as coefficient, round(top::double/total,3)>=0.8 and top>=3 and total>=3 as flagged from b""",
    "sta29_self_controlled": """with e as (select *, cast(ts as date) as day, min(cast(ts as date)) over (partition by user_id, event_type) as f from events), b as (select event_type, count(*) filter (where day-f<7) as n_risk, count(*) filter (where day-f>=7) as n_control from e group by 1)
select *, round(((n_risk+0.5::double)/7)/((n_control+0.5::double)/23),2) as relative_incidence from b""",
    "agg22_synonyms": """with p as (select p_type as v, count(*) as n from part group by 1) select string_split(v,' ')[-1] as concept, sum(n)::bigint as n, count(*) as n_terms, first(v order by n desc, v desc) as main from p group by 1""",
    "agg21_enum": "select s as state, count(o_orderkey) as n from unnest(['F','O','P','R','X']) t(s) left join orders on o_orderstatus=s group by 1",
    "agg27_evidence_mix": f"""with p as (select region, case when severity in ('1-URGENT','2-HIGH') then 1 when severity='3-MEDIUM' then 2 else 3 end as t from ({POSTS}))
select region, count(*) filter (where t=1) as l1, count(*) filter (where t=2) as l2, count(*) filter (where t=3) as l3, round(avg(case t when 1 then 1::double when 2 then 0.7::double else 0.35::double end),3) as weight from p group by 1""",
    "joi04_last_exposure": f"""with b as (select x.*, o_custkey as person from ({FINE_BAG}) x join orders on o_orderkey=post), l as (select person, first(drug order by post desc, drug desc) as drug from b group by 1)
select drug, event, count(*) as n from (select distinct person, event from b) join l using (person) group by all""",
    "joi06_precedence": "select p_brand, p_partkey, p_size from part qualify row_number() over (partition by p_brand order by p_size, p_partkey)=1",
    "joi19_nearest": """with x as (select label, unnest(embedding) as v, generate_subscripts(embedding,1) as i from embeddings), c as (select label, list(v order by i) as c from (select label, i, avg(v::double) as v from x group by all) group by 1),
s as (select vec_id, c.label as nearest, list_sum(list_transform(generate_series(1,len(embedding)), lambda i: embedding[i]::double*c.c[i])) as dot from embeddings, c)
select vec_id, max_by(nearest, dot) as nearest, round(max(dot),4) as dot from s group by 1""",
    "prd01_facets": f"""with bag as ({BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')} select drug, event, a, prr, chi_square from m where a>=50 and prr>=1 and drug ilike '%brand#1%' and chi_square>=0.1 order by prr desc nulls last, drug, event limit 25""",
    "prd19_brackets": "select case when c_acctbal is null then 'UNKNOWN' when c_acctbal/100<18 then 'PEDIATRIC' when c_acctbal/100>=65 then 'GERIATRIC' else 'ADULT' end as bracket, count(*) as n from customer group by 1",
    "snk_upsert": "select o_orderkey, case when o_orderkey%5=0 then lower(o_orderstatus) else o_orderstatus end as o_orderstatus, case when o_orderkey%5=0 then 2 else 1 end as version from orders where o_orderkey%3!=0 or o_orderkey%5=0",
}

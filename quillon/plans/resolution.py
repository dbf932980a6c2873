"""Entity, feed, sink and cohort queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import dma, entities, sinks, texts
from quillon.sources import feeds
from quillon.sources.tables import mentions, posts, table

from .signals import BAG, FINE_BAG, MONTH, MONTH_BAG, POSTS, sql_cells, sql_measures


def sca06_edit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", F.round(entities.edit_ratio(F.col("p_name"), F.lower("p_type")), 4).alias("ratio"))


def sca07_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    """Trigram similarity of a part's name with its type."""
    p = table(spark, sf, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", F.round(entities.jaccard(entities.grams(F.lower("p_name")), entities.grams(F.lower("p_type"))), 4).alias("similarity"))


def nlp25_resolver(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of part names, right, punctuated, with a letter missing, and unknown ones, through the tiers."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("entry")).distinct()
    kind = F.pmod(F.length("entry"), F.lit(4))
    bent = F.when(kind == 0, F.upper("entry")).when(kind == 1, F.regexp_replace("entry", " ", "-")).when(kind == 2, F.concat(F.substring("entry", 1, 3), F.substring("entry", 5, 99))).otherwise(F.concat(F.lit("zzqq"), F.substring("entry", 1, 2)))
    return entities.resolved(names.select(bent.alias("term")), names)


def nlp34_structure(spark: SparkSession, sf: str) -> DataFrame:
    """The five names most alike each part name, by n-grams, of at least 0.6."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("entry")).distinct()
    rows = entities.similar(names.withColumnRenamed("entry", "term"), names, 0.6).where("term != entry")
    return dma.ranked(rows, ["term"], [F.desc("score"), "entry"], 5)


def nlp33_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Members and mentions at each level of a code, the levels being prefixes."""
    pairs = dma.pair_counts(mentions(spark, sf)).groupBy("drug").agg(F.sum("a").alias("a"))
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.substring("drug", 1, w).alias("code")) for k, w in ((1, 5), (2, 7), (3, 8)))))
    return pairs.select(level.alias("x"), "a").groupBy("x.level", "x.code").agg(F.count("*").alias("members"), F.sum("a").alias("n"))


def nlp13_negation(spark: SparkSession, sf: str) -> DataFrame:
    words = entities.tokens(F.col("text"))
    n = entities.negated_mentions(F.col("w"), "the", ["for", "with", "on"], ["and"])
    return table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w")).select("conv_id", "turn", n.cast("long").alias("n")).where("n > 0")


def nlp15_polarity(spark: SparkSession, sf: str) -> DataFrame:
    score, label = entities.polarity(entities.tokens(F.col("text")), {"the": 0.5, "of": -1.0, "to": -0.5, "with": 2.0})
    return table(spark, sf, "documents").select(label.alias("label"), score.alias("score")).groupBy("label").agg(F.count("*").alias("n"), F.max("score").alias("most"), F.min("score").alias("least"))


def sca13_age(spark: SparkSession, sf: str) -> DataFrame:
    """Age cue: the first number of one to three digits; brackets of it."""
    age = F.nullif(F.regexp_extract("text", "(?:^|[^0-9])([0-9]{1,3})(?:[^0-9]|$)", 1), F.lit("")).cast("int")
    bracket = F.when(age.isNull(), "UNKNOWN").when(age < 18, "PEDIATRIC").when(age >= 65, "GERIATRIC").otherwise("ADULT")
    return table(spark, sf, "documents").where("text is not null").groupBy(bracket.alias("bracket")).agg(F.count("*").alias("n"), F.sum(age.cast("long")).alias("total"))


def len43_search(spark: SparkSession, sf: str) -> DataFrame:
    return entities.search(table(spark, sf, "documents"), ["for the", "with the", "on the", "example.com"], 50)


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions as nested report documents in JSON, parsed again."""
    rows = mentions(spark, sf, fine=True).groupBy("post").agg(F.collect_list("drug").alias("drugs"), F.collect_set("event").alias("reactions"))
    return rows.select(F.col("post").alias("bundle"), F.to_json(F.struct("drugs", "reactions")).alias("json"))


def etl01_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Nested reports to exposures and conditions, repeats of any case gone."""
    parsed = _reports(spark, sf).select("bundle", F.from_json("json", "drugs array<string>, reactions array<string>").alias("r"))
    norm = lambda c: F.array_distinct(F.transform(c, F.lower))
    parts = [parsed.select("bundle", F.lit(kind).alias("kind"), F.explode(norm(F.col(f"r.{field}"))).alias("name")) for kind, field in (("exposure", "drugs"), ("condition", "reactions"))]
    return parts[0].unionByName(parts[1]).groupBy("kind", "name").agg(F.count("*").alias("n"))


def etl01_fhir(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders as FHIR bundles: a patient, a medication, an event that refers to it."""
    rows = mentions(spark, sf, fine=True).groupBy("post").agg(F.min("drug").alias("drug"), F.max("event").alias("event"))
    person, ref = F.concat(F.lit("p"), "post"), F.concat(F.lit("m"), "post")
    kind = lambda k: F.lit(k).alias("resourceType")
    subject = F.struct(F.concat(F.lit("Patient/"), person).alias("reference")).alias("subject")
    of = [
        F.struct(kind("Patient"), person.alias("id")),
        F.struct(kind("MedicationStatement"), ref.alias("id"), subject, F.struct(F.col("drug").alias("text")).alias("medicationCodeableConcept")),
        F.struct(kind("AdverseEvent"), F.lit("e").alias("id"), subject, F.struct(F.col("event").alias("text")).alias("event"), F.array(F.struct(F.struct(F.concat(F.lit("MedicationStatement/"), ref).alias("reference")).alias("instance"))).alias("suspectEntity")),
    ]
    body = F.concat(F.lit('{"entry":['), F.concat_ws(",", *(F.concat(F.lit('{"resource":'), F.to_json(x), F.lit("}")) for x in of)), F.lit("]}"))
    return feeds.fhir_events(rows.select(F.col("post").alias("bundle"), body.alias("json"))).select("bundle", "drug", "event")


def etl03_persons(spark: SparkSession, sf: str) -> DataFrame:
    """The first post of each author gives the person's country and severity."""
    return posts(spark, sf).groupBy("author").agg(F.min("post").alias("first_post"), F.min_by("severity", "post").alias("severity"), F.count("*").alias("n"))


def etl08_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that the baseline (pairs of products whose size ends in 2 or 4) lists already."""
    pairs = dma.pair_counts(mentions(spark, sf, fine=True))
    base = mentions(spark, sf, fine=True).where(F.substring("drug", -1, 1).isin("2", "4")).select("drug", "event").distinct().withColumn("listed", F.lit(True))
    return pairs.join(base, ["drug", "event"], "left").fillna(False, ["listed"])


def snk01_insert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return sinks.insert_absent(rows.where("l_orderkey % 2 = 0"), rows, ["l_orderkey", "l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n"))


def snk02_upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = sinks.upserted(c.where("c_custkey % 3 != 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", -F.col("c_acctbal")), ["c_custkey"], ["c_mktsegment", "c_acctbal"])
    return out.groupBy("change").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def snk05_surrogate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", sinks.surrogate_key(F.col("c_name")).alias("id"))


def snk09_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Signals rebuilt for a later month keep what was known of them the month before."""
    before = dma.pair_counts(mentions(spark, sf, "1996-02")).select("drug", "event", F.lit("reviewed").alias("state"), F.col("a").alias("last_a"))
    return sinks.carried(dma.pair_counts(mentions(spark, sf, MONTH)), before, ["drug", "event"], {"state": "new", "last_a": 0})


def snk11_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    severity = F.when(F.col("a") >= 6, "Critical").when(F.col("a") >= 5, "High").otherwise("Low")
    return sinks.alerts(rows, severity, F.col("a") >= 4, F.col("ic025") > 0)


def snk15_purge(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.md5(texts.fold_key(F.coalesce("text", F.lit(""))))
    return sinks.purged(table(spark, sf, "documents"), digest, "doc_id", F.lit(0)).select("doc_id", "duplicate_count")


def snk16_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.disproportionality(mentions(spark, sf)).select("drug", "event", "a", "prr")
    return sinks.merged_labels(rows, F.substring("drug", 1, 7), F.col("event"), ["prr", "drug"])


def set02_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics without the posts that mention an excluded product."""
    gone = mentions(spark, sf, fine=True).where("drug rlike '^Brand#(11|23)/'").select("drug").distinct()
    return dma.disproportionality(dma.without_posts_of(mentions(spark, sf, fine=True), gone)).select("drug", "event", "a", "prr", "chi_square")


def joi13_align(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    one = lambda t, name: daily.where(F.col("event_type") == t).select("day", F.col("n").alias(name))
    return one("purchase", "x").join(one("error", "y"), "day", "full").fillna(0, ["x", "y"])


def len09_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Product by term group; a term may lie in several groups; totals are over all mentions."""
    members = table(spark, sf, "nation").select(F.col("n_name").alias("event"), F.explode(F.array(F.concat(F.lit("narrow-"), F.pmod("n_nationkey", F.lit(4))), F.concat(F.lit("broad-"), F.pmod("n_nationkey", F.lit(3))))).alias("grp"))
    pairs = dma.pair_counts(mentions(spark, sf, fine=True))
    both = pairs.join(members, "event").groupBy("drug", "grp").agg(F.sum("a").alias("a"))
    by_drug, by_group = pairs.groupBy("drug").agg(F.sum("a").alias("bd")), both.groupBy("grp").agg(F.sum("a").alias("be"))
    rows = both.join(by_drug, "drug").join(by_group, "grp").crossJoin(F.broadcast(pairs.agg(F.sum("a").alias("t"))))
    rows = rows.select("drug", F.col("grp").alias("event"), "a", (F.col("bd") - F.col("a")).alias("b"), (F.col("be") - F.col("a")).alias("c"), (F.col("t") - F.col("bd") - F.col("be") + F.col("a")).alias("d"))
    return dma.measures(rows).select(F.col("event").alias("grp"), "drug", "a", "b", "c", "d", "prr", "chi_square", "strength")


def len12_read_across(spark: SparkSession, sf: str) -> DataFrame:
    """Events that stand out for another product of the class and that a product lacks."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True)).withColumn("class", F.substring("drug", 1, 7))
    strong = rows.where("strength != 'WEAK'").groupBy("class", "event").agg(F.count("*").alias("n_analogs"))
    wanted = rows.select("class", "drug").distinct().join(strong, "class")
    return wanted.join(rows.select("drug", "event"), ["drug", "event"], "left_anti").select("drug", "event", "n_analogs")


def len31_strata(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    strata = {"urgent": F.col("severity") == "1-URGENT", "low": F.col("severity") == "5-LOW", "asia": F.col("region") == "ASIA", "asia-urgent": (F.col("region") == "ASIA") & (F.col("severity") == "1-URGENT"), "recent": F.year("posted_at") >= 2000}
    return entities.by_strata(p, strata, F.col("ae_flag"))


def len35_alias_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by alias and pooled by concept, each post once; the alias's share of the pool."""
    rows = mentions(spark, sf).select("post", "drug", F.substring("drug", 1, 7).alias("concept")).distinct()
    alias = rows.groupBy("concept", "drug").agg(F.count("*").alias("n"))
    pool = rows.groupBy("concept").agg(F.countDistinct("post").alias("pooled"))
    return alias.join(pool, "concept").select("concept", "drug", "n", "pooled", F.round(F.col("n") / F.col("pooled"), 4).alias("share"))


def win08_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly counts, the last three weeks, with their cumulative share."""
    weekly = table(spark, sf, "events").groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    tail = dma.ranked(weekly, ["event_type"], [F.desc("week")], 3).drop("rank")
    w = Window.partitionBy("event_type")
    upto = F.sum("n").over(w.orderBy("week").rowsBetween(Window.unboundedPreceding, 0))
    return tail.select("event_type", "week", "n", F.round(upto / F.sum("n").over(w), 4).alias("share"))


def win13_media_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of the last seven days against the seven before, and the gates that follow from their ratio."""
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    rows = e.crossJoin(F.broadcast(e.agg(F.max("day").alias("as_of")))).withColumn("ago", F.datediff("as_of", "day"))
    by = rows.groupBy("event_type").agg(F.count_if(F.expr("ago < 7")).alias("last"), F.count_if(F.expr("ago >= 7 and ago < 14")).alias("before"))
    ratio = F.round(F.col("last") / F.greatest(F.col("before"), F.lit(1)), 3)
    return by.select("event_type", "last", "before", ratio.alias("ratio"), F.when(ratio >= 4, 3).otherwise(2).alias("least_prr"), F.when(ratio >= 4, 6).otherwise(4).alias("least_chi"))


def agg20_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The two products most mentioned with each event, as one text."""
    top = dma.ranked(dma.pair_counts(mentions(spark, sf)), ["event"], [F.desc("a"), "drug"], 2)
    return top.groupBy("event").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "drug"))), lambda s: s["drug"])).alias("top"))


def agg29_overdue(spark: SparkSession, sf: str) -> DataFrame:
    """Open posts beyond the term of their urgency, as of a fixed day."""
    urgent = F.col("severity").isin("1-URGENT", "2-HIGH")
    lead = F.datediff(F.lit("2001-08-01").cast("date"), "posted_at")
    late = (lead > F.when(urgent, 14).otherwise(30)) & ~F.col("ae_flag")
    return posts(spark, sf).groupBy(urgent.alias("urgent")).agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"), F.round(F.count_if(late) / F.count("*"), 4).alias("rate"))


def top05_facets(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    facets = {"strong": F.col("strength") == "STRONG", "moderate": F.col("strength") == "MODERATE", "single": F.col("a") == 1, "repeated": F.col("a") >= 3, "raised": F.col("ic025") > 0}
    return rows.agg(F.count("*").alias("total"), *(F.count_if(p).alias(n) for n, p in facets.items()))


QUERIES = {f.__name__: f for f in (
    sca06_edit_ratio, sca07_trigrams, nlp25_resolver, nlp34_structure, nlp33_ladder, nlp13_negation, nlp15_polarity, sca13_age, len43_search, etl01_flatten, etl01_fhir, etl03_persons, etl08_baseline, snk01_insert,
    snk02_upsert_counts, snk05_surrogate, snk09_carry, snk11_alerts, snk15_purge, snk16_merge, set02_exclusion, joi13_align, len09_groups, len12_read_across, len31_strata, len35_alias_pooled, win08_cumulative,
    win13_media_gate, agg20_mode, agg29_overdue, top05_facets,
)}


def _sql_grams(x: str) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({x})+1), lambda i: substring('  '||{x}||' ', i::int, 3)))"


def _sql_jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a},{b}))::double/len(list_distinct(list_concat({a},{b})))"


_EDIT = "(1-levenshtein(lower(term),lower(entry))::double/greatest(length(term),length(entry)))"
NEAR = f"""g as (select term, {_sql_grams('lower(term)')} as g from t), h as (select entry, {_sql_grams('lower(entry)')} as h from c),
s as (select term, entry, round(greatest({_EDIT}, 0.55::double*{_sql_jaccard('g', 'h')}+0.45::double*{_EDIT}),4) as score from g, h where len(list_intersect(g,h))>0)"""
_FOLD = "upper(regexp_replace({0},'[^A-Za-z0-9]','','g'))"
_TOKENS = "list_filter(string_split_regex(lower(text),'[^a-z0-9]+'), lambda t: t!='')"
_WINDOW = "w[greatest(i-6,1):i-1]"
_LAST = "coalesce(list_max(list_transform(" + _WINDOW + ", lambda x, j: case when x in ({0}) then j else 0 end)),0)"
_BY_MONTH = MONTH_BAG.replace("1996-03-01", "1996-02-01").replace("1996-04-01", "1996-03-01")
ORACLES = {
    "sca06_edit_ratio": "select distinct p_name, p_type, round(1-levenshtein(p_name,lower(p_type))::double/greatest(length(p_name),length(p_type)),4) as ratio from part",
    "sca07_trigrams": f"with p as (select distinct p_name, p_type, {_sql_grams('lower(p_name)')} as g, {_sql_grams('lower(p_type)')} as h from part) select p_name, p_type, round({_sql_jaccard('g', 'h')},4) as similarity from p",
    "nlp25_resolver": f"""with c as (select distinct p_name as entry from part), t as (select distinct case length(entry)%4 when 0 then upper(entry) when 1 then replace(entry,' ','-') when 2 then substring(entry,1,3)||substring(entry,5,99) else 'zzqq'||substring(entry,1,2) end as term from c),
{NEAR}, f as (select term, entry, 1 as tier, 1::double as score from t join c on lower(term)=lower(entry) union all select term, entry, 2, 1 from t join c on {_FOLD.format('term')}={_FOLD.format('entry')} union all select term, entry, 3, score from s where score>=0.72),
b as (select * from f qualify row_number() over (partition by term order by tier, score desc, entry)=1) select t.term, entry, tier, score from t left join b on t.term=b.term""",
    "nlp34_structure": f"with c as (select distinct p_name as entry from part), t as (select entry as term from c), {NEAR} select term, entry, score, row_number() over (partition by term order by score desc, entry) as rank from s where score>=0.6 and term!=entry qualify rank<=5",
    "nlp33_ladder": f"with d as (select drug, count(*) as a from (select distinct post, drug, event from ({BAG})) group by 1), x as ({' union all '.join(f'select {k} as level, substring(drug,1,{w}) as code, a from d' for k, w in ((1, 5), (2, 7), (3, 8)))}) select level, code, count(*) as members, sum(a)::bigint as n from x group by all",
    "nlp13_negation": f"""with t as (select conv_id, turn, {_TOKENS} as w from conversations), n as (select conv_id, turn, len(list_filter(generate_series(1,len(w)), lambda i: w[i]='the' and {_LAST.format("'for','with','on'")} > {_LAST.format("'and'")})) as n from t) select * from n where n>0""",
    "nlp15_polarity": f"""with t as (select list_sum(list_transform(list_concat(['-'], {_TOKENS}), lambda x: case x when 'the' then 0.5::double when 'of' then -1::double when 'to' then -0.5::double when 'with' then 2::double else 0::double end)) as s from documents),
p as (select round(s/sqrt(s*s+15),4) as score from t) select case when score<=-0.05 then 'NEGATIVE' when score>=0.35 then 'POSITIVE' else 'NEUTRAL' end as label, count(*) as n, max(score)+0 as most, min(score)+0 as least from p group by 1""",
    "sca13_age": """with a as (select nullif(regexp_extract(text,'(?:^|[^0-9])([0-9]{1,3})(?:[^0-9]|$)',1),'')::int as age from documents where text is not null)
select case when age is null then 'UNKNOWN' when age<18 then 'PEDIATRIC' when age>=65 then 'GERIATRIC' else 'ADULT' end as bracket, count(*) as n, sum(age)::bigint as total from a group by 1""",
    "len43_search": "with t as (select doc_id, list_filter(['for the','with the','on the','example.com'], lambda t: contains(lower(text), t)) as f from documents) select doc_id, len(f)::int as n_terms, array_to_string(f, ',') as terms from t where len(f)>0 order by n_terms desc, doc_id limit 50",
    "etl01_flatten": f"with b as ({FINE_BAG}), x as (select distinct post, 'exposure' as kind, lower(drug) as name from b union all select distinct post, 'condition', lower(event) from b) select kind, name, count(*) as n from x group by all",
    "etl01_fhir": f"select post as bundle, min(drug) as drug, max(event) as event from ({FINE_BAG}) group by 1",
    "etl03_persons": f"select author, min(post) as first_post, first(severity order by post) as severity, count(*) as n from ({POSTS}) group by 1",
    "etl08_baseline": f"with m as (select drug, event, count(*) as a from ({FINE_BAG}) group by all), b as (select distinct drug, event from ({FINE_BAG}) where right(drug,1) in ('2','4')) select m.drug, m.event, a, b.drug is not null as listed from m left join b on m.drug=b.drug and m.event=b.event",
    "snk01_insert": "with x as (select distinct l_orderkey, l_suppkey from lineitem where l_orderkey%2!=0) select l_suppkey, count(*) as n from x group by 1",
    "snk02_upsert_counts": """with x as (select c_custkey%3!=0 as o, c_custkey%2=0 as n, c_acctbal from customer where c_custkey%3!=0 or c_custkey%2=0)
select case when o and n then 'updated' when n then 'inserted' else 'kept' end as change, count(*) as n, round(sum(case when n then -c_acctbal else c_acctbal end),2) as balance from x group by 1""",
    "snk05_surrogate": "select c_custkey, (('0x'||substring(sha256(c_name),1,16))::ubigint & 9223372036854775807::ubigint)::bigint as id from customer",
    "snk09_carry": f"with m as (select drug, event, count(*) as a from ({MONTH_BAG}) group by all), b as (select drug, event, count(*) as a from ({_BY_MONTH}) group by all) select m.drug, m.event, m.a, case when b.a is null then 'new' else 'reviewed' end as state, coalesce(b.a,0) as last_a from m left join b on m.drug=b.drug and m.event=b.event",
    "snk11_alerts": f"""with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}, r as (select drug, event, strength, concat_ws(', ', case when a>=6 then 'severity Critical' when a>=5 then 'severity High' end, case when a>=4 then 'spike' end, case when ic025>0 then 'SDR' end) as f from m)
select drug, event, case when f!='' then f else 'strong' end as reasons from r where f!='' or strength='STRONG'""",
    "snk15_purge": "select min(doc_id) as doc_id, count(*)-1 as duplicate_count from documents group by md5(upper(regexp_replace(coalesce(text,''),'[^A-Za-z0-9]','','g')))",
    "snk16_merge": f"with bag as ({BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')} select substring(drug,1,7) as drug, event, first(a order by prr desc, m.drug desc) as a, max(prr) as prr, count(*) as n_merged from m group by substring(drug,1,7), event",
    "set02_exclusion": f"with bag as (select * from ({FINE_BAG}) where post not in (select post from ({FINE_BAG}) where regexp_matches(drug,'^Brand#(11|23)/'))), {sql_cells('bag')}, {sql_measures('cells', 'm')} select drug, event, a, prr, chi_square from m",
    "joi13_align": "with d as (select cast(ts as date) as day, event_type, count(*) as n from events group by all) select coalesce(x.day,y.day) as day, coalesce(x.n,0) as x, coalesce(y.n,0) as y from (select * from d where event_type='purchase') x full join (select * from d where event_type='error') y on x.day=y.day",
    "len09_groups": f"""with bag as ({FINE_BAG}), p as (select drug, event, count(*) as n from bag group by all), k as (select n_name as event, 'narrow-'||(n_nationkey%4) as grp from nation union all select n_name, 'broad-'||(n_nationkey%3) from nation),
x as (select drug, grp, sum(n)::bigint as a from p join k using (event) group by all), bd as (select drug, sum(n)::bigint as bd from p group by 1), cells as (select x.drug, x.grp, a, bd-a as b, (sum(a) over (partition by x.grp))::bigint-a as c, (select sum(n)::bigint from p)-bd-(sum(a) over (partition by x.grp))::bigint+a as d from x join bd using (drug)),
{sql_measures('cells', 'm', 'drug, grp')} select grp, drug, a, b, c, d, prr, chi_square, strength from m""",
    "len12_read_across": f"""with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}, s as (select substring(drug,1,7) as class, event, count(*) as n_analogs from m where strength!='WEAK' group by all), d as (select distinct drug, substring(drug,1,7) as class from m)
select d.drug, s.event, n_analogs from d join s using (class) where not exists (select 1 from m where m.drug=d.drug and m.event=s.event)""",
    "len31_strata": f"""with p as ({POSTS}), x as (select unnest(list_filter([case when severity='1-URGENT' then 'urgent' end, case when severity='5-LOW' then 'low' end, case when region='ASIA' then 'asia' end, case when region='ASIA' and severity='1-URGENT' then 'asia-urgent' end, case when year(posted_at)>=2000 then 'recent' end], lambda s: s is not null)) as stratum, ae_flag from p)
select stratum, count(*) as n, count(*) filter (where ae_flag) as a from x group by 1""",
    "len35_alias_pooled": f"with b as (select distinct post, drug, substring(drug,1,7) as concept from ({BAG})), a as (select concept, drug, count(*) as n from b group by all), p as (select concept, count(distinct post) as pooled from b group by 1) select concept, drug, n, pooled, round(n::double/pooled,4) as share from a join p using (concept)",
    "win08_cumulative": """with w as (select event_type, date_trunc('week', ts)::date as week, count(*) as n from events group by all), t as (select * from w qualify row_number() over (partition by event_type order by week desc)<=3)
select event_type, week, n, round((sum(n) over (partition by event_type order by week))::double/(sum(n) over (partition by event_type)),4) as share from t""",
    "win13_media_gate": """with e as (select event_type, (max(cast(ts as date)) over ())-cast(ts as date) as ago from events), b as (select event_type, count(*) filter (where ago<7) as last, count(*) filter (where ago>=7 and ago<14) as before from e group by 1), r as (select *, round(last::double/greatest(before,1),3) as ratio from b)
select *, case when ratio>=4 then 3 else 2 end as least_prr, case when ratio>=4 then 6 else 4 end as least_chi from r""",
    "agg20_mode": f"with p as (select drug, event, count(*) as a from ({BAG}) group by all), r as (select *, row_number() over (partition by event order by a desc, drug) as k from p) select event, string_agg(drug, ',' order by k) as top from r where k<=2 group by 1",
    "agg29_overdue": f"with p as (select severity in ('1-URGENT','2-HIGH') as urgent, (date '2001-08-01'-posted_at) > case when severity in ('1-URGENT','2-HIGH') then 14 else 30 end and not ae_flag as late from ({POSTS})) select urgent, count(*) as n, count(*) filter (where late) as n_late, round(count(*) filter (where late)::double/count(*),4) as rate from p group by 1",
    "top05_facets": f"with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')} select count(*) as total, count(*) filter (where strength='STRONG') as strong, count(*) filter (where strength='MODERATE') as moderate, count(*) filter (where a=1) as single, count(*) filter (where a>=3) as repeated, count(*) filter (where ic025>0) as raised from m",
}

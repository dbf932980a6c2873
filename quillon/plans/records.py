"""Record hygiene, matching, normalisation and ingest queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import dma, entities, hygiene, texts
from quillon.sources.tables import mentions, posts, scratch, table
from quillon.streaming import ingest

from .resolution import NEAR
from .signals import BAG, FINE_BAG, POSTS, sql_cells, sql_measures

#: Key of the pseudonyms of the queries here; a deployment gives its own.
KEY = b"example key"


def sca11_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with personal data of eleven kinds replaced; tested against the same patterns run row by row."""
    rows = hygiene.scrub_rows(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("text").alias("digest"), F.array_join("kinds", ",").alias("kinds"))


def sca19_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 5 == 0, F.md5("c_name")).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", hygiene.pseudonym(name, KEY).alias("author"))


def sca34_canonical(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation")
    return s.select("n_nationkey", F.sha2(hygiene.canonical(s, ["n_regionkey", "n_name", "n_nationkey"]), 256).alias("content_hash"))


def sca22_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by ISO week, its Monday and its month."""
    day = F.col("posted_at")
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return posts(spark, sf).groupBy(label.alias("week"), F.trunc(day, "week").alias("monday")).agg(F.count("*").alias("n"), F.countDistinct(F.trunc(day, "month")).alias("months"))


def prd02_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that a search for "bolt" and what it stands for finds in any of three columns."""
    hit = lambda c: F.lower(c).rlike("bolt|rod|gear|promo")
    return table(spark, sf, "part").where(hit("p_name") | hit("p_type") | hit("p_brand")).select("p_partkey", "p_name")


def prd04_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of scope 2 and of none, by status."""
    scope = F.when(F.col("o_custkey") % 7 == 6, None).otherwise(F.col("o_custkey") % 7)
    return table(spark, sf, "orders").where(hygiene.in_scope(scope, 2)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def prd06_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by how many products they mention and how many are left when brands collapse into concepts (tens)."""
    rows = mentions(spark, sf).groupBy("post").agg(F.collect_set("drug").alias("drugs"))
    concepts = F.array_distinct(F.transform("drugs", lambda d: F.substring(d, 1, 7)))
    return rows.groupBy(F.size("drugs").alias("drugs"), F.size(concepts).alias("concepts")).agg(F.count("*").alias("n"))


def prd08_confidence(spark: SparkSession, sf: str) -> DataFrame:
    score = hygiene.confidence((F.col("value") - 50) / 64)
    return table(spark, sf, "events").groupBy("event_type").agg(F.max(score).alias("most"), F.min(score).alias("least"), F.count_if(score >= 0.5).alias("n_sure"))


def prd09_platforms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose source, written in four forms, belongs to platform src1 or src2."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.col("source")).when(k == 1, F.concat("source", F.lit("/feed"))).when(k == 2, F.concat("source", F.lit("_old"))).otherwise(F.concat("source", F.lit("x")))
    return table(spark, sf, "documents").where(hygiene.of_platform(name, ["src1", "src2"])).groupBy(name.alias("platform")).agg(F.count("*").alias("n"))


def prd12_soft_match(spark: SparkSession, sf: str) -> DataFrame:
    """Signals whose event matches a term softly: "nation_1" lies within eleven names, two names lie within "the
    nation_24 kingdom", "nation-7." is a name but for case and signs, and four letters match nothing."""
    rows, e = dma.pair_counts(mentions(spark, sf)), F.col("event")
    soft = hygiene.soft_match(e, F.lit("nation_1")) | hygiene.soft_match(e, F.lit("the nation_24 kingdom")) | hygiene.soft_match(e, F.lit("nati"))
    return rows.where(soft | hygiene.folded_match(e, F.lit("nation-7."))).select("drug", "event", "a")


def prd17_severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = dma.disproportionality(mentions(spark, sf, fine=True))
    given = F.when(F.length("event") % 2 == 0, "Critical")
    return rows.groupBy(hygiene.severity_bucket(given, F.col("strength")).alias("severity")).agg(F.count("*").alias("n"), F.sum("a").alias("a"))


def nlp12_gateway(spark: SparkSession, sf: str) -> DataFrame:
    """Known words that pass the gateway, by document."""
    words = entities.tokens(F.coalesce("text", F.lit("")))
    passed = hygiene.gateway(F.col("w"), ["the", "der", "with", "on", "dans", "for"], ["on"], ["of", "and", "die"])
    return table(spark, sf, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(passed, ",").alias("passed"))


def nlp32_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Part names, bare and within longer phrases, brought to entries: exact first, then the longest run of words."""
    p = table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.lit(" of steel"))).otherwise(F.concat(F.lit("old "), F.substring_index("p_name", " ", -1), F.lit("s")))
    catalog = p.select(F.col("p_name").alias("entry")).union(p.select(F.substring_index("p_name", " ", 1)))
    return hygiene.tiered(p.select(name.alias("term")), catalog)


def nlp23_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best entries for each typed word, of at least 0.55."""
    typed = spark.createDataFrame([("small gizm",), ("red bot",), ("large",), ("xq",)], "term string")
    found = entities.similar(typed, table(spark, sf, "part").select(F.col("p_name").alias("entry")), 0.55)
    return dma.ranked(found, ["term"], [F.desc("score"), "entry"], 8).select("term", "entry", "score")


def nlp29_places(spark: SparkSession, sf: str) -> DataFrame:
    """Place names in three spellings brought to nations by folded name."""
    n = table(spark, sf, "nation")
    spelt = n.select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit(" "), "n_name", F.lit(".")), F.concat(F.substring("n_name", 1, 3), F.lit("-"), F.substring("n_name", 4, 99)), F.concat(F.lit("New "), "n_name"))).alias("place"))
    key = n.select(texts.fold_key(F.col("n_name")).alias("k"), "n_nationkey", "n_regionkey")
    return spelt.join(F.broadcast(key), texts.fold_key(F.col("place")) == F.col("k"), "left").select("place", "n_nationkey", "n_regionkey")


def nlp37_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Minted codes: eight digits from a digest of the name."""
    code = F.lpad((F.conv(F.substring(F.sha2("p_name", 256), 1, 12), 16, 10).cast("long") % 100000000).cast("string"), 8, "0")
    return table(spark, sf, "part").select("p_name", F.concat(F.lit("C"), code).alias("code")).distinct()


def sup12_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Picker options: one label per folded key, the first by name, with how many spellings it stands for."""
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.regexp_replace("p_name", " ", "-")).alias("label"))
    return p.groupBy(texts.fold_key(F.col("label")).alias("key")).agg(F.min("label").alias("label"), F.countDistinct("label").alias("spellings"))


def sup22_workspaces(spark: SparkSession, sf: str) -> DataFrame:
    """Per workspace (region): posts, authors, adverse ones, first and last day, share of all posts."""
    by = posts(spark, sf).groupBy("region").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"), F.count_if("ae_flag").alias("n_ae"), F.min("posted_at").alias("first"), F.max("posted_at").alias("last"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 4)).drop("total")


def sup34_spotlight(spark: SparkSession, sf: str) -> DataFrame:
    """The signal of each system with the highest PRR, then the most mentions."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True)).join(mentions(spark, sf, fine=True).select("event", "soc").distinct(), "event")
    return dma.ranked(rows, ["soc"], [F.desc("prr"), F.desc("a"), "drug", "event"], 1).select("soc", "drug", "event", "prr", "a")


def snk12_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The entries that each month appends: its pairs that the month before did not have."""
    month = posts(spark, sf).select("post", F.trunc("posted_at", "month").alias("month"))
    now = mentions(spark, sf).join(month, "post").groupBy("month", "drug", "event").agg(F.count("*").alias("a"))
    before = now.select(F.add_months("month", 1).alias("month"), "drug", "event")
    return now.join(before, ["month", "drug", "event"], "left_anti")


def snk13_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of an older shape, without priority, beside new ones: the missing column gets its default."""
    o = table(spark, sf, "orders")
    old = hygiene.with_columns_added(o.where("o_orderkey % 2 = 0").drop("o_orderpriority"), {"o_orderpriority": "unknown", "o_orderstatus": "?"})
    return old.unionByName(o.where("o_orderkey % 2 = 1")).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def _folder(spark: SparkSession) -> str:
    return scratch(spark)


def snk14_export(spark: SparkSession, sf: str) -> DataFrame:
    """Signals written as JSON lines and as CSV and read back."""
    rows, out = dma.pair_counts(mentions(spark, sf, fine=True)), f"{_folder(spark)}/export-{uuid.uuid4().hex}"
    rows.write.json(f"{out}/json")
    rows.write.option("header", True).csv(f"{out}/csv")
    schema = "drug string, event string, a long"
    again = spark.read.schema(schema).json(f"{out}/json").unionByName(spark.read.schema(schema).option("header", True).csv(f"{out}/csv"))
    return again.groupBy("drug", "event").agg(F.min("a").alias("a"), F.count("*").alias("takes"))


def str05_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream in which a user's equal types of an hour are repeats; what the ingest has taken in, by type."""
    rows = table(spark, sf, "events")
    reader = spark.readStream.schema(rows.schema)
    if rows.inputFiles()[0].endswith("/events.parquet"):  # one file: its folder is the stream's source
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        stream = reader.parquet(f"{sf}/events.parquet")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH")), 256)
    folder = f"{_folder(spark)}/ingest-{uuid.uuid4().hex}"
    done = ingest.run_available(stream.withColumn("key", key), f"{folder}/table", f"{folder}/state", "key", "event_id")
    return done.groupBy("event_type").agg(F.count("*").alias("added"), F.max("event_id").alias("last"))


def str10_spikes(spark: SparkSession, sf: str) -> DataFrame:
    """Days of an event type that lie over three deviations above the mean of the days before, of at least four."""
    e = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.greatest(F.stddev_pop("n").over(before), F.sqrt(F.avg("n").over(before)), F.lit(1.0))
    z = (F.col("n") - F.avg("n").over(before)) / floor
    return e.withColumn("known", F.count("*").over(before)).withColumn("z", F.round(z, 3)).where("known >= 4").groupBy("event_type").agg(F.count("*").alias("days"), F.count_if(F.col("z") >= 1).alias("high"), F.max("z").alias("most"))


QUERIES = {f.__name__: f for f in (
    sca11_scrub, sca19_pseudonyms, sca34_canonical, sca22_weeks, prd02_expanded, prd04_scope, prd06_concepts, prd08_confidence, prd09_platforms, prd12_soft_match, prd17_severity, nlp12_gateway, nlp32_tiers, nlp23_suggestions,
    nlp29_places, nlp37_codes, sup12_labels, sup22_workspaces, sup34_spotlight, snk12_audit, snk13_columns, snk14_export, str05_ingest, str10_spikes,
)}

_INNER, _OUTER = (bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
_FOLD = "upper(regexp_replace({0},'[^A-Za-z0-9]','','g'))"
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text,'')),'[^a-z0-9]+'), lambda t: t<>'')"
_fine = f"with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}"
_KNOWN = "('the','der','with','dans','for')"
ORACLES = {
    "sca19_pseudonyms": f"""with x as (select c_custkey, case when c_custkey%5=0 then md5(c_name) else c_name end as n from customer)
select c_custkey, case when regexp_matches(n,'^[0-9a-f]{{32,64}}$') then n else sha256(unhex('{_OUTER}')||unhex(sha256(unhex('{_INNER}')||encode(n)))) end as author from x""",
    "sca34_canonical": """select n_nationkey, sha256('{"n_name":"'||n_name||'","n_nationkey":'||n_nationkey||',"n_regionkey":'||n_regionkey||'}') as content_hash from nation""",
    "sca22_weeks": f"select isoyear(posted_at)||'-W'||lpad(weekofyear(posted_at)::varchar,2,'0') as week, date_trunc('week',posted_at)::date as monday, count(*) as n, count(distinct date_trunc('month',posted_at)) as months from ({POSTS}) group by all",
    "prd02_expanded": "select p_partkey, p_name from part where regexp_matches(lower(p_name||'|'||p_type||'|'||p_brand),'bolt|rod|gear|promo')",
    "prd04_scope": "select o_orderstatus, count(*) as n from orders where o_custkey%7 in (0,2,6) group by 1",
    "prd06_concepts": f"with p as (select post, count(distinct drug) as drugs, count(distinct substring(drug,1,7)) as concepts from ({BAG}) group by 1) select drugs::int as drugs, concepts::int as concepts, count(*) as n from p group by all",
    "prd08_confidence": "with x as (select event_type, round(least(0.99::double, abs((value-50)/64)*0.9::double+0.1::double),3) as s from events) select event_type, max(s) as most, min(s) as least, count(*) filter (where s>=0.5::double) as n_sure from x group by 1",
    "prd09_platforms": """with x as (select source||case doc_id%4 when 0 then '' when 1 then '/feed' when 2 then '_old' else 'x' end as platform from documents) select platform, count(*) as n from x where regexp_matches(platform,'^(src1|src2)($|[/_])') group by 1""",
    "prd12_soft_match": f"select drug, event, count(*) as a from ({BAG}) where contains(lower(event),'nation_1') or contains('the nation_24 kingdom',lower(event)) or {_FOLD.format('event')}='NATION7' group by all",
    "prd17_severity": f"{_fine} select case when length(event)%2=0 then 'Critical' when strength='STRONG' then 'High' when strength='MODERATE' then 'Medium' else 'Low' end as severity, count(*) as n, sum(a)::bigint as a from m group by 1",
    "nlp12_gateway": f"""with t as (select doc_id, {_TOKENS} as w from documents), x as (select doc_id, unnest(w) as t, generate_subscripts(w,1) as i, w from t), k as (select doc_id, t, min(i) as i from x where t in {_KNOWN} and not list_has_any(coalesce(w[greatest(i-3,1):i-1],[]), ['of','and','die']) group by all)
select t.doc_id, coalesce(string_agg(k.t, ',' order by k.i),'') as passed from t left join k using (doc_id) group by 1""",
    "nlp32_tiers": """with p as (select distinct case p_partkey%3 when 0 then upper(p_name) when 1 then lower(p_type)||' '||p_name||' of steel' else 'old '||split_part(p_name,' ',-1)||'s' end as term from part), c as (select p_name as entry from part union select split_part(p_name,' ',1) from part),
f as (select term, entry, lower(term)=entry as exact from p join c on contains(' '||lower(term)||' ', ' '||entry||' ')), b as (select * from f qualify row_number() over (partition by term order by exact desc, length(entry) desc, entry desc)=1)
select term, entry, case when entry is null then null when exact then 1 else 2 end as tier from p left join b using (term)""",
    "nlp23_suggestions": f"with c as (select distinct p_name as entry from part), t as (select unnest(['small gizm','red bot','large','xq']) as term), {NEAR} select term, entry, score from s where score>=0.55 qualify row_number() over (partition by term order by score desc, entry)<=8",
    "nlp29_places": f"""with s as (select unnest([lower(n_name), ' '||n_name||'.', substring(n_name,1,3)||'-'||substring(n_name,4), 'New '||n_name]) as place from nation) select place, n_nationkey, n_regionkey from s left join nation on {_FOLD.format('place')}={_FOLD.format('n_name')}""",
    "nlp37_codes": "select distinct p_name, 'C'||lpad((('0x'||substring(sha256(p_name),1,12))::bigint%100000000)::varchar,8,'0') as code from part",
    "sup12_labels": f"""with x as (select case when p_partkey%2=0 then array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1])||w[2:]),' ') else replace(p_name,' ','-') end as label from part)
select {_FOLD.format('label')} as key, min(label) as label, count(distinct label) as spellings from x group by 1""",
    "sup22_workspaces": f"with b as (select region, count(*) as n, count(distinct author) as authors, count(*) filter (where ae_flag) as n_ae, min(posted_at) as first, max(posted_at) as last from ({POSTS}) group by 1) select *, round(n::double/(select sum(n) from b)::double,4) as share from b",
    "sup34_spotlight": f"{_fine}, s as (select distinct event, soc from bag) select soc, drug, event, prr, a from m join s using (event) qualify row_number() over (partition by soc order by prr desc, a desc, drug, event)=1",
    "snk12_audit": f"""with m as (select date_trunc('month',posted_at)::date as month, drug, event, count(*) as a from ({BAG}) join ({POSTS}) using (post) group by all)
select * from m where not exists (select 1 from m y where y.month=(m.month - interval 1 month)::date and y.drug=m.drug and y.event=m.event)""",
    "snk13_columns": "select case when o_orderkey%2=0 then 'unknown' else o_orderpriority end as o_orderpriority, o_orderstatus, count(*) as n from orders group by all",
    "snk14_export": f"select drug, event, count(*) as a, 2::bigint as takes from ({FINE_BAG}) group by all",
    "str05_ingest": "with f as (select event_type, min(event_id) as e from events group by user_id, event_type, date_trunc('hour', ts)) select event_type, count(*) as added, max(e) as last from f group by 1",
    "str10_spikes": """with e as (select event_type, ts::date as day, count(*) as n from events group by all), z as (select *, count(*) over w as known, round((n-avg(n) over w)/greatest(stddev_pop(n) over w, sqrt(avg(n) over w), 1::double),3) as z from e window w as (partition by event_type order by day rows between unbounded preceding and 1 preceding))
select event_type, count(*) as days, count(*) filter (where z>=1) as high, max(z) as most from z where known>=4 group by 1""",
}

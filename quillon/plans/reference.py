"""Queries of dictionaries, filters, phases and small text functions, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.operators import assessment, dma, entities, sinks
from quillon.operators import clinical as C
from quillon.sources import feeds
from quillon.sources.tables import mentions, posts, scratch, table

from .narratives import _LEX, _N, _PAIRS, _SPANS, _STAGES, _TOOK, _VERB, _pairs, _taken, _values, _verbatim, narratives
from .resolution import _sql_grams, _sql_jaccard
from .signals import BAG, FINE_BAG, POSTS, sql_cells, sql_measures


def prd03_residual(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the pairs whose folded event lies in the wanted one or the other way round; the filter comes before the
    page, so that a page is full."""
    key = F.upper(F.regexp_replace("event", "[^A-Za-z0-9]", ""))
    rows = dma.pair_counts(mentions(spark, sf)).where(F.contains(key, F.lit("NATION1")) | F.contains(F.lit("NATION1"), key))
    return rows.orderBy(F.desc("a"), "drug", "event").limit(50)


def sca09_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """0.55 of the matching-block ratio plus 0.45 of the trigram Jaccard of names and types."""
    p = table(spark, sf, "part").select("p_name", F.lower("p_type").alias("kind")).distinct()
    likeness = 0.55 * special.sequence_ratio(F.col("p_name"), F.col("kind")) + 0.45 * entities.jaccard(entities.grams(F.col("p_name")), entities.grams(F.col("kind")))
    return p.select("p_name", "kind", F.round(likeness, 4).alias("score"))


def sca10_morphological(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_name", F.lower("p_type").alias("kind")).distinct()
    score = 0.5 * entities.jaccard(entities.grams(F.col("p_name")), entities.grams(F.col("kind"))) + 0.5 * entities.edit_ratio(F.col("p_name"), F.col("kind"))
    return p.select("p_name", "kind", F.round(score, 4).alias("score"))


def sca12_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Markers in angle brackets rewritten as redactions."""
    marked = F.concat(F.lit("<"), F.upper("role"), F.lit("> wrote from <IP>"))
    return table(spark, sf, "conversations").groupBy(F.regexp_replace(marked, "<([A-Z_]+)>", "[REDACTED_$1]").alias("text")).agg(F.count("*").alias("n"))


def sca25_half_even(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("s_acctbal") / 8
    return table(spark, sf, "supplier").select("s_suppkey", special.half_even_2(x).alias("rounded"))


def sca04_display(spark: SparkSession, sf: str) -> DataFrame:
    """Names as displayed: blanks collapsed, words capitalised; and joined words stitched together."""
    raw = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" "))
    clean = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return table(spark, sf, "part").groupBy(F.initcap(clean).alias("display")).agg(F.count("*").alias("n"))


def sca35_deep_get(spark: SparkSession, sf: str) -> DataFrame:
    """A value deep in a JSON text, under either of two spellings of its path."""
    doc = F.concat(F.lit('{"a":{"list":[{"v":"'), F.col("event_type"), F.lit('"}]},"props":'), F.coalesce("props", F.lit("{}")), F.lit("}"))
    value = F.coalesce(F.get_json_object(doc, "$.a.items[0].v"), F.get_json_object(doc, "$.a.list[0].v"))
    return table(spark, sf, "events").groupBy(value.alias("v")).agg(F.count("*").alias("n"), F.sum(F.get_json_object(doc, "$.props.k").cast("long")).alias("k"))


def len24_label_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Signals by what their label says (boxed, warned, listed, novel) and whether they pass the gates that this asks."""
    rows = dma.disproportionality(mentions(spark, sf, fine=True)).withColumn("k", F.regexp_extract("event", "([0-9]+)", 1).cast("int"))
    tag = F.when(F.col("k") % 6 == 0, "boxed").when(F.col("k") % 3 == 0, "warning").when(F.col("k") % 4 == 1, "listed").otherwise("novel")
    strict = F.substring_index("drug", "/", -1).cast("int") <= 5  # launched of late
    passed = (F.col("prr") >= F.when(strict, 3).otherwise(2)) & (F.col("chi_square") >= F.when(strict, 6).otherwise(4)) & (F.col("a") >= 3)
    return rows.groupBy(tag.alias("tag"), strict.alias("strict")).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.count_if(passed & (tag == "novel")).alias("act"))


def len22_vaccine_interest(spark: SparkSession, sf: str) -> DataFrame:
    """Events of special interest after vaccines, by organ system: reports, vaccines, the surest level."""
    rows = _pairs(spark, sf).where(C.product_class(F.col("drug")).startswith("J07")).groupBy("drug", "event", "soc").agg(F.count("*").alias("a"))
    level = assessment.brighton(F.col("event").isin("Myocardial infarction", "Chest pain", "Rash"), F.col("a"))
    return rows.groupBy("soc").agg(F.sum("a").alias("reports"), F.countDistinct("drug").alias("vaccines"), F.countDistinct("event").alias("events"), F.min(level).alias("best_level"))


def len33_pair_story(spark: SparkSession, sf: str) -> DataFrame:
    """The odds of each pair of a product, crude and adjusted for the person's sex and age by Mantel-Haenszel sums over
    strata: what share of the crude ratio the strata explain."""
    n = narratives(spark, sf).select("post", F.lower("text").rlike(r"\bwoman\b").alias("woman"), (C.cue_value(F.col("text"), "age").cast("int") >= 50).alias("old"))
    rows = _pairs(spark, sf).select("post", "drug", "event").distinct().join(n, "post")
    cells = None
    by = ["woman", "old"]
    pair = rows.groupBy("drug", "event", *by).agg(F.count("*").alias("a"))
    drug, event, every = (rows.groupBy(*k, *by).agg(F.count("*").alias(c)) for k, c in ((["drug"], "nd"), (["event"], "ne"), ([], "n")))
    grid = pair.select("drug", "event").distinct().join(drug, "drug").join(event, ["event", *by]).join(every, by).join(pair, ["drug", "event", *by], "left").fillna(0, ["a"])
    grid = grid.withColumn("b", F.col("nd") - F.col("a")).withColumn("c", F.col("ne") - F.col("a")).withColumn("d", F.col("n") - F.col("nd") - F.col("ne") + F.col("a"))
    cells = grid.groupBy("drug", "event").agg(
        *(F.sum(x).alias(x) for x in "abcd"), F.sum(F.col("a") * F.col("d") / F.col("n")).alias("up"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("down"), F.count("*").alias("strata"),
    )
    crude = F.round((F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5)), 3)
    return cells.select("drug", "event", "a", "strata", crude.alias("crude"), F.round(F.try_divide(F.col("up"), F.col("down")), 3).alias("adjusted"))


def nlp01_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields as they come in, cleaned: trimmed text, products of known names, regions by their bucket."""
    text = F.trim(F.regexp_replace(F.concat(F.lit("  "), F.col("text"), F.lit("\n")), r"\s+", " "))
    rows = narratives(spark, sf).select(F.coalesce(C.canonical_product(_taken(text)), F.lit("unknown")).alias("product"), F.length(text).alias("size"))
    return rows.groupBy("product").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("size"))


def nlp18_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """What patients write for each preferred term, by how often, with the dictionary's own surfaces."""
    used = narratives(spark, sf).groupBy(_verbatim(F.col("text")).alias("term")).agg(F.count("*").alias("n"))
    rows = C.normalised_events(used).join(used, "term").where("pt is not null")
    listed = C.dictionary(spark, C.EVENTS, "surface pt soc").groupBy("pt").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("listed"))
    trace = rows.groupBy("pt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("term")))), lambda x: x["term"]), ",").alias("written"))
    return listed.join(trace, "pt", "left")


def nlp21_linked_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of texts linked to concepts, negated ones apart, with the mean place."""
    concept = F.create_map(*(F.lit(x) for rows in C.KINDS.values() for r in rows for x in (r[0], r[1])))
    everything = [r[0] for rows in C.KINDS.values() for r in rows]
    rows = narratives(spark, sf).select("text", F.explode(C.spans(F.col("text"), everything)).alias("s"))
    rows = rows.select(concept[F.col("s.surface")].alias("concept"), C.negated_before(F.col("text"), F.col("s.start")).alias("negated"))
    return rows.groupBy("concept", "negated").agg(F.count("*").alias("n"))


def nlp28_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions as written with their concept's minted code and how it was found: exact, fuzzy, or by trigrams."""
    terms = narratives(spark, sf).select(F.regexp_extract("text", " with (.+?) took ", 1).alias("term")).distinct()
    found = C.linked(terms, least=1)
    lexicon = C.dictionary(spark, C.CONDITIONS, "surface concept")
    near = C.nearest_by_grams(found.where("concept is null").select(C.sanitised(F.col("term")).alias("clean")), "clean", lexicon, "surface", 0.5).join(lexicon.withColumnRenamed("concept", "near"), "surface")
    rows = found.withColumn("clean", C.sanitised(F.col("term"))).join(near.select("clean", "near"), "clean", "left")
    rows = rows.select("term", F.coalesce("concept", "near").alias("concept"), F.coalesce("method", F.when(F.col("near").isNotNull(), "trigrams")).alias("method"))
    return rows.withColumn("code", sinks.surrogate_key(F.col("concept")))


def nlp35_device_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Devices found in texts, their class and its minted code."""
    found = C.entities(narratives(spark, sf), "post", "text").where("kind = 'device'").groupBy("surface").agg(F.countDistinct("post").alias("posts"))
    return found.join(C.dictionary(spark, C.DEVICES, "surface device_class"), "surface").withColumn("code", sinks.surrogate_key(F.col("device_class")))


def sup08_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by each step of the class ladder of the product taken."""
    rows = narratives(spark, sf).select(C.product_class(C.canonical_product(_taken(F.col("text")))).alias("class")).where("class is not null")
    step = F.explode(F.array(*(F.substring("class", 1, n) for n in (1, 3, 4, 5))))
    return rows.select(step.alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def sup09_chemicals(spark: SparkSession, sf: str) -> DataFrame:
    """Products as written, typing errors within one edit included, with ingredient and class."""
    written = narratives(spark, sf).select(F.regexp_replace(F.lower(_taken(F.col("text"))), "^(.)(.)", "$2$1").alias("typo"), F.lower(_taken(F.col("text"))).alias("taken")).distinct()
    terms = written.select(F.col("taken").alias("term")).union(written.select("typo")).distinct()
    lexicon = C.dictionary(spark, C.PRODUCTS, "surface generic class")
    exact = terms.join(lexicon, terms.term == lexicon.surface).select("term", "generic", "class", F.lit("exact").alias("method"))
    rest = terms.join(exact.select("term"), "term", "left_anti")
    near = rest.join(lexicon, F.length("term") == F.length("surface")).where(F.levenshtein("term", "surface") <= 2).groupBy("term").agg(F.min_by(F.struct("generic", "class"), "surface").alias("b"))
    return terms.join(exact.unionByName(near.select("term", "b.generic", "b.class", F.lit("near").alias("method"))), "term", "left")


def sup13_dual_names(spark: SparkSession, sf: str) -> DataFrame:
    names = C.aliases(spark)
    return names.groupBy("generic").agg(F.count("*").alias("names"), F.min("alias").alias("first_name")).withColumn("concept_id", sinks.surrogate_key(F.col("generic")))


def sup16_vaccines(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose product is a vaccine, under any of its names."""
    generic = C.canonical_product(_taken(F.col("text")))
    vaccine = F.coalesce(C.product_class(generic).startswith("J07"), F.lit(False))
    return narratives(spark, sf).groupBy(vaccine.alias("vaccine")).agg(F.count("*").alias("n"), F.countDistinct(_taken(F.col("text"))).alias("names"))


def sup17_biologics(spark: SparkSession, sf: str) -> DataFrame:
    """Products that are biologics by the ending of their generic name."""
    generic = C.canonical_product(_taken(F.col("text")))
    return narratives(spark, sf).select(generic.alias("generic")).where("generic is not null").groupBy("generic", F.col("generic").rlike("(mab|cept|kinra)$").alias("biologic")).agg(F.count("*").alias("n"))


def sup19_mitigation(spark: SparkSession, sf: str) -> DataFrame:
    """What is recommended for each organ system with strong pairs."""
    rows = dma.disproportionality(_pairs(spark, sf).select("post", "drug", "event").distinct())
    soc = C.dictionary(spark, sorted({(p, s) for _, p, s in C.EVENTS}), "event soc")
    advice = F.when(F.col("soc") == "Cardiac", "monitor heart").when(F.col("soc") == "Hepatobiliary", "test liver function").when(F.col("soc") == "Congenital", "avoid in pregnancy").otherwise("inform patients")
    return rows.join(soc, "event").groupBy("soc", advice.alias("advice")).agg(F.count_if(F.col("strength") != "WEAK").alias("signals"), F.count("*").alias("n"))


def sup20_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of the product gate by what is asked, and whether the use is one of those allowed."""
    rows = narratives(spark, sf).select((F.col("post") % 3).alias("k"), C.gates(F.col("text"))["product"].alias("guess"), (F.col("post") % 13 != 11).alias("truth"))
    context = F.when(F.col("k") == 0, "triage").when(F.col("k") == 1, "signal detection").otherwise("advice")
    by = rows.groupBy(context.alias("context")).agg(*(F.count_if(F.expr(e)).alias(c) for e, c in (("truth and guess", "tp"), ("not truth and guess", "fp"), ("truth and not guess", "fn"))))
    p, r = F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4)
    return by.select("context", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), (F.col("context").isin("triage", "signal detection") & (p >= 0.8) & (r >= 0.8)).alias("allowed"))


def sup21_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold cases of two sources with their tag, the first source winning where both have one."""
    a = table(spark, sf, "labels").select(F.lit("labels").alias("source"), F.col("doc_id").alias("case"), F.col("toxic").cast("long").alias("gold"))
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").cast("long").alias("case"), F.lit(0).cast("long").alias("gold"))
    rows = a.unionByName(b).groupBy("case").agg(F.max_by(F.struct("source", "gold"), F.col("source")).alias("g"))
    return rows.groupBy("g.source").agg(F.count("*").alias("n"), F.sum("g.gold").alias("gold"))


def src09_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionaries from Parquet, from JSON, and from the library's own rows where a folder has none."""
    out = f"{scratch(spark)}/dictionaries-{uuid.uuid4().hex}"
    schema = "surface string, concept string"
    p = table(spark, sf, "part").select(F.col("p_name").alias("surface"), F.col("p_brand").alias("concept")).distinct()
    p.write.parquet(f"{out}/products.parquet")
    p.limit(0).write.json(f"{out}/products.json")
    table(spark, sf, "nation").select(F.col("n_name").alias("surface"), F.lower("n_name").alias("concept")).write.json(f"{out}/places.json")
    rows = None
    for name in ("products", "places", "conditions"):
        one = feeds.dictionary(spark, out, name, schema, C.CONDITIONS).withColumn("name", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("concept").alias("concepts"))


def sup01_reprocessed(spark: SparkSession, sf: str) -> DataFrame:
    """All posts derived anew: the processed table is overwritten whole, twice, and holds each post once."""
    out = f"{scratch(spark)}/processed-{uuid.uuid4().hex}"
    for _ in range(2):
        g = C.gates(F.col("text"))
        rows = narratives(spark, sf).select("post", (g["product"] & g["event"]).alias("ae"), C.canonical_product(_taken(F.col("text"))).alias("drug"))
        rows.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).groupBy("drug", "ae").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    prd03_residual, sca09_sequence, sca10_morphological, sca12_redacted, sca25_half_even, sca04_display, sca35_deep_get, len24_label_filter, len22_vaccine_interest, len33_pair_story, nlp01_fields, nlp18_glossary,
    nlp21_linked_spans, nlp28_codes, nlp35_device_codes, sup08_ladder, sup09_chemicals, sup13_dual_names, sup16_vaccines, sup17_biologics, sup19_mitigation, sup20_scorecard, sup21_gold, src09_dictionaries,
    sup01_reprocessed,
)}

_code = lambda x: f"(('0x'||substring(sha256({x}),1,16))::ubigint & 9223372036854775807::ubigint)::bigint"
_JACCARD = _sql_jaccard(_sql_grams("p_name"), _sql_grams("kind"))
_PROD = C.alternation([s for s, _, _ in C.PRODUCTS])
_EV = C.alternation([s for s, _, _ in C.EVENTS])
_GEN = f"(select n.*, generic, class from n left join prod on prod.surface=lower({_TOOK}))"
_fine = f"with bag as ({FINE_BAG}), {sql_cells('bag')}, {sql_measures('cells', 'm')}"
ORACLES = {
    "prd03_residual": f"select drug, event, count(*) as a from ({BAG}) where contains(upper(regexp_replace(event,'[^A-Za-z0-9]','','g')),'NATION1') group by all order by a desc, drug, event limit 50",
    "sca10_morphological": f"select distinct p_name, kind, round(0.5::double*{_JACCARD}+0.5::double*(1-levenshtein(p_name,kind)::double/greatest(length(p_name),length(kind))),4) as score from (select p_name, lower(p_type) as kind from part)",
    "sca12_redacted": "select '[REDACTED_'||upper(role)||'] wrote from [REDACTED_IP]' as text, count(*) as n from conversations group by 1",
    "sca04_display": "select array_to_string(list_transform(string_split(p_name,' '), lambda x: upper(x[1])||lower(x[2:])),' ') as display, count(*) as n from part group by 1",
    "sca35_deep_get": "select event_type as v, count(*) as n, sum(json_extract_string(props,'$.k')::bigint)::bigint as k from events group by 1",
    "len24_label_filter": f"""{_fine}, x as (select *, regexp_extract(event,'([0-9]+)',1)::int as k, split_part(drug,'/',2)::int<=5 as strict from m), y as (select *, case when k%6=0 then 'boxed' when k%3=0 then 'warning' when k%4=1 then 'listed' else 'novel' end as tag,
prr>=case when strict then 3 else 2 end and chi_square>=case when strict then 6 else 4 end and a>=3 as passed from x) select tag, strict, count(*) as n, count(*) filter (where passed) as passed, count(*) filter (where passed and tag='novel') as act from y group by all""",
    "len33_pair_story": rf"""with {_PAIRS}, s as (select post, regexp_matches(lower(text),'\bwoman\b') as woman, nullif(regexp_extract(lower(text),'{C.CUE['age']}',1),'')::int>=50 as old from n), r as (select distinct p.post, drug, event, woman, old from pr p join s using (post)),
pair as (select drug, event, woman, old, count(*) as a from r group by all), d as (select drug, woman, old, count(*) as nd from r group by all), e as (select event, woman, old, count(*) as ne from r group by all), tt as (select woman, old, count(*) as n from r group by all),
g as (select p.drug, p.event, coalesce(pair.a,0) as a, nd, ne, tt.n from (select distinct drug, event from pair) p join d on d.drug=p.drug join e on e.event=p.event and e.woman=d.woman and e.old=d.old join tt on tt.woman=d.woman and tt.old=d.old left join pair on pair.drug=p.drug and pair.event=p.event and pair.woman=d.woman and pair.old=d.old),
h as (select drug, event, sum(a)::bigint as a, sum(nd-a) as b, sum(ne-a) as c, sum(n-nd-ne+a) as d, sum(a*(n-nd-ne+a)/n::double) as up, sum((nd-a)*(ne-a)/n::double) as down, count(*) as strata from g group by all)
select drug, event, a, strata, round((a+0.5::double)*(d+0.5::double)/((b+0.5::double)*(c+0.5::double)),3) as crude, round(case when down=0 then null else up/down end,3) as adjusted from h""",
    "nlp01_fields": rf"with {_N}, {_LEX}, x as (select trim(regexp_replace('  '||text||chr(10),'\s+',' ','g')) as text from n) select coalesce(generic,'unknown') as product, count(*) as n, sum(length(text))::bigint as size from x left join prod on prod.surface=lower({_TOOK}) group by 1",
    "nlp18_glossary": f"with {_STAGES}, l as (select pt, string_agg(surface, ',' order by surface) as listed from lex group by 1), w as (select pt, string_agg(term, ',' order by n desc, term) as written from ev where pt is not null group by 1) select l.pt, listed, written from l left join w using (pt)",
    "nlp21_linked_spans": f"with {_SPANS} select concept, regexp_matches(substring(lower(text), (greatest(instr(lower(text),x.surface)-1-20,0)+1)::int, least(instr(lower(text),x.surface)-1,20)::int), '{C.CUE['negation']}') as negated, count(*) as n from x join kinds using (surface) group by all",
    "nlp35_device_codes": f"with {_SPANS} select x.surface, count(distinct post) as posts, concept as device_class, {_code('concept')} as code from x join kinds using (surface) where kind='device' group by all",
    "sup08_ladder": f"with {_N}, {_LEX}, c as (select class from {_GEN} where class is not null), x as (select unnest([class[1:1], class[1:3], class[1:4], class[1:5]]) as code from c) select code, count(*) as n from x group by 1",
    "sup09_chemicals": f"""with {_N}, {_LEX}, w as (select distinct lower({_TOOK}) as taken from n), t as (select taken as term from w union select taken[2:2]||taken[1:1]||taken[3:] from w),
y as (select term, p.generic, p.class, levenshtein(term,p.surface) as d, p.surface from t join prod p on length(term)=length(p.surface) and levenshtein(term,p.surface)<=2 where term not in (select surface from prod) qualify row_number() over (partition by term order by p.surface)=1)
select t.term, coalesce(p.generic,y.generic) as generic, coalesce(p.class,y.class) as class, case when p.generic is not null then 'exact' when y.generic is not null then 'near' end as method from t left join prod p on p.surface=t.term left join y on y.term=t.term""",
    "sup13_dual_names": f"with {_LEX}, al as (select generic, surface as alias from prod union select generic, generic from prod) select generic, count(*) as names, min(alias) as first_name, {_code('generic')} as concept_id from al group by 1",
    "sup16_vaccines": f"with {_N}, {_LEX} select coalesce(class like 'J07%',false) as vaccine, count(*) as n, count(distinct {_TOOK}) as names from {_GEN} group by 1",
    "sup17_biologics": f"with {_N}, {_LEX} select generic, regexp_matches(generic,'(mab|cept|kinra)$') as biologic, count(*) as n from {_GEN} where generic is not null group by all",
    "sup19_mitigation": f"with {_PAIRS}, bag as (select distinct post, drug, event from pr), {sql_cells('bag')}, {sql_measures('cells', 'm')}, so as (select distinct pt as event, soc from lex) select soc, case soc when 'Cardiac' then 'monitor heart' when 'Hepatobiliary' then 'test liver function' when 'Congenital' then 'avoid in pregnancy' else 'inform patients' end as advice, count(*) filter (where strength!='WEAK') as signals, count(*) as n from m join so using (event) group by all",
    "sup20_scorecard": f"""with {_N}, x as (select case post%3 when 0 then 'triage' when 1 then 'signal detection' else 'advice' end as context, regexp_matches(lower(text),'{_PROD}') as guess, post%13!=11 as truth from n), b as (select context, count(*) filter (where truth and guess) as tp, count(*) filter (where not truth and guess) as fp, count(*) filter (where truth and not guess) as fn from x group by 1),
s as (select *, round(tp::double/nullif(tp+fp,0),4) as precision, round(tp::double/nullif(tp+fn,0),4) as recall from b) select *, context in ('triage','signal detection') and precision>=0.8 and recall>=0.8 as allowed from s""",
    "sup21_gold": "with x as (select 'labels' as source, doc_id::bigint as c, toxic::bigint as gold from labels union all select 'benchmark', item_id::bigint, 0 from benchmark), f as (select * from x qualify row_number() over (partition by c order by source desc)=1) select source, count(*) as n, sum(gold)::bigint as gold from f group by 1",
    "src09_dictionaries": f"select 'products' as name, count(*) as n, count(distinct p_brand) as concepts from (select distinct p_name, p_brand from part) union all select 'places', count(*), count(distinct lower(n_name)) from nation union all select 'conditions', {len(C.CONDITIONS)}, {len({c for _, c in C.CONDITIONS})}",
    "sup01_reprocessed": f"with {_N}, {_LEX} select generic as drug, regexp_matches(lower(text),'{_PROD}') and regexp_matches(lower(text),'{_EV}') and not regexp_matches(lower(text), '(?:^|[^a-z])(?:no|denies|without) {_EV[2:]}') as ae, count(*) as n from {_GEN} group by all",
}

"""Queries of the clinical text operators over narratives, and their SQL.

A narrative is told of each order: its key picks who, what for, what was taken, what happened, and what came of it.
The operators see its text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import clinical as C
from quillon.operators import dma, scores
from quillon.sources.tables import table

from .signals import sql_cells, sql_measures

_TAKEN = ["Advil", "tylenol", "metformin", "Glucophage", "lipitor", "Humira", "warfarin", "flu vaccine", "influenza vaccine", "brufen", "acetaminophen", "qqx77", "paracetamol"]
_HAPPENED = [
    "headaches", "a rash", "head ache", "puking", "vomitting", "hives", "dizzyness", "chest pains", "heart attack", "could not sleep", "insomnia", "cleft palate", "liver failure", "nose bleeds", "rashes", "rainbow", "threw up",
]
_HAVING = ["asthma", "diabetis", "diabetes type 2", "high blood pressure", "hypertenson", "no illness", "migraine"]
_OUTCOME = [" Stopped it and it resolved.", " Stopped it and it resolved, restarted it and it came back.", " It persisted.", " Stopped the drug, no change.", ""]
_WITH = ["", " Uses an insulin pump.", "", " Has a pacemaker.", ""]


def _parts(k: str) -> list[str]:
    """The pieces of a narrative as SQL that Spark and DuckDB both read, k being the order's key."""
    pick = lambda words, by: "case " + " ".join(f"when {k} % {len(words)} = {i} then '{w}'" for i, w in enumerate(words)) + " end" if by == "k" else ""
    return [
        f"case when {k} % 2 = 0 then 'Woman, ' else 'Man, ' end", f"cast(18 + {k} % 71 as string)", "' years old,'", f"case when {k} % 22 = 4 then ' pregnant,' else '' end", "' with '", pick(_HAVING, "k"),
        "' took '", pick(_TAKEN, "k"), f"case when {k} % 3 = 0 then ' 400 mg' else ' 200 mg' end", f"case when {k} % 10 = 7 then '. No ' else '. Had ' end", pick(_HAPPENED, "k"), f"case when {k} % 4 = 1 then ' today.' else ' after 3 days.' end",
        pick(_OUTCOME, "k"), f"case when {k} % 6 = 0 then ' Lot AB12' || cast(10 + {k} % 25 as string) || ', NDC 12345-678-90, exp 05/2026.' else '' end", f"case when {k} % 8 = 2 then ' It is listed on the label.' else '' end", pick(_WITH, "k"),
    ]


def narratives(spark: SparkSession, sf: str) -> DataFrame:
    """post, author, posted_at and text."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("post"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("posted_at"), F.expr(" || ".join(_parts("o_orderkey"))).alias("text"))


def _verbatim(text: Column) -> Column:
    return F.regexp_extract(text, r"\. (?:Had|No) (.+?) (?:today|after)", 1)


def _taken(text: Column) -> Column:
    return F.regexp_extract(text, r" took (.+?) [0-9]+ mg", 1)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """post, drug (generic) and event (preferred term) of texts whose product and event are known and not negated."""
    n = narratives(spark, sf).select("post", "text", _taken(F.col("text")).alias("taken"), _verbatim(F.col("text")).alias("term"))
    events = C.normalised_events(n).where("pt is not null").select("term", F.col("pt").alias("event"), "soc")
    rows = n.where(~F.col("text").contains(". No ")).withColumn("drug", C.canonical_product(F.col("taken"))).where("drug is not null")
    return rows.join(F.broadcast(events), "term").select("post", "text", "drug", "event", "soc")


def nlp03_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.entities(narratives(spark, sf), "post", "text")
    return rows.groupBy("kind", "surface").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


def nlp05_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products as written, their generic names and classes; what is no product has none."""
    rows = narratives(spark, sf).groupBy(_taken(F.col("text")).alias("taken")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("generic", C.canonical_product(F.col("taken")))
    return rows.withColumn("class", C.product_class(F.col("generic")))


def nlp06_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as written and the stage that finds their preferred term."""
    terms = narratives(spark, sf).groupBy(_verbatim(F.col("text")).alias("term")).agg(F.count("*").alias("n"))
    return C.normalised_events(terms).join(terms, "term").drop("score")


def nlp08_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Surfaces collapsed to their preferred term."""
    terms = narratives(spark, sf).groupBy(_verbatim(F.col("text")).alias("term")).agg(F.count("*").alias("n"))
    rows = C.normalised_events(terms).join(terms, "term").where("pt is not null")
    return rows.groupBy("pt").agg(F.count("*").alias("n_surfaces"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("clean")), ",").alias("surfaces"))


def nlp11_layman(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that no dictionary has, and the surface of nearest trigrams."""
    terms = narratives(spark, sf).select(C.sanitised(_verbatim(F.col("text"))).alias("clean")).distinct()
    lexicon = C.dictionary(spark, C.EVENTS, "surface pt soc")
    return C.nearest_by_grams(terms.join(lexicon.select(F.col("surface").alias("clean")), "clean", "left_anti"), "clean", lexicon, "surface", 0.4)


def joi20_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by product class and organ system, through the dictionaries' hierarchies."""
    rows = _pairs(spark, sf).withColumn("class", C.product_class(F.col("drug")))
    return rows.groupBy("class", "soc").agg(F.countDistinct("post").alias("posts"), F.countDistinct("drug").alias("drugs"))


def nlp14_window_negation(spark: SparkSession, sf: str) -> DataFrame:
    rows = narratives(spark, sf).select("text", F.explode(C.spans(F.col("text"), [s for s, _, _ in C.EVENTS])).alias("s"))
    negated = C.negated_before(F.col("text"), F.col("s.start"))
    return rows.groupBy(F.col("s.surface").alias("surface")).agg(F.count("*").alias("n"), F.count_if(negated).alias("negated"))


def nlp09_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions as written, linked by surface or within two edits."""
    terms = narratives(spark, sf).groupBy(F.regexp_extract("text", " with (.+?) took ", 1).alias("term")).agg(F.count("*").alias("n"))
    return C.linked(terms).join(terms, "term")


def nlp19_comorbidities(spark: SparkSession, sf: str) -> DataFrame:
    rows = narratives(spark, sf).select(F.explode(C.contained_conditions(F.col("text"))).alias("condition"))
    return rows.groupBy("condition").agg(F.count("*").alias("n"))


def nlp20_features(spark: SparkSession, sf: str) -> DataFrame:
    """Case features from the text: sex, age bracket, dose, onset, conditions."""
    t = F.col("text")
    age = C.cue_value(t, "age").cast("int")
    bracket = F.when(age < 18, "child").when(age >= 65, "elder").otherwise("adult")
    sex = F.when(F.lower(t).rlike(r"\bwoman\b"), "F").when(F.lower(t).rlike(r"\bman\b"), "M").otherwise("U")
    return narratives(spark, sf).groupBy(sex.alias("sex"), bracket.alias("bracket")).agg(
        F.count("*").alias("n"), F.sum(C.cue_value(t, "dose").cast("long")).alias("mg"), F.sum(C.cue_value(t, "onset").cast("long")).alias("days"), F.sum(F.size(C.contained_conditions(t)).cast("long")).alias("conditions"),
    )


def sca14_lots(spark: SparkSession, sf: str) -> DataFrame:
    rows = narratives(spark, sf).select(*(C.cue_value(F.col("text"), c).alias(c) for c in ("lot", "ndc", "expiry"))).where("lot is not null")
    return rows.groupBy("lot", "ndc", "expiry").agg(F.count("*").alias("n"))


def sta42_challenges(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return narratives(spark, sf).groupBy(C.dechallenge(t).alias("dechallenge"), C.rechallenge(t).alias("rechallenge")).agg(F.count("*").alias("n"))


def sta39_best_causality(spark: SparkSession, sf: str) -> DataFrame:
    """The largest causality score of each pair's texts, and the first post that has it."""
    cues = C.narrative_cues(F.col("text"))
    rows = _pairs(spark, sf).select("drug", "event", "post", scores.causality_score(cues).alias("score"), scores.causality_category(cues).alias("category"))
    best = rows.groupBy("drug", "event").agg(F.max_by(F.struct("score", "category", "post"), F.struct("score", -F.col("post"))).alias("b"))
    return best.select("drug", "event", "b.score", "b.category", "b.post")


def sup15_narrative_causality(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    cues = C.narrative_cues(t)
    points, band = C.naranjo_from_text(t)
    rows = narratives(spark, sf).select(scores.causality_category(cues).alias("category"), band.alias("checklist"), points.alias("points"), scores.severity(t.contains("heart attack") | t.contains("liver failure"), scores.causality_category(cues)).alias("severity"))
    return rows.groupBy("category", "checklist", "severity").agg(F.count("*").alias("n"), F.sum(F.col("points").cast("long")).alias("points"))


def nlp16_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by the gates that they pass."""
    g = C.gates(F.col("text"))
    return narratives(spark, sf).groupBy(*(c.alias(n) for n, c in g.items())).agg(F.count("*").alias("n"))


def _pregnant(event: Column) -> Column:
    return C.has(F.col("text"), "pregnancy") | (event == "Congenital")


def prd11_pregnancy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).where(_pregnant(F.col("soc")))
    return rows.groupBy("drug", F.col("soc").eqNullSafe("Congenital").alias("congenital")).agg(F.count("*").alias("n"))


def len08_pregnancy(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics within the pregnancy cohort, congenital events marked."""
    rows = _pairs(spark, sf).where(_pregnant(F.col("soc")))
    kind = rows.select("event", (F.col("soc") == "Congenital").alias("congenital")).distinct()
    return dma.disproportionality(rows.select("post", "drug", "event").distinct()).select("drug", "event", "a", "prr", "chi_square", "strength").join(F.broadcast(kind), "event")


def nlp31_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The names of each product concept that the texts use, with all its names."""
    used = narratives(spark, sf).select(F.lower(_taken(F.col("text"))).alias("alias")).groupBy("alias").agg(F.count("*").alias("n"))
    names = C.aliases(spark)
    closure = names.groupBy("generic").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    rows = names.join(used, "alias").groupBy("generic").agg(F.count("*").alias("n_used"), F.sum("n").alias("n"))
    return rows.join(closure, "generic")


def prd13_alias_match(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose product is one of the wanted ones under any of its names."""
    wanted = spark.createDataFrame([("Tylenol",), ("humira",)], "wanted string").withColumn("generic", C.canonical_product(F.col("wanted")))
    names = F.broadcast(C.aliases(spark).join(F.broadcast(wanted), "generic"))
    rows = narratives(spark, sf).select("post", F.lower(_taken(F.col("text"))).alias("alias")).join(names, "alias")
    return rows.groupBy("wanted", "alias").agg(F.count("*").alias("n"))


def nlp36_facade(spark: SparkSession, sf: str) -> DataFrame:
    """Each surface found in the texts with its kind and what its terminology calls it."""
    spark_rows = [(k, r[0], r[1]) for k, rows in C.KINDS.items() for r in rows]
    names = C.dictionary(spark, spark_rows, "kind surface concept")
    rows = C.entities(narratives(spark, sf), "post", "text").groupBy("kind", "surface").agg(F.countDistinct("post").alias("posts"))
    return rows.join(names, ["kind", "surface"])


def nlp04_devices(spark: SparkSession, sf: str) -> DataFrame:
    """Devices in the texts by class, with the products taken beside them."""
    found = C.entities(narratives(spark, sf), "post", "text")
    device = found.where("kind = 'device'").join(C.dictionary(spark, C.DEVICES, "surface device_class"), "surface").select("post", "device_class")
    product = found.where("kind = 'product'").select("post", C.canonical_product(F.col("surface")).alias("generic"))
    return device.join(product, "post").groupBy("device_class", "generic").agg(F.count("*").alias("n"))


def nlp17_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    """Texts scrubbed of numbers, hashed, and of equal ones by an author within 30 days only the first kept."""
    from pyspark.sql import Window

    rows = narratives(spark, sf).select("author", "post", "posted_at", F.sha2(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), 256).alias("h"))
    before = F.lag("posted_at").over(Window.partitionBy("author", "h").orderBy("posted_at", "post"))
    again = F.coalesce(F.datediff("posted_at", before) <= 30, F.lit(False))
    return rows.withColumn("again", again).groupBy(F.trunc("posted_at", "year").alias("year")).agg(F.count("*").alias("n"), F.count_if("again").alias("n_again"), F.countDistinct("h").alias("texts"))


QUERIES = {f.__name__: f for f in (
    nlp03_entities, nlp05_products, nlp06_events, nlp08_collapsed, nlp11_layman, joi20_rollup, nlp14_window_negation, nlp09_conditions, nlp19_comorbidities, nlp20_features, sca14_lots, sta42_challenges,
    sta39_best_causality, sup15_narrative_causality, nlp16_gates, prd11_pregnancy, len08_pregnancy, nlp31_closure, prd13_alias_match, nlp36_facade, nlp04_devices, nlp17_hygiene,
)}


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") v({', '.join(names.split())})"


_N = f"n as (select o_orderkey as post, o_custkey as author, cast(o_orderdate as date) as posted_at, {' || '.join(_parts('o_orderkey'))} as text from orders)"
_LEX = f"lex as (select * from {_values(C.EVENTS, 'surface pt soc')}), prod as (select * from {_values(C.PRODUCTS, 'surface generic class')}), con as (select * from {_values(C.CONDITIONS, 'surface concept')})"
_VERB, _TOOK = r"regexp_extract(text, '\. (?:Had|No) (.+?) (?:today|after)', 1)", r"regexp_extract(text, ' took (.+?) [0-9]+ mg', 1)"


def _clean(x: str) -> str:
    out = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    for a, b in C.COMPOUNDS:
        out = f"regexp_replace({out}, '\\b{a} {b}', '{a}{b}', 'g')"
    return out


def _sql_grams(source: str, key: str, name: str) -> str:
    return f"{name}_g as (select {key}, substring(' '||{key}||' ', i::int, 3) as gram, count(*) as n from (select distinct {key} from {source}), generate_series(1, 60) s(i) where i <= length({key}) and length({key}) > 0 group by all), {name} as (select *, sqrt(sum(n*n) over (partition by {key})) as norm from {name}_g)"


def _near(terms: str, least: float) -> str:
    return f"""{_sql_grams(terms, 'clean', 'ta')}, {_sql_grams('lex', 'surface', 'tb')},
dots as (select clean, surface, round(sum(ta.n*tb.n)/(first(ta.norm)*first(tb.norm)),4) as score from ta join tb using (gram) group by all),
near as (select clean, surface, score from dots where score >= {least} qualify row_number() over (partition by clean order by score desc, surface)=1)"""


_SINGLE = "case when regexp_matches(clean,'(sh|ch|ss|x)es$') then regexp_replace(clean,'es$','') when regexp_matches(clean,'[^s]s$') then regexp_replace(clean,'s$','') else clean end"
_STAGES = f"""{_N}, {_LEX}, t as (select {_VERB} as term, count(*) as n from n group by 1), c0 as (select term, n, {_clean('term')} as clean from t), c as (select *, {_SINGLE} as single from c0),
miss as (select clean from c where clean not in (select surface from lex) and single not in (select surface from lex)), {_near('miss', 0.5)},
st as (select c.*, case when a.surface is not null then 2 when b.surface is not null then 3 when near.surface is not null then 4 end as stage, coalesce(a.surface,b.surface,near.surface) as surface
 from c left join lex a on a.surface=c.clean left join lex b on b.surface=c.single left join near on near.clean=c.clean), ev as (select st.*, pt, soc from st left join lex using (surface))"""
_PAIRS = f"{_STAGES}, pr as (select post, text, generic as drug, ev.pt as event, ev.soc from n join prod on prod.surface=lower({_TOOK}) join ev on ev.term={_VERB} where ev.pt is not null and not contains(text,'. No '))"
_ALL = C.alternation([r[0] for rows in C.KINDS.values() for r in rows])
_KIND = "kinds as (select * from " + _values([(k, r[0], r[1]) for k, rows in C.KINDS.items() for r in rows], "kind surface concept") + ")"
_SPANS = f"{_N}, {_KIND}, x as (select post, text, unnest(regexp_extract_all(lower(text), '{_ALL}')) as surface from n)"
_EVX = C.alternation([s for s, _, _ in C.EVENTS])
_CONX = C.alternation([s for s, _ in C.CONDITIONS])
_cue = lambda c: f"regexp_matches(lower(text), '{C.CUE[c]}')"
_value = lambda c: f"nullif(regexp_extract(lower(text), '{C.CUE[c]}', 1), '')"
_DE = f"case when not {_cue('stopped')} then 'unknown' when {_cue('resolved')} then 'positive' else 'negative' end"
_RE = f"case when not {_cue('restarted')} then 'unknown' when {_cue('returned')} then 'positive' else 'negative' end"
_CONS = f"list_distinct(list_transform(regexp_extract_all(lower(text), '{_CONX}'), lambda s: case " + " ".join(f"when s='{s}' then '{c}'" for s, c in C.CONDITIONS) + " end))"
_CUES = f"{_cue('onset')} as ct, {_DE}='positive' as cd, {_RE}='positive' as cr, len({_CONS})>0 as cc, {_cue('listed')} as ck"
_SCORE = "round(greatest(0::double, least(1::double, case when ct then 0.35::double else 0 end + case when cd then 0.25::double else 0 end + case when cr then 0.3::double else 0 end + case when cc then -0.2::double else 0 end + case when ck then 0.2::double else 0 end)),2)"
_CATEGORY = "case when ct and cd and cr then 'Certain' when (ct and cd and not cc) or (ck and cd) then 'Probable' when ct or ck then 'Possible' when cc then 'Unlikely' else 'Unassessable' end"
_NEG = C.CUE["negation"]
_START = "instr(lower(text), surface)-1"
_BEFORE = f"substring(lower(text), (greatest({_START}-20,0)+1)::int, least({_START},20)::int)"
_PREG = f"({_cue('pregnancy')} or soc='Congenital')"
ORACLES = {
    "nlp03_entities": f"with {_SPANS} select kind, x.surface, count(*) as n, sum({_START.replace('surface', 'x.surface')})::bigint as starts from x join kinds using (surface) group by all",
    "nlp05_products": f"with {_N}, {_LEX} select taken, count(*) as n, generic, class from (select {_TOOK} as taken from n) left join prod on surface=lower(taken) group by all",
    "nlp06_events": f"with {_STAGES} select term, clean, stage, pt, soc, n from ev",
    "nlp08_collapsed": f"with {_STAGES} select pt, count(*) as n_surfaces, sum(n)::bigint as n, array_to_string(list_sort(list_distinct(list(clean))),',') as surfaces from ev where pt is not null group by 1",
    "nlp11_layman": f"with {_N}, {_LEX}, t as (select distinct {_clean(_VERB)} as clean from n), miss as (select clean from t where clean not in (select surface from lex)), {_near('miss', 0.4)} select * from near",
    "joi20_rollup": f"with {_PAIRS}, cl as (select distinct generic, class from prod) select class, soc, count(distinct post) as posts, count(distinct drug) as drugs from pr join cl on cl.generic=pr.drug group by all",
    "nlp14_window_negation": f"with {_N}, x as (select text, unnest(regexp_extract_all(lower(text), '{_EVX}')) as surface from n) select surface, count(*) as n, count(*) filter (where regexp_matches({_BEFORE}, '{_NEG}')) as negated from x group by 1",
    "nlp09_conditions": f"""with {_N}, {_LEX}, t as (select regexp_extract(text,' with (.+?) took ',1) as term, count(*) as n from n group by 1), c as (select *, {_clean('term')} as clean from t),
e as (select c.*, concept from c left join con on surface=clean),
g as (select e.term, y.concept from e join con y on e.concept is null and left(clean,1)=left(y.surface,1) and levenshtein(clean,y.surface)<=2 qualify row_number() over (partition by e.term order by levenshtein(clean,y.surface), y.surface)=1)
select e.term, coalesce(e.concept,g.concept) as concept, case when e.concept is not null then 'exact' when g.concept is not null then 'fuzzy' end as method, n from e left join g on g.term=e.term""",
    "nlp19_comorbidities": f"with {_N}, x as (select unnest({_CONS}) as condition from n) select condition, count(*) as n from x group by 1",
    "nlp20_features": rf"""with {_N} select case when regexp_matches(lower(text),'\bwoman\b') then 'F' when regexp_matches(lower(text),'\bman\b') then 'M' else 'U' end as sex,
case when {_value('age')}::int<18 then 'child' when {_value('age')}::int>=65 then 'elder' else 'adult' end as bracket, count(*) as n, sum({_value('dose')}::bigint)::bigint as mg, sum({_value('onset')}::bigint)::bigint as days, sum(len({_CONS}))::bigint as conditions from n group by all""",
    "sca14_lots": f"with {_N}, x as (select {_value('lot')} as lot, {_value('ndc')} as ndc, {_value('expiry')} as expiry from n) select *, count(*) as n from x where lot is not null group by all",
    "sta42_challenges": f"with {_N} select {_DE} as dechallenge, {_RE} as rechallenge, count(*) as n from n group by all",
    "sta39_best_causality": f"with {_PAIRS}, q as (select drug, event, post, {_CUES} from pr), r as (select drug, event, {_SCORE} as score, {_CATEGORY} as category, post from q) select * from r qualify row_number() over (partition by drug, event order by score desc, post)=1",
    "sup15_narrative_causality": f"""with {_N}, q as (select *, {_CUES} from n), r as (select {_CATEGORY} as category, (case when ck then 1 else 0 end+case when ct then 2 else 0 end+case when cd then 1 else 0 end+case when cr then 2 else 0 end-case when cc then 1 else 0 end) as points, contains(text,'heart attack') or contains(text,'liver failure') as crit from q)
select category, case when points>=9 then 'Definite' when points>=5 then 'Probable' when points>=1 then 'Possible' else 'Doubtful' end as checklist, case when crit and category in ('Certain','Probable') then 'Critical' when crit then 'High' when category in ('Certain','Probable') then 'Medium' else 'Low' end as severity, count(*) as n, sum(points)::bigint as points from r group by all""",
    "nlp16_gates": f"""with {_N} select regexp_matches(lower(text),'{C.alternation([s for s, _, _ in C.PRODUCTS])}') as product, regexp_matches(lower(text),'{_EVX}') and not regexp_matches(lower(text), '(?:^|[^a-z])(?:no|denies|without) {_EVX[2:]}') as event, {_cue('person')} as person, {_cue('onset')} or {_cue('stopped')} as time, count(*) as n from n group by all""",
    "prd11_pregnancy": f"with {_PAIRS} select drug, soc='Congenital' as congenital, count(*) as n from pr where {_PREG} group by all",
    "len08_pregnancy": f"with {_PAIRS}, bag as (select distinct post, drug, event, soc from pr where {_PREG}), {sql_cells('bag')}, {sql_measures('cells', 'm')} select m.drug, m.event, a, prr, chi_square, strength, congenital from m join (select distinct event, soc='Congenital' as congenital from bag) using (event)",
    "nlp31_closure": f"with {_N}, {_LEX}, al as (select generic, surface as alias from prod union select generic, generic from prod), u as (select lower({_TOOK}) as alias, count(*) as n from n group by 1), c as (select generic, string_agg(alias, ',' order by alias) as aliases from al group by 1) select generic, count(*) as n_used, sum(n)::bigint as n, first(aliases) as aliases from al join u using (alias) join c using (generic) group by 1",
    "prd13_alias_match": f"with {_N}, {_LEX}, al as (select generic, surface as alias from prod union select generic, generic from prod), w(wanted, generic) as (values ('Tylenol','paracetamol'),('humira','adalimumab')) select wanted, alias, count(*) as n from n join al on al.alias=lower({_TOOK}) join w using (generic) group by all",
    "nlp36_facade": f"with {_SPANS} select kind, x.surface, count(distinct post) as posts, concept from x join kinds using (surface) group by all",
    "nlp04_devices": f"with {_SPANS}, {_LEX} select d.concept as device_class, generic, count(*) as n from x join kinds d on d.surface=x.surface and d.kind='device' join x y on y.post=x.post join prod on prod.surface=y.surface group by all",
    "nlp17_hygiene": f"with {_N}, h as (select author, post, posted_at, sha256(regexp_replace(lower(text),'[0-9]+','#','g')) as h from n), g as (select *, coalesce(posted_at-lag(posted_at) over (partition by author, h order by posted_at, post)<=30,false) as again from h) select date_trunc('year',posted_at)::date as year, count(*) as n, count(*) filter (where again) as n_again, count(distinct h) as texts from g group by 1",
}

"""Dictionary matching and term resolution over whole documents, with their SQL.

The dictionary is made of the passages of `benchmark`: runs of two to four words that start at every third word. Its
levels are the run's first two words, its first word, that word's first three letters and first letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import matching, resolver, similarity
from quillon.sources.lexicon import CUES
from quillon.sources.tables import table


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """surface, kind, concept, parent and root."""
    w = table(spark, sf, "benchmark").select(F.split(matching.surface_key(F.col("text")), " ").alias("w")).where(F.size("w") >= 4)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 3, F.lit(3)), lambda i: F.transform(F.array(*map(F.lit, (2, 3, 4))), lambda n: F.slice("w", i, n))))
    x = w.select(F.explode(runs).alias("r")).select(F.array_join("r", " ").alias("surface"), F.array_join(F.slice("r", 1, 2), " ").alias("concept"), F.element_at("r", 1).alias("parent")).distinct()
    return x.withColumn("kind", F.when(F.length("surface") % 2 == 0, "event").otherwise("product")).withColumn("root", F.substring("parent", 1, 1))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return matching.dictionary_spans(table(spark, sf, "documents"), "doc_id", "text", phrases(spark, sf))


def nlp03_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary surfaces in documents, longest first: how often, in how many documents, and the sum of their places."""
    return _spans(spark, sf).groupBy("kind", "surface").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum(F.col("start").cast("long")).alias("starts"), F.sum(F.col("stop").cast("long")).alias("stops"))


def sca16_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """All occurrences, overlapping ones too, by surface length."""
    found = matching.hits(table(spark, sf, "documents"), "doc_id", "text", phrases(spark, sf))
    return found.groupBy("n").agg(F.count("*").alias("hits"), F.countDistinct("surface").alias("surfaces"), F.sum(F.col("start").cast("long")).alias("starts"))


def nlp14_window_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Spans and how many of them are negated, by surface; cues of four languages are a dictionary of their own."""
    cues = spark.createDataFrame([(s, c) for c, surfaces in CUES.items() for s in surfaces], "surface string, cue string")
    spans, found = matching.spans_of_each(table(spark, sf, "documents"), "doc_id", "text", [phrases(spark, sf), cues])
    rows = matching.negated(spans, found, "doc_id")
    return rows.groupBy("surface").agg(F.count("*").alias("n"), F.count_if("negated").alias("negated"))


def joi20_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, concepts and mentions by level: each span counts at its concept, its parent and its root."""
    levels = F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in ("concept", "parent", "root")))
    rows = _spans(spark, sf).select("doc_id", "concept", F.explode(levels).alias("x"))
    return rows.groupBy("x.level", "x.name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("concept").alias("concepts"))


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    return phrases(spark, sf).select(F.col("surface").alias("llt"), F.col("concept").alias("pt"), F.col("parent").alias("hlt"), F.substring("parent", 1, 3).alias("hlgt"), F.col("root").alias("soc"))


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """Everyday wording: a concept's words the other way round."""
    return phrases(spark, sf).select(F.concat_ws(" ", F.element_at(F.split("concept", " "), 2), F.element_at(F.split("concept", " "), 1)).alias("said"), F.col("concept").alias("pt")).distinct()


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """The different clauses of at most six words that documents hold."""
    clauses = table(spark, sf, "documents").select(F.explode(F.split("text", r"[.,\n]")).alias("c")).select(matching.surface_key(F.col("c")).alias("term"))
    return clauses.where("term != ''").where(F.size(F.split("term", " ")) <= 6).distinct()


def nlp32_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of documents brought to the five levels, tier by tier."""
    return resolver.mapped(_terms(spark, sf), _chain(spark, sf), _said(spark, sf))


def nlp32_tree(spark: SparkSession, sf: str) -> DataFrame:
    return resolver.tree(_chain(spark, sf))


def nlp10_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of documents by exact match, spelling and grams, ranked by likeness and relevance."""
    return resolver.hybrid(_terms(spark, sf), _chain(spark, sf), _said(spark, sf)).where("llt is not null")


def nlp27_terminology(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of documents by wording, exact match, grams and spelling."""
    return resolver.terminology(_terms(spark, sf), _chain(spark, sf), _said(spark, sf)).where("method != 'unmatched'")


def joi18_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest word of the benchmark, within two edits, of each different word of conversations."""
    words = lambda name: table(spark, sf, name).select(F.explode(F.split(matching.surface_key(F.col("text")), " ")).alias("w")).where("w != ''").distinct()
    pairs = similarity.edit_join(words("conversations").withColumnRenamed("w", "a"), words("benchmark").withColumnRenamed("w", "b"), 2)
    best = pairs.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m"))
    return best.select(F.col("a").alias("term"), F.col("m.b").alias("entry"), F.col("m.distance").alias("distance"))


QUERIES = {f.__name__: f for f in [nlp03_entities, sca16_overlapping, nlp14_window_negation, joi20_rollup, nlp32_chain, nlp32_tree, nlp10_hybrid, nlp27_terminology, joi18_fuzzy]}

_KEY = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_PHRASES = f"""bw as (select string_split({_KEY.format("text")}, ' ') as w from benchmark), br as (select w[i:i+k-1] as r from (select w, unnest(generate_series(1, len(w)-3, 3)) as i from bw where len(w) >= 4), (values (2),(3),(4)) v(k)),
ph as (select *, case when length(surface)%2=0 then 'event' else 'product' end as kind, parent[1] as root from (select distinct array_to_string(r,' ') as surface, array_to_string(r[1:2],' ') as concept, r[1] as parent from br))"""


def _hits(name: str, terms: str, longest: int) -> str:
    """SQL of the longest-first spans of a table of surfaces in documents, n words each, as {name}."""
    lead = lambda k: "||' '||".join(["word", *(f"lead(word,{j}) over w" for j in range(1, k))])
    runs = " union all ".join(f"select doc_id, i, {k} as n, start, lead(stop,{k - 1}) over w as stop, {lead(k)} as surface from tk window w as (partition by doc_id order by i)" for k in range(1, longest + 1))
    return rf"""{name}_pc as (select doc_id, unnest(regexp_extract_all(lower(text), '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+')) as p, unnest(range(len(regexp_extract_all(lower(text), '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+')))) as i from documents),
{name}_w as (select doc_id, i, regexp_extract(p, '[\p{{L}}\p{{N}}]+$') as word, sum(length(p)) over (partition by doc_id order by i) as stop from {name}_pc), {name}_t as (select *, stop-length(word) as start from {name}_w),
{name}_hit as (select x.* from ({runs.replace(" tk ", f" {name}_t ")}) x where surface in (select surface from {terms})), {name}_top as (select * from {name}_hit qualify n = max(n) over (partition by doc_id, i)),
{name}_to as (select a.*, b.i as nxt from {name}_top a asof left join {name}_top b on a.doc_id=b.doc_id and a.i+a.n <= b.i), {name}_scan as (select * from {name}_to qualify i = min(i) over (partition by doc_id) union all select t.* from {name}_scan s join {name}_to t on t.doc_id=s.doc_id and t.i=s.nxt),
{name} as (select doc_id, i, n, start, stop, surface from {name}_scan)"""


_FOUND = f"{_PHRASES}, {_hits('sp', 'ph', 4)}"
_CUES = "cu as (select * from (values " + ",".join(f"('{s}','{c}')" for c, surfaces in CUES.items() for s in surfaces) + ") v(surface, cue))"
_CHAIN = "ch as (select surface as llt, concept as pt, parent as hlt, left(parent,3) as hlgt, root as soc from ph), sd as (select string_split(concept,' ')[2]||' '||string_split(concept,' ')[1] as said, min(concept) as pt from ph group by 1), pts as (select pt as pt_key, min(struct_pack(llt:=llt, pt:=pt, hlt:=hlt, hlgt:=hlgt, soc:=soc)) as c from ch group by 1)"
_TERMS = f"tm as (select distinct term from (select {_KEY.format('c')} as term from (select unnest(regexp_split_to_array(text, '[.,\\n]')) as c from documents)) where term <> '' and len(string_split(term,' ')) <= 6)"
_WORDS = "list_distinct(list_filter(string_split({},' '), lambda w: length(w) >= 3))"
_SORTED = "array_to_string(list_sort(string_split({},' ')),' ')"
#: DuckDB's edit distance counts bytes; letters of the texts beyond ASCII become one each.
_ASCII = "translate({}, 'äöüßéèêçàíóáúñ', 'ABCDEFGHIJKLMNO')"
_DISTANCE = f"levenshtein({_ASCII.format('{a}')}, {_ASCII.format('{b}')})"
_RATIO = f"(1-{_DISTANCE.format(a='a', b='b')}::double/greatest(length(a),length(b)))"
_SPELT = f"""la as (select llt, {_SORTED.format('llt')} as b from ch), ta as (select term, {_SORTED.format('term')} as a from {{src}}),
spell as (select term, llt, round({_RATIO},4) as similarity from ta join la on abs(length(a)-length(b)) <= {{gap}}*greatest(length(a),length(b)) and {_RATIO} >= {{least}}-1e-9)"""
#: Grams that tell equal ones apart, as a list of 'gram#k'.
_GRAMS = "(select {key} as k, list(g||'#'||c) as gs from (select {key}, g, row_number() over (partition by {key}, g order by i) as c from (select {key}, i, substring('^^'||{key}||'$$', i::int, 3) as g from {src}, generate_series(1, 400) s(i) where i <= length({key})+2)) group by 1)"
_LIKE = f"""ga as {_GRAMS.format(key='term', src='{src}')}, gb as {_GRAMS.format(key='llt', src='(select distinct llt from ch)')}, ua as (select k, unnest(gs) as g, len(gs) as n from ga), ub as (select k, unnest(gs) as g, len(gs) as n from gb),
like_ as (select ua.k as term, ub.k as llt, count(*)/sqrt((any_value(ua.n)*any_value(ub.n))::double) as cosine from ua join ub using (g) group by 1, 2 having cosine >= {{least}}-1e-9)"""
ORACLES = {
    "nlp03_entities": f"with recursive {_FOUND} select kind, surface, count(*) as n, count(distinct doc_id) as docs, sum(start)::bigint as starts, sum(stop)::bigint as stops from sp join ph using (surface) group by 1, 2",
    "sca16_overlapping": f"with recursive {_FOUND} select n, count(*) as hits, count(distinct surface) as surfaces, sum(start)::bigint as starts from sp_hit group by 1",
    "nlp14_window_negation": f"""with recursive {_FOUND}, {_CUES}, {_hits('cs', 'cu', 3)}, cc as (select doc_id, i+n-1 as i, cue from cs join cu using (surface)),
j as (select sp.doc_id, sp.i, surface, max(cc.i) filter (where cue='trigger') as t, max(cc.i) filter (where cue='terminator') as z, max(cc.i) filter (where cue='pseudo') as p from sp left join cc on cc.doc_id=sp.doc_id and cc.i between sp.i-6 and sp.i-1 group by 1, 2, 3)
select surface, count(*) as n, count(*) filter (where coalesce(t,-1) > coalesce(z,-1) and p is null) as negated from j group by 1""",
    "joi20_rollup": f"with recursive {_FOUND}, x as (select doc_id, concept, unnest([struct_pack(level:='concept',name:=concept), struct_pack(level:='parent',name:=parent), struct_pack(level:='root',name:=root)]) as x from sp join ph using (surface)) select x.level as level, x.name as name, count(*) as n, count(distinct doc_id) as docs, count(distinct concept) as concepts from x group by 1, 2",
    "nlp32_chain": f"""with {_PHRASES}, {_CHAIN}, {_TERMS}, a as (select term, ch.llt as x, p.c as y, sd.pt as s, q.c as z from tm left join ch on ch.llt=term left join pts p on p.pt_key=term left join sd on sd.said=term left join pts q on q.pt_key=sd.pt),
o as (select term from a where x is null and y is null and s is null), ins as (select term, llt from o join ch on length(llt) >= 5 and contains(term, llt) qualify row_number() over (partition by term order by length(llt) desc, llt)=1),
w as (select term, {_WORDS.format('term')} as ws from o where term not in (select term from ins)), v as (select llt, {_WORDS.format('llt')} as ls from ch where len({_WORDS.format('llt')}) >= 2),
sub as (select term, llt from w join v on len(ws) >= 2 and list_has_all(ws, ls) qualify row_number() over (partition by term order by len(ls) desc, llt)=1),
r as (select a.term, case when x is not null then 'llt_exact' when y is not null then 'pt_exact' when s is not null then 'pt_via_map' when ins.llt is not null then 'llt_substring' when sub.llt is not null then 'llt_token_subset' else 'unmatched' end as method,
 case when x is not null then x when y is not null or s is not null then a.term else coalesce(ins.llt, sub.llt) end as llt, case when x is null then coalesce(y, z) end as c, coalesce(x, ins.llt, sub.llt) as l from a left join ins using (term) left join sub using (term))
select r.term, r.llt, coalesce(ch.pt, c.pt) as pt, coalesce(ch.hlt, c.hlt) as hlt, coalesce(ch.hlgt, c.hlgt) as hlgt, coalesce(ch.soc, c.soc) as soc, method,
 case method when 'llt_exact' then 0.95::double when 'pt_exact' then 0.92::double when 'pt_via_map' then 0.85::double when 'llt_substring' then 0.6::double when 'llt_token_subset' then 0.5::double else 0::double end as confidence from r left join ch on ch.llt=r.l""",
    "nlp32_tree": f"with {_PHRASES}, {_CHAIN} " + " union all ".join(f"select '{c}' as level, {c} as name, {u} as parent, count(distinct llt) as n_llts from ch group by all" for c, u in (("pt", "hlt"), ("hlt", "hlgt"), ("hlgt", "soc"), ("soc", "null::varchar"))),
    "nlp10_hybrid": f"""with {_PHRASES}, {_CHAIN}, {_TERMS}, k as (select term, case when ch.llt is not null then term else coalesce(p.c.llt, q.c.llt) end as llt from tm left join ch on ch.llt=term left join pts p on p.pt_key=term left join sd on sd.said=term left join pts q on q.pt_key=sd.pt),
j as (select *, case when term in ({','.join(f"'{f}'" for f in resolver.FILLERS)}) then 0.02::double when llt is not null then 0.85::double when not contains(term,' ') and regexp_matches(term,'(ed|ing)$') then 0.15::double else 0.4::double end as relevance from k), jj as (select * from j where relevance >= 0.35),
{_SPELT.format(src='jj', gap='0.15', least='0.85')}, un as (select term from jj where term not in (select term from spell)), {_LIKE.format(src='un', least='0.85')},
e as (select term, llt, 1 as stp, 1.0::double as similarity from jj where llt is not null union all select term, llt, 2, similarity from spell union all select term, llt, 3, round(cosine,4) from like_), f as (select e.*, relevance, round(0.6::double*similarity+0.4::double*relevance,4) as rank from e join jj using (term)),
b as (select * from f where rank >= 0.35 qualify row_number() over (partition by term order by rank desc, stp, llt)=1) select b.term, b.llt, pt, soc, ['exact','spelling','grams'][stp] as stage, similarity, relevance, rank from b join ch using (llt)""",
    "nlp27_terminology": f"""with {_PHRASES}, {_CHAIN}, {_TERMS}, v as (select term, q.c.llt as llt from tm join sd on sd.said=term join pts q on q.pt_key=sd.pt), x as (select term from tm where term in (select llt from ch) and term not in (select term from v)),
un as (select term from tm where term not in (select term from v) and term not in (select term from x)), {_LIKE.format(src='un', least='0.7')}, near as (select term, llt, round(cosine,4) as similarity from like_ qualify row_number() over (partition by term order by round(cosine,4) desc, llt)=1),
un2 as (select term from un where term not in (select term from near)), {_SPELT.format(src='un2', gap='0.2', least='0.8')}, sb as (select * from spell qualify row_number() over (partition by term order by similarity desc, llt)=1),
f as (select term, llt, 'vernacular' as method, 0.99::double as similarity from v union all select term, term, 'llt_exact', 1.0::double from x union all select term, llt, 'grams', similarity from near union all select term, llt, 'spelling', similarity from sb) select term, llt, pt, soc, method, similarity from f join ch using (llt)""",
    "joi18_fuzzy": f"""with c as (select distinct w as term from (select unnest(string_split({_KEY.format("text")},' ')) as w from conversations) where w <> ''), b as (select distinct w as entry from (select unnest(string_split({_KEY.format("text")},' ')) as w from benchmark) where w <> '')
select term, entry, {_DISTANCE.format(a='term', b='entry')}::int as distance from c join b on abs(length(term)-length(entry)) <= 2 and {_DISTANCE.format(a='term', b='entry')} <= 2 qualify row_number() over (partition by term order by {_DISTANCE.format(a='term', b='entry')}, entry)=1""",
}

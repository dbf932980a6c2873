"""Tiered resolution of event wording to a terminology of five levels, each tier a join of different terms.

chain: llt, pt, hlt, hlgt, soc, a row per lowest-level term. said: said, pt (everyday wording). Terms are compared by
their words alone (lower case, single blanks). A tier sees only what the tiers before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.tables import materialised

from .matching import surface_key
from .similarity import containing, cosine_join, holding_all, ratio_join

LEVELS = ["pt", "hlt", "hlgt", "soc"]
#: Confidence of each tier of mapped(); fixed values.
CONFIDENCE = {"llt_exact": 0.95, "pt_exact": 0.92, "pt_via_map": 0.85, "llt_substring": 0.6, "llt_token_subset": 0.5, "unmatched": 0.0}
#: Least likeness by spelling and by grams, and least rank, of hybrid(); fixed values.
SPELLING, GRAMS, LEAST_RANK = 0.85, 0.85, 0.35
#: Least likeness by grams (which stand for a dense encoder) and by spelling of terminology().
FLOOR, FUZZY = 0.7, 0.8
#: Words of talk, not of illness.
FILLERS = ["ask", "asked", "call", "called", "came", "come", "get", "go", "got", "help", "made", "make", "need", "please", "post", "posted", "read", "said", "say", "share", "take", "tell", "thanks", "think", "took", "try", "want", "went", "write"]
#: Shortest term that is looked for inside others, shortest word that counts.
_SHORT_TERM, _SHORT_WORD = 5, 3


def _keyed(terms: DataFrame) -> DataFrame:
    return materialised(terms.select("term").distinct().withColumn("key", surface_key(F.coalesce("term", F.lit("")))), "terms")


def _chain(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per lowest-level term, and one per preferred term (that of least llt)."""
    clean = chain.withColumn("llt", surface_key(F.col("llt"))).where("llt != ''")
    llts = materialised(clean.groupBy("llt").agg(F.min(F.struct(*LEVELS)).alias("c")).select("llt", "c.*"), "llts")
    pts = clean.groupBy(surface_key(F.col("pt")).alias("pt_key")).agg(F.min(F.struct("llt", *LEVELS)).alias("c")).select("pt_key", "c.*")
    return llts, pts


def _said(said: DataFrame) -> DataFrame:
    return said.groupBy(surface_key(F.col("said")).alias("key")).agg(F.min("pt").alias("said_pt"))


def mapped(terms: DataFrame, chain: DataFrame, said: DataFrame) -> DataFrame:
    """term, llt, pt, hlt, hlgt, soc, method and confidence of each different term.

    In order: an llt; a pt; everyday wording of a pt (with its chain if there is one, else the pt alone); the longest llt
    of five or more characters inside the term; the llt of most words (two or more, of three or more letters) that all
    stand in the term; of equals the least. Null and empty terms are unmatched."""
    t, (llts, pts) = _keyed(terms), _chain(chain)
    first = t.join(llts.select(F.col("llt").alias("key"), F.struct("llt", *LEVELS).alias("x")), "key", "left")
    second = first.join(pts.select(F.col("pt_key").alias("key"), F.struct(F.col("pt_key").alias("llt"), *LEVELS).alias("y")), "key", "left")
    by_pt = pts.select(F.col("pt_key"), F.struct(*LEVELS).alias("z"))
    third = second.join(_said(said), "key", "left").withColumn("pt_key", surface_key(F.col("said_pt"))).join(by_pt, "pt_key", "left")
    wording = F.when(F.col("said_pt").isNotNull(), F.struct(F.col("key").alias("llt"), *(F.coalesce(F.col(f"z.{c}"), F.col("said_pt") if c == "pt" else F.lit(None)).alias(c) for c in LEVELS)))
    method = F.when(F.col("x").isNotNull(), "llt_exact").when(F.col("y").isNotNull(), "pt_exact").when(F.col("said_pt").isNotNull(), "pt_via_map")
    rows = third.select("term", "key", F.coalesce("x", "y", wording).alias("c"), method.alias("method"))
    open_ = materialised(rows.where("method is null").select("key").distinct(), "open")
    inside = containing(open_.select(F.col("key").alias("a")), llts.select(F.col("llt").alias("b")), _SHORT_TERM)
    inside = inside.groupBy("a").agg(F.min_by("b", F.struct(-F.length("b"), F.col("b"))).alias("llt"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= _SHORT_WORD))
    left = open_.join(inside.select(F.col("a").alias("key")), "key", "left_anti").select(F.col("key").alias("a"), words(F.col("key")).alias("words"))
    asked = llts.select(F.col("llt").alias("b"), words(F.col("llt")).alias("words")).where(F.size("words") >= 2)
    subset = holding_all(left.where(F.size("words") >= 2), asked).groupBy("a").agg(F.min_by("b", F.struct(-F.size(words(F.col("b"))), F.col("b"))).alias("llt"))
    loose = inside.withColumn("how", F.lit("llt_substring")).unionByName(subset.withColumn("how", F.lit("llt_token_subset")))
    loose = loose.join(llts, "llt").select(F.col("a").alias("key"), "how", F.struct("llt", *LEVELS).alias("d"))
    out = rows.join(loose, "key", "left").withColumn("method", F.coalesce("method", "how", F.lit("unmatched"))).withColumn("c", F.coalesce("c", "d"))
    confidence = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("method")]
    return out.select("term", F.col("c.llt").alias("llt"), *(F.col(f"c.{c}").alias(c) for c in LEVELS), "method", confidence.alias("confidence"))


def _sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def _spelling(keys: DataFrame, llts: DataFrame, least: float) -> DataFrame:
    """(key, llt, similarity): edit ratio with the words in order of the alphabet."""
    a, b = keys.where("key != ''").withColumn("a", _sorted_words(F.col("key"))), llts.select("llt", _sorted_words(F.col("llt")).alias("b"))
    pairs = ratio_join(a, b, least)
    return pairs.join(a, "a").join(b, "b").select("key", "llt", F.round("ratio", 4).alias("similarity"))


def _likeness(keys: DataFrame, llts: DataFrame, least: float) -> DataFrame:
    pairs = cosine_join(keys.where("key != ''").select(F.col("key").alias("a")), llts.select(F.col("llt").alias("b")), least)
    return pairs.select(F.col("a").alias("key"), F.col("b").alias("llt"), F.round("cosine", 4).alias("similarity"))


def hybrid(terms: DataFrame, chain: DataFrame, said: DataFrame) -> DataFrame:
    """term, llt, pt, soc, stage, similarity, relevance and rank of each different term's best candidate; null without.

    Candidates: exact (an llt, a pt or everyday wording), by spelling, and by grams for terms that spelling leaves. Rank
    is 0.6 of the similarity and 0.4 of the term's relevance: words of talk 0.02, known wording 0.85, a single unknown
    word in -ed or -ing 0.15, else 0.4; terms and candidates below LEAST_RANK are discarded. Of equal ranks the earlier
    stage, then the least llt."""
    t, (llts, pts) = _keyed(terms), _chain(chain)
    keys = t.select("key").distinct()
    known = keys.join(llts.select(F.col("llt").alias("key"), F.lit(1).alias("x")), "key", "left").join(pts.select(F.col("pt_key").alias("key"), F.col("llt").alias("y")), "key", "left")
    known = known.join(_said(said).withColumn("pt_key", surface_key(F.col("said_pt"))).join(pts.select("pt_key", F.col("llt").alias("z")), "pt_key").select("key", "z"), "key", "left")
    known = known.select("key", F.when(F.col("x").isNotNull(), F.col("key")).otherwise(F.coalesce("y", "z")).alias("llt"))
    talk = F.col("key").isin(FILLERS) | (F.col("key") == "")
    verb = ~F.col("key").contains(" ") & F.col("key").rlike("(ed|ing)$")
    relevance = F.when(talk, 0.02).when(F.col("llt").isNotNull(), 0.85).when(verb, 0.15).otherwise(0.4)
    judged = known.withColumn("relevance", relevance).where(F.col("relevance") >= LEAST_RANK)
    exact = judged.where("llt is not null").select("key", "llt", F.lit(1).alias("at"), F.lit(1.0).alias("similarity"))
    spelt = materialised(_spelling(judged.select("key"), llts, SPELLING), "spelt").withColumn("at", F.lit(2))
    rest = judged.select("key").join(spelt.select("key").distinct(), "key", "left_anti")
    near = _likeness(rest, llts, GRAMS).withColumn("at", F.lit(3))
    every = exact.unionByName(spelt).unionByName(near).join(judged.select("key", "relevance"), "key")
    every = every.withColumn("rank", F.round(0.6 * F.col("similarity") + 0.4 * F.col("relevance"), 4)).where(F.col("rank") >= LEAST_RANK)
    best = every.groupBy("key").agg(F.min_by(F.struct("llt", "at", "similarity", "relevance", "rank"), F.struct(-F.col("rank"), F.col("at"), F.col("llt"))).alias("b")).select("key", "b.*")
    stage = F.element_at(F.array(*map(F.lit, ("exact", "spelling", "grams"))), F.col("at"))
    best = best.join(llts, "llt").select("key", "llt", "pt", "soc", stage.alias("stage"), "similarity", "relevance", "rank")
    return t.join(best, "key", "left").drop("key")


def terminology(terms: DataFrame, chain: DataFrame, said: DataFrame) -> DataFrame:
    """term, llt, pt, soc, method and similarity of each different term: everyday wording (0.99), an llt (1.0), the llt of
    nearest grams from FLOOR on, the nearest by spelling from FUZZY on; else unmatched. Of equals the least llt."""
    t, (llts, pts) = _keyed(terms), _chain(chain)
    keys = t.select("key").distinct().where("key != ''")
    vernacular = keys.join(_said(said), "key").withColumn("pt_key", surface_key(F.col("said_pt"))).join(pts, "pt_key").select("key", "llt", F.lit("vernacular").alias("method"), F.lit(0.99).alias("similarity"))
    rest = keys.join(vernacular.select("key"), "key", "left_anti")
    exact = rest.join(llts.select(F.col("llt").alias("key")), "key", "left_semi").select("key", F.col("key").alias("llt"), F.lit("llt_exact").alias("method"), F.lit(1.0).alias("similarity"))
    rest = rest.join(exact.select("key"), "key", "left_anti")
    best = lambda df, how: df.groupBy("key").agg(F.min_by(F.struct("llt", "similarity"), F.struct(-F.col("similarity"), F.col("llt"))).alias("b")).select("key", "b.llt", F.lit(how).alias("method"), "b.similarity")
    near = materialised(best(_likeness(rest, llts, FLOOR), "grams"), "near")
    rest = rest.join(near.select("key"), "key", "left_anti")
    found = vernacular.unionByName(exact).unionByName(near).unionByName(best(_spelling(rest, llts, FUZZY), "spelling")).join(llts.select("llt", "pt", "soc"), "llt")
    return t.join(found, "key", "left").select("term", "llt", "pt", "soc", F.coalesce("method", F.lit("unmatched")).alias("method"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def tree(chain: DataFrame) -> DataFrame:
    """level, name, parent, n_llts: the terminology's tree, a row per node, by one pass over four grouping levels."""
    up = {"pt": "hlt", "hlt": "hlgt", "hlgt": "soc"}
    nodes = F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("name"), (F.col(up[c]) if c in up else F.lit(None).cast("string")).alias("parent")) for c in LEVELS))
    return chain.select(F.explode(nodes).alias("x"), "llt").groupBy("x.level", "x.name", "x.parent").agg(F.countDistinct("llt").alias("n_llts"))


"""Clinical text operators over small dictionaries: spans, normalisation in stages, linking, features, causality.

The dictionaries are tables of this library (a few dozen rows, so they are broadcast); callers may pass their own of
the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (surface, generic name, class code)
PRODUCTS = [
    ("acetaminophen", "paracetamol", "N02BE"), ("adalimumab", "adalimumab", "L04AB"), ("advil", "ibuprofen", "M01AE"), ("atorvastatin", "atorvastatin", "C10AA"), ("brufen", "ibuprofen", "M01AE"),
    ("flu vaccine", "influenza vaccine", "J07BB"), ("glucophage", "metformin", "A10BA"), ("humira", "adalimumab", "L04AB"), ("ibuprofen", "ibuprofen", "M01AE"), ("influenza vaccine", "influenza vaccine", "J07BB"),
    ("lipitor", "atorvastatin", "C10AA"), ("metformin", "metformin", "A10BA"), ("paracetamol", "paracetamol", "N02BE"), ("tylenol", "paracetamol", "N02BE"), ("warfarin", "warfarin", "B01AA"),
]
#: (surface, preferred term, organ system)
EVENTS = [
    ("chest pain", "Chest pain", "Cardiac"), ("cleft palate", "Cleft palate", "Congenital"), ("could not sleep", "Insomnia", "Psychiatric"), ("dizziness", "Dizziness", "Nervous"), ("dizzy", "Dizziness", "Nervous"),
    ("headache", "Headache", "Nervous"), ("heart attack", "Myocardial infarction", "Cardiac"), ("hives", "Urticaria", "Skin"), ("insomnia", "Insomnia", "Psychiatric"), ("liver failure", "Hepatic failure", "Hepatobiliary"),
    ("nosebleed", "Epistaxis", "Respiratory"), ("puking", "Vomiting", "Gastrointestinal"), ("rash", "Rash", "Skin"), ("threw up", "Vomiting", "Gastrointestinal"), ("vomiting", "Vomiting", "Gastrointestinal"),
]
#: (surface, condition)
CONDITIONS = [
    ("asthma", "Asthma"), ("diabetes", "Diabetes mellitus"), ("diabetes type 2", "Type 2 diabetes mellitus"), ("epilepsy", "Epilepsy"), ("high blood pressure", "Hypertension"), ("hypertension", "Hypertension"), ("migraine", "Migraine"),
]
#: (surface, device class)
DEVICES = [("glucose meter", "Glucose analyser"), ("insulin pen", "Injector"), ("insulin pump", "Infusion pump"), ("pacemaker", "Implantable pulse generator")]
#: Compounds that are written apart.
COMPOUNDS = [("head", "ache"), ("nose", "bleed")]
KINDS = {"condition": CONDITIONS, "device": DEVICES, "event": EVENTS, "product": PRODUCTS}


def dictionary(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A dictionary as a table to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split())))


def alternation(surfaces: list[str]) -> str:
    """A pattern of whole surfaces, longest first, so that the longest of several at one place is found."""
    return r"\b(?:" + "|".join(sorted(surfaces, key=lambda s: (-len(s), s))) + r")\b"


def spans(text: Column, surfaces: list[str]) -> Column:
    """Array of (surface, start), start from 0, of the surfaces found in a text in order, case aside."""
    low, pattern = F.lower(text), alternation(surfaces)
    found, between = F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), F.split(low, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<surface:string,start:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["before"])
        return F.struct((at + F.length(x["surface"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["surface"].alias("surface"), at.alias("start")))).alias("out"))

    steps = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda s, b: F.struct(s.alias("surface"), b.alias("before")))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def entities(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, surface, start) of all dictionary surfaces in texts."""
    kinds = F.create_map(*(F.lit(x) for kind, rows in KINDS.items() for row in rows for x in (row[0], kind)))
    everything = [row[0] for rows in KINDS.values() for row in rows]
    rows = texts.select(key, F.explode(spans(F.col(text), everything)).alias("s"))
    return rows.select(key, kinds[F.col("s.surface")].alias("kind"), "s.surface", "s.start")


def sanitised(term: Column) -> Column:
    """Lower case, letters, digits and single blanks alone, compounds stitched together."""
    clean = F.trim(F.regexp_replace(F.lower(term), "[^a-z0-9]+", " "))
    for a, b in COMPOUNDS:
        clean = F.regexp_replace(clean, rf"\b{a} {b}", a + b)
    return clean


def singular(term: Column) -> Column:
    """A plural's singular by its ending."""
    return F.when(term.rlike("(sh|ch|ss|x)es$"), F.regexp_replace(term, "es$", "")).when(term.rlike("[^s]s$"), F.regexp_replace(term, "s$", "")).otherwise(term)


def _grams(df: DataFrame, key: str) -> DataFrame:
    """(key, gram, n, norm) of the character trigrams of a column's different values."""
    padded = F.concat(F.lit(" "), F.col(key), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    rows = df.select(key).distinct().where(F.length(key) > 0).select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"{key}_norm"))
    return rows.join(norm, key)


def nearest_by_grams(terms: DataFrame, term: str, entries: DataFrame, entry: str, least: float) -> DataFrame:
    """The entry of largest trigram cosine of each different term, if it reaches `least`; found by an equi-join on
    trigrams, the entry of least name among equals."""
    a, b = _grams(terms, term), _grams(entries, entry).withColumnRenamed("n", "m")
    dots = a.join(F.broadcast(b), "gram").groupBy(term, entry).agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.first(f"{term}_norm").alias("x"), F.first(f"{entry}_norm").alias("y"))
    scored = dots.select(term, entry, F.round(F.col("dot") / (F.col("x") * F.col("y")), 4).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy(term).agg(F.min_by(F.struct(entry, "score"), F.struct(-F.col("score"), F.col(entry))).alias("b"))
    return best.select(term, f"b.{entry}", "b.score")


def normalised_events(terms: DataFrame, least: float = 0.5) -> DataFrame:
    """term, clean, stage, pt, soc and score of each different term: 2 the clean term is a surface, 3 its singular is,
    4 its trigrams are near one; null where nothing is."""
    spark = terms.sparkSession
    lexicon = dictionary(spark, EVENTS, "surface pt soc")
    rows = terms.select("term").distinct().withColumn("clean", sanitised(F.col("term"))).withColumn("single", singular(F.col("clean")))
    exact = lexicon.select(F.col("surface").alias("clean"), F.col("surface").alias("s2"))
    folded = lexicon.select(F.col("surface").alias("single"), F.col("surface").alias("s3"))
    rows = rows.join(F.broadcast(exact), "clean", "left").join(F.broadcast(folded), "single", "left")
    near = nearest_by_grams(rows.where("s2 is null and s3 is null"), "clean", lexicon, "surface", least).withColumnRenamed("surface", "s4")
    rows = rows.join(near, "clean", "left")
    stage = F.when(F.col("s2").isNotNull(), 2).when(F.col("s3").isNotNull(), 3).when(F.col("s4").isNotNull(), 4)
    rows = rows.withColumn("surface", F.coalesce("s2", "s3", "s4")).withColumn("stage", stage)
    return rows.join(lexicon, "surface", "left").select("term", "clean", "stage", "pt", "soc", "score")


def canonical_product(product: Column) -> Column:
    """The generic name of a product's name or brand; null for what is none."""
    return F.create_map(*(F.lit(x) for s, g, _ in PRODUCTS for x in (s, g)))[F.lower(F.trim(product))]


def product_class(generic: Column) -> Column:
    return F.create_map(*(F.lit(x) for g, c in sorted({(g, c) for _, g, c in PRODUCTS}) for x in (g, c)))[generic]


def aliases(spark: SparkSession) -> DataFrame:
    """(generic, alias): the names of a product's concept, its own among them."""
    rows = spark.createDataFrame(PRODUCTS, "alias string, generic string, class string")
    return rows.select("generic", "alias").union(rows.select("generic", F.col("generic"))).distinct()


def linked(terms: DataFrame, least: int = 2) -> DataFrame:
    """term, concept and method of each different term against conditions: its surface, or the nearest surface within
    `least` edits (of the same first letter), the least name among equals; null where none is."""
    lexicon = dictionary(terms.sparkSession, CONDITIONS, "surface concept")
    rows = terms.select("term").distinct().withColumn("clean", sanitised(F.col("term")))
    exact = rows.join(lexicon, rows.clean == lexicon.surface).select("term", "concept", F.lit("exact").alias("method"))
    rest = rows.join(exact.select("term"), "term", "left_anti")
    near = rest.join(lexicon, F.substring("clean", 1, 1) == F.substring("surface", 1, 1)).withColumn("d", F.levenshtein("clean", "surface")).where(F.col("d") <= least)
    near = near.groupBy("term").agg(F.min_by("concept", F.struct("d", "surface")).alias("concept")).withColumn("method", F.lit("fuzzy"))
    found = exact.unionByName(near)
    return rows.select("term").join(found, "term", "left")


def contained_conditions(text: Column) -> Column:
    """Conditions of which a text holds a surface; a surface within a longer one that it holds as well does not count."""
    found = F.regexp_extract_all(F.lower(text), F.lit(alternation([s for s, _ in CONDITIONS])), F.lit(0))
    concepts = F.create_map(*(F.lit(x) for row in CONDITIONS for x in row))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: concepts[s])))


#: Cues, as patterns over lower-case text.
CUE = {
    "negation": r"(?:^|[^a-z])(?:no|denies|without) $",
    "stopped": r"stopped (?:it|the drug)",
    "resolved": r"(?:resolved|went away)",
    "restarted": r"restarted",
    "returned": r"came back",
    "pregnancy": r"\b(?:pregnan|trimester|expecting)",
    "listed": r"listed on the label",
    "onset": r"after ([0-9]+) days?",
    "lot": r"\blot ([a-z]{2}[0-9]{4})\b",
    "ndc": r"\bndc ([0-9]{5}-[0-9]{3}-[0-9]{2})\b",
    "expiry": r"\bexp ([0-9]{2}/[0-9]{4})\b",
    "age": r"\b([0-9]{1,3}) years old",
    "dose": r"\b([0-9]+) mg\b",
    "person": r"\b(?:woman|man|i|my)\b",
}


def has(text: Column, cue: str) -> Column:
    return F.lower(text).rlike(CUE[cue])


def cue_value(text: Column, cue: str) -> Column:
    """The first value that follows a cue; null without one."""
    return F.nullif(F.regexp_extract(F.lower(text), CUE[cue], 1), F.lit(""))


def negated_before(text: Column, start: Column, reach: int = 20) -> Column:
    """Whether a negation ends right before a span, looked for in the `reach` characters before it."""
    low = F.lower(text)
    return F.substring(low, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach))).rlike(CUE["negation"])


def dechallenge(text: Column) -> Column:
    """positive where the event resolved after the drug was stopped, negative where it did not, else unknown."""
    return F.when(~has(text, "stopped"), "unknown").when(has(text, "resolved"), "positive").otherwise("negative")


def rechallenge(text: Column) -> Column:
    return F.when(~has(text, "restarted"), "unknown").when(has(text, "returned"), "positive").otherwise("negative")


def narrative_cues(text: Column) -> dict[str, Column]:
    """The six cues of the causality score, from a text alone."""
    conditions = F.size(contained_conditions(text)) > 0
    return {
        "temporal": has(text, "onset"), "dechallenge": dechallenge(text) == "positive", "rechallenge": rechallenge(text) == "positive",
        "confounder": conditions, "known": has(text, "listed"), "prior": F.lit(False),
    }


def naranjo_from_text(text: Column) -> tuple[Column, Column]:
    """Score and category of the checklist items that a text answers: earlier reports, onset after the drug, better
    without it, back with it, other causes."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    score = yes(has(text, "listed"), 1) + yes(has(text, "onset"), 2) + yes(dechallenge(text) == "positive", 1) + yes(rechallenge(text) == "positive", 2) - yes(F.size(contained_conditions(text)) > 0, 1)
    return score, F.when(score >= 9, "Definite").when(score >= 5, "Probable").when(score >= 1, "Possible").otherwise("Doubtful")


def gates(text: Column) -> dict[str, Column]:
    """The four gates of a report: a known product, an event that is not negated, a person, and a time relation."""
    events = spans(text, [s for s, _, _ in EVENTS])
    return {
        "product": F.size(spans(text, [s for s, _, _ in PRODUCTS])) > 0,
        "event": F.exists(events, lambda s: ~negated_before(text, s["start"])),
        "person": has(text, "person"),
        "time": has(text, "onset") | has(text, "stopped"),
    }

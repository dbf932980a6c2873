"""Readers of report feeds: nested JSON, delimited vocabularies, label pairs, FHIR bundles, sectioned notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = "generic_name array<string>, brand_name array<string>, substance_name array<string>"
_PATIENT = f"struct<patientsex string, patientonsetage string, drug array<struct<medicinalproduct string, openfda struct<{_NAMES.replace(' array', ': array')}>>>, reaction array<struct<reactionmeddrapt string>>>"
REPORT = f"safetyreportid string, receiptdate string, occurcountry string, patient {_PATIENT}, external_id string, drugs array<string>, reactions array<string>, country string, posted_at string, body string"
_FIELDS = ["safetyreportid", "receiptdate", "occurcountry", "patient", "external_id", "drugs", "reactions", "country", "posted_at", "body"]


def day(text: Column) -> Column:
    """A date written as yyyyMMdd or beginning with yyyy-MM-dd; null for anything else."""
    compact, dashed = (F.try_to_timestamp(t, F.lit(f)) for t, f in ((text, "yyyyMMdd"), (F.substring(text, 1, 10), "yyyy-MM-dd")))
    return F.coalesce(compact, dashed).cast("date")


def _folded(names: Column) -> Column:
    """Trimmed lower-case names, blanks and repeats gone, in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))


def json_reports(spark: SparkSession, path: str) -> DataFrame:
    """report, day, country, drugs, reactions and body from a JSON file or a folder of them.

    A file is an array of reports or wraps one in `results`; reports are nested (patient.drug, patient.reaction) or
    flat (drugs, reactions). Missing parts are null or empty; the schema is fixed, so nothing is read twice.
    """
    raw = spark.read.schema(f"results array<struct<{REPORT}>>, {REPORT}").option("multiLine", True).json(path)
    r = raw.select(F.explode(F.coalesce("results", F.array(F.struct(*_FIELDS)))).alias("r")).select("r.*")
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform("patient.drug", lambda d: F.concat(F.array(d["medicinalproduct"]), *(F.coalesce(d["openfda"][n], none) for n in ("generic_name", "brand_name", "substance_name")))))
    return r.select(
        F.coalesce("safetyreportid", "external_id").alias("report"), F.coalesce(day(F.col("receiptdate")), day(F.col("posted_at"))).alias("day"), F.coalesce("occurcountry", "country").alias("country"),
        _folded(F.coalesce(found, "drugs", none)).alias("drugs"), _folded(F.coalesce(F.col("patient.reaction.reactionmeddrapt"), "reactions", none)).alias("reactions"), "body",
    ).where("report is not null")


def flattened(reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons, exposures and conditions of reports, a row each."""
    return reports.select("report", "day", "country"), reports.select("report", F.explode("drugs").alias("drug")), reports.select("report", F.explode("reactions").alias("event"))


def delimited(spark: SparkSession, path: str, keep: list[str], key: str = "vocabulary_id") -> DataFrame:
    """A vocabulary with a header, separated by tabs, commas, bars or semicolons as its first line tells; names in lower case, malformed rows gone."""
    first = spark.read.text(path).first()
    line = first.value if first else ""
    rows = spark.read.csv(path, sep=max("\t,|;", key=line.count), header=True, mode="DROPMALFORMED")
    rows = rows.toDF(*(c.lower() for c in rows.columns))
    return rows.where(F.col(key).isin(keep))


def label_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (drug, event) of a label table of seven tab-separated columns, with or without a header; preferred terms alone."""
    rows = spark.read.csv(path, sep="\t", schema="flat string, stereo string, label string, kind string, concept string, event string, drug string", mode="DROPMALFORMED")
    return rows.where("kind = 'PT' and drug is not null and event is not null").select(F.lower("drug").alias("drug"), F.lower("event").alias("event")).distinct()


_RESOURCE = """resourceType string, id string, subject struct<reference:string>, suspectEntity array<struct<instance:struct<reference:string,display:string>>>,
event struct<text:string>, medicationCodeableConcept struct<text:string>, location struct<display:string>, address array<struct<country:string>>"""


def fhir_events(bundles: DataFrame) -> DataFrame:
    """bundle, drug, event and country from rows of (bundle, json).

    The suspect is the first entity with a name or a reference to a medication of the bundle, else the subject's first
    medication; the country is the patient's, else the location. Events without a drug or a reaction are left out.
    """
    entries = F.from_json("json", f"entry array<struct<resource:struct<{_RESOURCE}>>>")
    r = bundles.select("bundle", F.posexplode(entries["entry"]).alias("at", "e")).select("bundle", "at", "e.resource.*")
    name = F.element_at(F.split(F.col("subject.reference"), "/"), -1)
    events = r.where("resourceType = 'AdverseEvent'").select("bundle", "at", name.alias("person"), F.col("event.text").alias("event"), F.col("location.display").alias("place"), "suspectEntity")
    meds = r.where("resourceType = 'MedicationStatement'").select("bundle", F.col("at").alias("med_at"), F.col("id").alias("ref"), name.alias("person"), F.col("medicationCodeableConcept.text").alias("med"))
    people = r.where("resourceType = 'Patient'").select("bundle", F.col("id").alias("person"), F.col("address")[0]["country"].alias("home"))
    named = events.select("bundle", "at", F.posexplode("suspectEntity").alias("k", "s")).select("bundle", "at", "k", F.col("s.instance.display").alias("display"), F.element_at(F.split("s.instance.reference", "/"), -1).alias("ref"))
    named = named.join(meds.drop("person"), ["bundle", "ref"], "left").withColumn("suspect", F.coalesce("display", "med")).where("suspect is not null")
    named = named.groupBy("bundle", "at").agg(F.min_by("suspect", "k").alias("suspect"))
    own = meds.groupBy("bundle", "person").agg(F.min_by("med", "med_at").alias("own"))
    rows = events.join(named, ["bundle", "at"], "left").join(own, ["bundle", "person"], "left").join(people, ["bundle", "person"], "left")
    return rows.select("bundle", F.coalesce("suspect", "own").alias("drug"), "event", F.coalesce("home", "place").alias("country")).where("drug is not null and event is not null")


def sections(text: Column, names: list[str]) -> Column:
    """Array of (name, body) of a note whose sections begin with a line `Name:`."""
    head = rf"(?im)^\s*({'|'.join(names)})\s*:"
    titles, bodies = F.regexp_extract_all(text, F.lit(head)), F.split(text, head)
    return F.zip_with(titles, F.slice(bodies, 2, F.size(bodies)), lambda t, b: F.struct(F.lower(t).alias("name"), F.regexp_replace(b, r"^\s+|\s+$", "").alias("body")))


def dictionary(spark: SparkSession, folder: str, name: str, schema: str, fallback: list[tuple]) -> DataFrame:
    """A dictionary of a folder: its Parquet table if there is one, else its JSON lines, else the rows given."""
    for kind in ("parquet", "json"):
        path = f"{folder.rstrip('/')}/{name}.{kind}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return spark.read.schema(schema).format(kind).load(path)
    return spark.createDataFrame(fallback, schema)

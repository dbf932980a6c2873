"""Feed readers, sink operators and entity operators on made rows."""

import datetime
import json

from pyspark.sql import functions as F

from quillon.operators import entities, sinks
from quillon.sources import feeds


def test_json_reports_of_every_shape(spark, tmp_path):
    nested = {"safetyreportid": "1", "receiptdate": "20240305", "occurcountry": "FR", "patient": {"drug": [{"medicinalproduct": "Alpha", "openfda": {"generic_name": ["alpha ", "beta"]}}, {"medicinalproduct": None}], "reaction": [{"reactionmeddrapt": "Rash"}, {"reactionmeddrapt": "rash"}]}}
    flat = {"external_id": "2", "drugs": ["Gamma"], "reactions": [], "country": "DE", "posted_at": "2024-01-02T10:00:00Z", "body": "x"}
    (tmp_path / "a.json").write_text(json.dumps({"results": [nested]}))
    (tmp_path / "b.json").write_text(json.dumps([flat, {"country": "no id"}]))
    got = {r.report: r for r in feeds.json_reports(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2"} and got["1"].drugs == ["alpha", "beta"] and got["1"].reactions == ["rash"]
    assert got["1"].day == datetime.date(2024, 3, 5) and got["2"].day == datetime.date(2024, 1, 2) and got["2"].drugs == ["gamma"]
    persons, exposures, conditions = feeds.flattened(feeds.json_reports(spark, str(tmp_path)))
    assert (persons.count(), exposures.count(), conditions.count()) == (2, 3, 1)


def test_delimited_sniffs_and_filters(spark, tmp_path):
    for sep in "\t,|":
        p = tmp_path / f"v{ord(sep)}.csv"
        p.write_text("\n".join(sep.join(r) for r in (("Concept_ID", "Vocabulary_ID"), ("1", "RxNorm"), ("2", "ICD"), ("3", "RxNorm"))))
        assert [r.concept_id for r in feeds.delimited(spark, str(p), ["RxNorm"]).orderBy("concept_id").collect()] == ["1", "3"]


def test_label_pairs_with_and_without_header(spark, tmp_path):
    rows = [("f", "s", "l", "PT", "c", "Rash", "Alpha"), ("f", "s", "l", "LLT", "c", "Itch", "Alpha"), ("f", "s", "l", "PT", "c", "rash", "alpha")]
    for name, head in (("a", []), ("b", [("flat", "stereo", "label", "kind", "concept", "event", "drug")])):
        (tmp_path / name).write_text("\n".join("\t".join(r) for r in head + rows))
        assert [tuple(r) for r in feeds.label_pairs(spark, str(tmp_path / name)).collect()] == [("alpha", "rash")]


def test_fhir_events(spark):
    def event(person, **more):
        return {"resource": {"resourceType": "AdverseEvent", "id": "e", "subject": {"reference": f"Patient/{person}"}, "event": {"text": "rash"}} | more}

    med = [{"resource": {"resourceType": "MedicationStatement", "id": i, "subject": {"reference": "Patient/p"}, "medicationCodeableConcept": {"text": t}}} for i, t in (("m1", "alpha"), ("m2", "beta"))]
    patient = {"resource": {"resourceType": "Patient", "id": "p", "address": [{"country": "FR"}]}}
    to = lambda r: [{"instance": {"reference": r}}]
    bundles = [
        (1, [patient, *med, event("p", suspectEntity=to("MedicationStatement/m2"))]),
        (2, [*med, event("p", location={"display": "Lyon"})]),
        (3, [*med, event("p", suspectEntity=[{"instance": {"reference": "x/none"}}, {"instance": {"display": "gamma"}}])]),
        (4, [event("q")]),
        (5, [*med, event("p", event={"text": None})]),
    ]
    df = spark.createDataFrame([(b, json.dumps({"entry": e})) for b, e in bundles] + [(6, "not json"), (7, None)], "bundle long, json string")
    assert sorted(tuple(r) for r in feeds.fhir_events(df).collect()) == [(1, "beta", "rash", "FR"), (2, "alpha", "rash", "Lyon"), (3, "gamma", "rash", None)]


def test_sections(spark):
    df = spark.createDataFrame([("Plan: rest\nHistory : none\nmore",), ("free text",), (None,)], "t string")
    got = [r.s and [tuple(x) for x in r.s] for r in df.select(feeds.sections(F.col("t"), ["plan", "history"]).alias("s")).collect()]
    assert got == [[("plan", "rest"), ("history", "none\nmore")], [], None]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted((r.k, r.v, r.change) for r in sinks.upserted(old, new, ["k"], ["v"]).collect()) == [(1, "a", "kept"), (2, None, "updated"), (3, "c", "inserted")]
    assert [r.k for r in sinks.insert_absent(old, new.union(new), ["k"]).collect()] == [3]
    assert sorted((r.k, r.s) for r in sinks.carried(new.select("k"), old.withColumn("s", F.lit("seen")), ["k"], {"s": "new"}).collect()) == [(2, "seen"), (3, "new")]


def test_entities(spark):
    df = spark.createDataFrame([("no sign of rash but rash came",), ("rash",), ("",), (None,)], "text string")
    n = entities.negated_mentions(entities.tokens(F.col("text")), "rash", ["no", "without"], ["but"])
    assert [r.n for r in df.select(n.alias("n")).collect()][:3] == [1, 0, 0]
    terms = spark.createDataFrame([("ASPIRIN",), ("asp irin",), ("aspirn",), ("zzz",), ("",)], "term string")
    catalog = spark.createDataFrame([("aspirin",), ("aspirate",)], "entry string")
    got = {r.term: (r.entry, r.tier) for r in entities.resolved(terms, catalog).collect()}
    assert got == {"ASPIRIN": ("aspirin", 1), "asp irin": ("aspirin", 2), "aspirn": ("aspirin", 3), "zzz": (None, None), "": (None, None)}

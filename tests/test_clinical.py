"""Clinical text operators, dictionaries and the content dedupe on odd rows."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import clinical as C
from quillon.operators import lenses
from quillon.sources import feeds
from quillon.streaming import dedupe


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_spans_take_the_longest_surface_and_whole_words(spark):
    surfaces = ["diabetes", "diabetes type 2", "rash"]
    got = one(spark, C.spans(F.lit("Rash, diabetes TYPE 2, crash and a rash"), surfaces), C.spans(F.lit(""), surfaces), C.spans(F.lit(None).cast("string"), surfaces))
    assert [tuple(x) for x in got[0]] == [("rash", 0), ("diabetes type 2", 6), ("rash", 35)] and got[1] == [] and got[2] is None


def test_event_stages(spark):
    terms = spark.createDataFrame([("Head-ache!",), ("rashes",), ("dizzyness",), ("rainbow",), ("",), (None,), ("rashes",)], "term string")
    got = {r.term: (r.stage, r.pt) for r in C.normalised_events(terms).collect()}
    assert got == {"Head-ache!": (2, "Headache"), "rashes": (3, "Rash"), "dizzyness": (4, "Dizziness"), "rainbow": (None, None), "": (None, None), None: (None, None)}
    assert C.normalised_events(terms.limit(0)).count() == 0


def test_challenges_gates_and_negation(spark):
    text = "Woman, 30 years old, took Advil 200 mg. No rash, had hives after 3 days. Stopped it and it resolved, restarted it and it came back."
    t = F.lit(text)
    assert one(spark, C.dechallenge(t), C.rechallenge(t), C.dechallenge(F.lit("it persisted")), C.dechallenge(F.lit("stopped the drug, no change"))) == ("positive", "positive", "unknown", "negative")
    assert one(spark, *C.gates(t).values()) == (True, True, True, True)
    assert one(spark, *C.gates(F.lit("took water, no rash")).values()) == (False, False, False, False)
    assert one(spark, C.cue_value(t, "age"), C.cue_value(t, "dose"), C.cue_value(t, "onset"), C.cue_value(t, "lot")) == ("30", "200", "3", None)
    assert one(spark, *C.naranjo_from_text(t)) == (5, "Probable")


def test_products_conditions_and_links(spark):
    assert one(spark, C.canonical_product(F.lit(" TYLENOL ")), C.canonical_product(F.lit("qqx")), C.product_class(F.lit("warfarin"))) == ("paracetamol", None, "B01AA")
    assert one(spark, C.contained_conditions(F.lit("has diabetes type 2 and asthma, asthma")))[0] == ["Asthma", "Type 2 diabetes mellitus"]
    got = {r.term: (r.concept, r.method) for r in C.linked(spark.createDataFrame([("Asthma",), ("diabetis",), ("xyz",), (None,)], "term string")).collect()}
    assert got == {"Asthma": ("Asthma", "exact"), "diabetis": ("Diabetes mellitus", "fuzzy"), "xyz": (None, None), None: (None, None)}


def test_dictionary_prefers_parquet_then_json_then_its_own_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1")], "surface string, concept string")
    read = lambda: [r.concept for r in feeds.dictionary(spark, str(tmp_path), "d", "surface string, concept string", [("a", "3")]).collect()]
    assert read() == ["3"]
    rows.withColumn("concept", F.lit("2")).write.json(str(tmp_path / "d.json"))
    assert read() == ["2"]
    rows.write.parquet(str(tmp_path / "d.parquet"))
    assert read() == ["1"]


def test_equal_contents_pass_once(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "x"), ("2024-01-02 00:00:00", "x"), ("2024-01-02 00:00:00", None), ("2024-01-03 00:00:00", None)], "ts string, body string")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, body string").parquet(str(tmp_path / "in"))
    got = dedupe.run_available(stream, str(tmp_path / "out"), "ts", ["body"], "30 days")
    assert sorted(str(r.body) for r in got.collect()) == ["None", "x"]


def test_remine_excludes_up_to_three_maskers(spark):
    mentions = [(k, d, "E", "S") for k, d in enumerate("A" * 9 + "B" * 7 + "C" * 6 + "D" * 5 + "T" * 3)] + [(100 + k, d, "F", "S") for k, d in enumerate("ABCDT" * 4)]
    df = spark.createDataFrame(mentions, "post long, drug string, event string, soc string")
    got = {(r.drug, r.event): r for r in lenses.remine(df).collect()}
    assert len(got) == 10 and got["T", "E"].excluded == "A|B|C" and got["T", "E"].tier == "evaluable"
    after = got["T", "E"]
    assert after.n_after == 3 and after.prr_after == pytest.approx(((3.5) / 8) / ((5.5) / 10), abs=1e-3)
    assert lenses.remine(df.limit(0)).count() == 0


def test_remine_repeats_no_post_for_each_set(spark):
    """Of the posts with any of a set's drugs, those with two or three of them count once."""
    sets = spark.createDataFrame([("A|B|C", ["A", "B", "C"]), ("A|B", ["A", "B"]), ("C", ["C"])], "excluded string, members array<string>")
    posts = {1: "A", 2: "AB", 3: "ABC", 4: "BC", 5: "D", 6: "CD"}
    rows = [(p, [(d, "e") for d in drugs]) for p, drugs in posts.items()]
    by_post = spark.createDataFrame(rows, "post long, m array<struct<drug:string,event:string>>")
    got = {(r.excluded, r.drug): r.n for r in lenses._dropped(by_post, sets).collect() if r.n}
    want = {}
    for name in ("A|B|C", "A|B", "C"):
        for drugs in posts.values():
            if set(drugs) & set(name.split("|")):
                for d in drugs:
                    want[name, d] = want.get((name, d), 0) + 1
    assert got == want

"""Texts are read once, whatever the dictionaries; grams that no entry has are not joined."""

from quillon.operators import matching, similarity


def test_spans_of_each_equal_spans_of_one(spark):
    texts = spark.createDataFrame([(1, "not only pain but no chest pain"), (2, "no pain, no chest"), (3, None), (4, "pain not only pain")], "doc_id long, text string")
    a = spark.createDataFrame([("chest pain", "x"), ("pain", "y"), ("no", "z")], "surface string, concept string")
    b = spark.createDataFrame([("no", "trigger"), ("not", "trigger"), ("not only", "pseudo")], "surface string, cue string")
    for got, d in zip(matching.spans_of_each(texts, "doc_id", "text", [a, b]), (a, b)):
        want = matching.dictionary_spans(texts, "doc_id", "text", d)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()


def test_containing_with_and_without_the_filter(spark, monkeypatch):
    terms = spark.createDataFrame([("severe headache today",), ("headachy",), ("toothache",), ("none",)], "a string")
    asked = spark.createDataFrame([("headache",), ("tooth",), ("absent thing",), ("head",)], "b string")
    want = {("severe headache today", "headache"), ("toothache", "tooth")}
    for most in (1, 1 << 20):
        monkeypatch.setattr(similarity, "INDEX", most)
        got = similarity.containing(terms, asked)
        assert {tuple(r) for r in got.collect()} == want and got.count() == 2

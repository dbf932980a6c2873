"""Assessment operators on small made rows: unknowns, bounds, ties, empty input."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import assessment as A


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("answer, want", [(None, (0, "Doubtful")), (True, (8, "Probable")), (False, (1, "Possible"))])
def test_checklist_of_equal_answers(spark, answer, want):
    assert one(spark, *A.naranjo({q: F.lit(answer).cast("boolean") for q in A.NARANJO})) == want


def test_harm_is_bounded(spark):
    assert one(spark, A.harm_per_treated(F.lit(9.0), F.lit(9.0), F.lit(1)), A.harm_per_treated(F.lit(0.0), F.lit(1.0), F.lit(1))) == (2, 10000)


def test_critical_and_certain_harm_needs_more_benefit(spark):
    v = lambda b, h, c: A.benefit_verdict(F.lit(b), F.lit(h), F.lit(c), F.lit(True))
    assert one(spark, v(3.0, 1.0, True), v(3.0, 1.0, False), v(4.0, 1.0, True), v(0.5, 1.0, False), v(1.0, 0.0, True)) == ("Uncertain", "Favourable", "Favourable", "Unfavourable", "Favourable")


def test_balance_without_rate(spark):
    assert one(spark, *A.balance(F.lit(50.0), F.lit(0.0))) == (None, "not evaluable")
    assert one(spark, *A.balance(F.lit(50.0), F.lit(10.0))) == (5.0, "strongly favourable")


def test_diversity_of_copies_single_and_unlike_texts(spark):
    rows = spark.createDataFrame([("copies", "the same text"), ("copies", "the same text"), ("single", "one text"), ("unlike", "abcdefgh"), ("unlike", "stuvwxyz"), ("nulls", None), ("nulls", ""), ("nulls", "x")], "k string, t string")
    got = {r["k"]: r["diversity"] for r in A.text_diversity(rows, "k", "t").collect()}
    assert got == {"copies": 0.0, "single": 1.0, "unlike": 1.0, "nulls": 1.0}
    assert A.text_diversity(rows.limit(0), "k", "t").count() == 0


def test_diversity_is_near_the_mean_over_all_pairs(spark):
    texts = ["safety report of a red widget", "safety report of a blue widget", "a wholly other narrative", "safety report of a red widgets"]
    grams = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(grams) for b in grams[i + 1 :]]
    got = A.text_diversity(spark.createDataFrame([(1, t) for t in texts], "k int, t string"), "k", "t", 128).first()["diversity"]
    assert abs(got - (1 - sum(pairs) / len(pairs))) < 0.06


def test_trust_of_one_post_is_lowest(spark):
    assert one(spark, *A.trust(F.lit(0.0), F.lit(0), F.lit(1), F.lit(1.0))) == (0.0, "sybil")
    assert one(spark, *A.trust(F.lit(1.0), F.lit(48), F.lit(3), F.lit(1.0))) == (1.0, "high")


def test_dates_onsets_and_ages(spark):
    days = [A.any_date(F.lit(t)).cast("string") for t in ("20240229", "2024-02-29", "2024-02-29T01:02:03Z", "20240230", "soon", "")]
    assert one(spark, *days) == ("2024-02-29",) * 3 + (None,) * 3
    assert one(spark, *(A.onset_days(F.lit(t)) for t in ("3 days", "after 2 Weeks", "1.5 months", "1 year", "none", ""))) == (3.0, 14.0, pytest.approx(45.6), 365.0, None, None)
    assert one(spark, A.age_years(F.lit(3.0), F.lit("800")), A.age_years(F.lit(24.0), F.lit("802")), A.age_years(F.lit(3.0), F.lit("x"))) == (30.0, 2.0, None)


def test_spans_strict_and_relaxed(spark):
    schema = "doc long, start long, end long, kind string"
    gold = spark.createDataFrame([(1, 0, 5, "drug"), (1, 10, 15, "event"), (2, 0, 5, "drug")], schema)
    found = spark.createDataFrame([(1, 0, 5, "drug"), (1, 11, 16, "event"), (2, 0, 5, "event")], schema)
    assert tuple(A.span_matches(gold, found).first())[:3] == (1, 2, 2)
    assert tuple(A.span_matches(gold, found, False).first())[:3] == (2, 1, 1)
    assert tuple(A.span_matches(gold.limit(0), found.limit(0)).first()) == (0, 0, 0, None, None, None)


def test_paths_follow_relations(spark):
    e = spark.createDataFrame([("d", "causes", "x"), ("d", "causes", "y"), ("x", "in", "s"), ("x", "in", "s2"), ("z", "in", "s")], "src string, relation string, dst string")
    assert {tuple(r[c] for c in ("n0", "n1", "n2")) for r in A.walk(e, ["causes", "in"]).collect()} == {("d", "x", "s"), ("d", "x", "s2")}


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    a, b = (sorted(map(tuple, A.sampled(rows.repartition(n), "g", "id", 7, "s").collect())) for n in (1, 5))
    assert a == b and len(a) == 14


def test_like_texts_have_like_vectors(spark):
    v = lambda t: A.hashed_vector(F.lit(t))
    same, other, none = one(spark, A.dot(v("Headache"), v("headache")), A.dot(v("headache"), v("xyzzyq")), A.dot(v("headache"), v("headaches")))
    assert same == pytest.approx(1.0) and other < 0.5 < none

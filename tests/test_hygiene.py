"""Hygiene operators against row-by-row references, and the ingest over several batches."""

import hashlib
import hmac
import re

from pyspark.sql import functions as F

from quillon.operators import hygiene as H
from quillon.streaming import ingest

TEXTS = [
    None, "", "plain words only", "mail a.b+c@site.example.org now", "see https://x.example/a?b=1 and www.y.example", "card 4111 1111 1111 1111 ok", "no card 4111 1111 1111 1112 here",
    "iban DE89370400440532013000", "ssn 123-45-6789", "nino AB123456C", "id 1234 5678 9012", "pan ABCDE1234F", "pay me@okaxis", "call +1 (555) 123-456-7890", "hello @someone and @a", "é@ñandú.example @ñandú", "a@b.co a@b.co @bob",
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def by_rows(text):
    if text is None:
        return None, []
    kinds = []
    for kind, pattern in H.PATTERNS.items():
        good = lambda m: kind != "CARD" or luhn(re.sub("[^0-9]", "", m[0]))  # noqa: E731, B023
        after = re.sub(pattern, lambda m: f"[{kind}]" if good(m) else m[0], text)  # noqa: B023
        kinds += [kind] if after != text else []
        text = after
    return text, kinds


def test_scrub_equals_row_by_row(spark, sf):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + docs)], "i int, text string, kind string")
    got = {r["i"]: (r["text"], r["kinds"]) for r in H.scrub_rows(rows, "text").collect()}
    assert got == {i: by_rows(t) for i, t in enumerate(TEXTS + docs)}
    assert {k for t in TEXTS for k in by_rows(t)[1]} == set(H.PATTERNS)
    assert H.scrub_rows(rows.limit(0), "text").count() == 0


def test_pseudonyms_are_hmacs(spark):
    names = ["ann", "", "ünï", "a" * 31, "0123456789abcdef" * 2]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(H.pseudonym(F.col("n"), b"k")).collect()]
    want = [hmac.new(b"k", n.encode(), hashlib.sha256).hexdigest() for n in names[:3]]
    assert got[:3] == want and got[4] == names[4] and len(got[3]) == 64


def test_matches(spark):
    m = lambda a, b: spark.range(1).select(H.soft_match(F.lit(a), F.lit(b)), H.folded_match(F.lit(a), F.lit(b))).first()
    assert tuple(m("Nausea", "severe nausea")) == (True, True)
    assert tuple(m("rash", "skin rash")) == (False, True)
    assert tuple(m("", "x")) == (False, False)


def test_gateway_drops_negated_unknown_and_repeated(spark):
    words = "no fever but then later a rash and a rash took fever".split()
    passed = H.gateway(F.array(*map(F.lit, words)), ["fever", "rash", "took"], ["took"], ["no"])
    assert spark.range(1).select(passed).first()[0] == ["rash", "fever"]
    assert spark.range(1).select(H.gateway(F.array().cast("array<string>"), ["x"], ["y"], ["z"])).first()[0] == []


def test_tiers(spark):
    catalog = spark.createDataFrame([("rash",), ("skin rash",), ("fever",)], "entry string")
    terms = spark.createDataFrame([("Skin Rash",), ("red skin rash today",), ("rashes",), ("",), (None,), ("fever rash",)], "term string")
    got = {r["term"]: (r["entry"], r["tier"]) for r in H.tiered(terms, catalog).collect()}
    assert got == {"Skin Rash": ("skin rash", 1), "red skin rash today": ("skin rash", 2), "rashes": (None, None), "": (None, None), None: (None, None), "fever rash": ("fever", 2)}


def test_ingest_over_batches_and_a_second_start(spark, tmp_path):
    source = str(tmp_path / "source")
    rows = lambda *r: spark.createDataFrame(r, "key string, n long").coalesce(1).write.mode("append").parquet(source)
    take = lambda: ingest.run_available(spark.readStream.schema("key string, n long").option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "t"), str(tmp_path / "c"), "key", "n")
    rows(("a", 1), ("b", 2), ("a", 0))
    rows(("b", 3), ("c", 4))
    assert sorted((r["key"], r["n"], r["copies"]) for r in take().collect()) == [("a", 0, 2), ("b", 2, 1), ("c", 4, 1)]
    rows(("d", 5), ("c", 6), ("a", 7))
    assert sorted((r["key"], r["n"]) for r in take().collect()) == [("a", 0), ("b", 2), ("c", 4), ("d", 5)]

"""Similarity joins, dictionary matching and term resolution against brute force and on made terms."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import matching, resolver, similarity
from quillon.sources.lexicon import CUES, lexicon, lexicon_rows, write_lexicon


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def bag(t, size=3, pad=2):
    t = "\x01" * pad + t + "\x02" * pad
    return Counter(t[i : i + size] for i in range(len(t) - size + 1))


@pytest.fixture(scope="module")
def words():
    """Terms over few letters, so that most pairs are near: 1 to 14 letters, short, repeated and odd ones included."""
    rng = random.Random(3)
    out = {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(150)}
    return sorted(out | {"", "a", "ab", "aaaaaaa", "aaaaaaab", "erin", "er in", "nausea", "nauseas", "né à", "ne a"})


@pytest.fixture(scope="module")
def both(spark, words):
    """Left and right terms, with repeats and nulls."""
    left, right = words[::2] + words[:9] + [None], words[1::2] + words[:9] + [None]
    frame = lambda rows, key: spark.createDataFrame([(w, "x", 1) for w in rows], f"{key} string, gram string, n int")
    return frame(left, "a"), frame(right, "b"), {w for w in left if w is not None}, {w for w in right if w is not None}


@pytest.mark.parametrize("least", [0.5, 0.72, 0.8, 0.85, 1.0])
def test_ratio_join_finds_all(both, least):
    left, right, xs, ys = both
    want = {(a, b) for a in xs for b in ys if 1 - edits(a, b) / max(len(a), len(b), 1) >= least - 1e-9}
    assert {(r.a, r.b) for r in similarity.ratio_join(left, right, least).collect()} == want and want


@pytest.mark.parametrize("most", [0, 1, 2])
def test_edit_join_finds_all(both, most):
    left, right, xs, ys = both
    want = {(a, b, edits(a, b)) for a in xs for b in ys if edits(a, b) <= most}
    assert {tuple(r) for r in similarity.edit_join(left, right, most).collect()} == want


@pytest.mark.parametrize("least", [0.2, 0.5, 0.9])
def test_gram_joins_find_all(both, least):
    left, right, xs, ys = both
    jaccard, cosine = {}, {}
    for a in xs:
        for b in ys:
            x, y = bag(a), bag(b)
            common, n, m = (x & y).total(), x.total(), y.total()
            if common / (n + m - common) >= least:
                jaccard[a, b] = common / (n + m - common)
            if common / math.sqrt(n * m) >= least:
                cosine[a, b] = common / math.sqrt(n * m)
    assert {(r.a, r.b): pytest.approx(r.jaccard) for r in similarity.jaccard_join(left, right, least).collect()} == jaccard
    assert {(r.a, r.b): pytest.approx(r.cosine) for r in similarity.cosine_join(left, right, least).collect()} == cosine


def test_a_gram_of_every_term_brings_no_candidates(spark):
    """All terms begin alike; only the rare grams of the prefix meet."""
    terms = [f"common beginning {i:04d}{(i * 7919) % 10_000:04d}" for i in range(1500)]
    left, right = (spark.createDataFrame([(t,) for t in terms], f"{k} string") for k in "ab")
    grams = lambda df, k: df.withColumn("grams", similarity.numbered_grams(F.col(k), 3, 2))
    pairs = similarity.overlap_join(grams(left, "a"), grams(right, "b"), lambda n, m: F.ceil((n + m) * (0.95 / 1.95)), lambda n: F.ceil(n * 0.95))
    assert pairs.where("a = b").count() == 1500
    assert similarity.jaccard_join(left, right, 0.95).count() == 1500


@pytest.mark.parametrize("counters", [64, 1 << 18])
def test_index_of_the_right_side_finds_what_prefixes_find(spark, both, monkeypatch, counters):
    left, right, xs, ys = both
    monkeypatch.setattr(similarity, "_COUNTERS", counters)
    grams = lambda df, k: similarity._with_grams(df, k, 3, 2)
    need, floor = lambda n, m: F.ceil((n + m) * (0.4 / 1.4)), lambda n: F.ceil(n * 0.4)
    found = [{tuple(r) for r in similarity.overlap_join(grams(left, "a"), grams(right, "b"), need, floor, most=most).collect()} for most in (0, 1 << 20)]
    shared = lambda a, b: sum((bag(a) & bag(b)).values())
    size = lambda t: sum(bag(t).values())
    assert found[0] == found[1] == {(a, b, shared(a, b)) for a in xs for b in ys if shared(a, b) >= max(1, math.ceil((size(a) + size(b)) * (0.4 / 1.4)))}


def test_containing_and_holding_all(both):
    left, right, xs, ys = both
    got = {(r.a, r.b) for r in similarity.containing(left.where("a is not null"), right.where("b is not null"), 2).collect()}
    assert got == {(a, b) for a in xs for b in ys if len(b) >= 2 and b in a}
    split = lambda df, k: df.where(f"{k} is not null").select(k).distinct().withColumn("words", F.filter(F.split(k, " "), lambda w: w != ""))
    got = {(r.a, r.b) for r in similarity.holding_all(split(left, "a"), split(right, "b")).collect()}
    assert got == {(a, b) for a in xs for b in ys if b.split(" ") != [""] and set(filter(None, b.split(" "))) and set(filter(None, b.split(" "))) <= set(a.split(" "))}


def scan(text, surfaces):
    """Longest-first spans, from the left, of lower-case texts whose words are parted by single characters."""
    w, at, out, i = [], 0, [], 0
    for x in "".join(c if c.isalnum() else " " for c in text.lower()).split(" "):
        w += [(x, at)] if x else []
        at += len(x) + 1
    while i < len(w):
        for n in range(min(matching.LONGEST, len(w) - i), 0, -1):
            if (s := " ".join(x for x, _ in w[i : i + n])) in surfaces:
                out.append((i, n, w[i][1], w[i + n - 1][1] + len(w[i + n - 1][0]), s))
                i += n
                break
        else:
            i += 1
    return out


TEXTS = ["Took Atorvastatin tablets; then PAIN in the chest, chest pain!", "", None, "no nausea", "chest pain in the chest pain in the", "  headache  ", "ab atorvastatin", "light-headed: light headed", "😀 nausea 中文 nausea", "nausea " * 3000]


@pytest.mark.parametrize("most", [matching.BROADCAST, 0])
def test_spans_of_a_large_dictionary(spark, most):
    book = lexicon(spark).where("kind != 'cue'")
    surfaces = {s for k, s, *_ in lexicon_rows() if k != "cue"}
    assert len(surfaces) > 1000
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string")
    found = matching.dictionary_spans(texts, "id", "body", book.select("surface").distinct(), most)
    got = sorted(tuple(r) for r in found.select("id", "word", "n", "start", "stop", "surface").collect())
    assert got == sorted((i, *s) for i, t in enumerate(TEXTS) for s in scan(t or "", surfaces))
    assert matching.dictionary_spans(texts.limit(0), "id", "body", book, most).count() == 0
    assert matching.dictionary_spans(texts, "id", "body", book.limit(0), most).count() == 0


def test_negation_by_cues(spark, tmp_path):
    book = write_lexicon(spark, str(tmp_path / "lexicon"))
    cases = {"no nausea": True, "nausea": False, "no fever but nausea": False, "not only nausea": False, "without any of the usual nausea": True, "no one two three four five six nausea": False, "nausea, not": False}
    texts = spark.createDataFrame(list(enumerate(cases)), "id long, body string")
    spans = matching.dictionary_spans(texts, "id", "body", book.where("kind = 'event' and surface = 'nausea'"))
    cues = matching.dictionary_spans(texts, "id", "body", spark.createDataFrame([(s, c) for c, x in CUES.items() for s in x], "surface string, cue string"))
    got = {r.id: r.negated for r in matching.negated(spans, cues, "id").collect()}
    assert got == dict(enumerate(cases.values()))


@pytest.fixture(scope="module")
def terminology(spark):
    chain = [("Chest pain", "Chest pain", "Pain", "General", "Body"), ("heart pain", "Chest pain", "Pain", "General", "Body"), ("Nausea", "Nausea", "Gut", "Gut signs", "Gut"), ("feeling queasy", "Nausea", "Gut", "Gut signs", "Gut"), ("acute liver failure", "Hepatic failure", "Liver", "Liver all", "Liver")]
    said = [("my tummy turns", "Nausea"), ("heart hurts", "Chest pain"), ("all blue", "Cyanosis")]
    return spark.createDataFrame(chain, "llt string, pt string, hlt string, hlgt string, soc string"), spark.createDataFrame(said, "said string, pt string")


def test_tiers_of_mapping(spark, terminology):
    want = {
        "CHEST  pain": ("llt_exact", "Chest pain", 0.95), "Hepatic failure": ("pt_exact", "Hepatic failure", 0.92), "heart hurts": ("pt_via_map", "Chest pain", 0.85), "all blue": ("pt_via_map", "Cyanosis", 0.85),
        "a bad nausea today": ("llt_substring", "Nausea", 0.6), "failure of the liver, acute": ("llt_token_subset", "Hepatic failure", 0.5), "nothing": ("unmatched", None, 0.0), "": ("unmatched", None, 0.0), None: ("unmatched", None, 0.0),
    }
    rows = spark.createDataFrame([(t,) for t in [*want, "nothing"]], "term string")
    assert {r.term: (r.method, r.pt, r.confidence) for r in resolver.mapped(rows, *terminology).collect()} == want


def test_hybrid_ranks_and_terminology_tiers(spark, terminology):
    terms = spark.createDataFrame([(t,) for t in ["nausea", "nausae", "pain chest", "asked", "vomited", "acute liver failures", None, ""]], "term string")
    got = {r.term: r for r in resolver.hybrid(terms, *terminology).collect()}
    assert len(got) == 8 and got["nausea"].stage == "exact" and got["nausea"]["rank"] == pytest.approx(0.94)
    assert got["pain chest"].llt == "chest pain" and got["pain chest"].stage == "spelling"
    assert got["acute liver failures"].llt == "acute liver failure" and got["asked"].llt is None and got["vomited"].llt is None and got[""].llt is None
    got = {r.term: r.method for r in resolver.terminology(terms, *terminology).collect()}
    assert got["nausea"] == "llt_exact" and got["asked"] == got[None] == "unmatched" and got["acute liver failures"] == "grams" and got["pain chest"] == "spelling"


def test_tree(spark, terminology):
    got = {(r.level, r.name): (r.parent, r.n_llts) for r in resolver.tree(terminology[0]).collect()}
    assert got["pt", "Chest pain"] == ("Pain", 2) and got["soc", "Gut"] == (None, 2) and got["hlgt", "Gut signs"] == ("Gut", 2)

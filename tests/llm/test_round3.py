"""Whitening, periodic runs and disclosure against brute force, and on odd rows."""

import hashlib
import re
import zlib
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import disclosure, periodic_runs, whitening  # noqa: E402

ODD = [None, "", "  \n ", "a " * 700, "ab" * 400, "one", "x y", "same text here now " * 9, "same text here now " * 9, "\x00\x1c\x85 ½²Ⅷ 中文 😀", "w" * 120_000, "@" * 50_000, "1" * 50_000, "1." * 30_000, "+1" * 30_000, "- 1" * 20_000, "a.b-" * 20_000 + "@"]


@pytest.fixture(scope="module")
def rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return docs + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b a b a b a b a b"), (7, "x x x x x x x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", 1, "y", "z") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, near long, base string, terms string").repartition(3)


def runs_by_brute_force(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and all(any(w[k] != w[k + r] for k in range(s, s + length - r)) for r in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def made(rng, k, n):
    w = [str(x).encode() for x in rng.integers(0, k, n)]
    for _ in range(int(rng.integers(0, 4))):
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
        z = min(n, a + int(rng.integers(1, 60)))
        w[a:z] = (w[a : a + p] * 60)[: z - a]
    return w


@pytest.mark.parametrize("few", [0, 5, periodic_runs.FEW, 10**9])
def test_runs_of_made_texts(monkeypatch, few):
    monkeypatch.setattr(periodic_runs, "FEW", few)
    rng = np.random.default_rng(few % 97)
    for _ in range(120):
        block = [made(rng, int(rng.choice([1, 2, 3, 8, 50])), int(rng.integers(1, 120))) for _ in range(4)] + [[]]
        got = [list(zip(*(x.tolist() for x in f))) for f in periodic_runs._block(block)]
        assert got == [runs_by_brute_force(w) for w in block]


@pytest.mark.parametrize("word", ["ab", "fibonacci", "period"])
def test_runs_cost_little_more_for_long_periodic_texts(word):
    if word == "fibonacci":  # no run of four periods; every length splits some class
        a, b = [b"0"], [b"0", b"1"]
        while len(b) < 20_000:
            a, b = b, b + a
        assert len(next(iter(periodic_runs._block([b])))[0]) == 0
        return
    w = [b"a"] * 30_000 if word == "ab" else [str(i % 7000).encode() for i in range(30_000)]
    got = [x.tolist() for x in next(iter(periodic_runs._block([w])))]
    assert got == [[0], [30_000], [1 if word == "ab" else 7000]]


def expected_op12(doc, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_brute_force(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark, sf, rows, docs, monkeypatch):
    small = [(d, t) for d, t in rows if len(t or "") < 8000]
    want = sorted((expected_op12(d, t) for d, t in small), key=str)
    got = periodic_runs.run_digests(periodic_runs.with_tails(docs.where("text is null or length(text) < 8000")))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == want
    assert sum(w[1] > 0 for w in want) > 10
    assert periodic_runs.run_digests(docs).count() == len(rows)
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0
    assert periodic_runs.op12_periodic_runs(spark, sf).count() == len(rows) - len(ODD) - 2


def test_texts_without_runs(spark):
    d = spark.createDataFrame([(1, "so so so so so so far"), (2, None), (3, "a  b\nc")], "doc_id long, text string")
    assert sorted(map(tuple, periodic_runs.without_runs(d).collect())) == [(1, "so far"), (2, ""), (3, "a b c")]
    assert list(map(tuple, periodic_runs.periodic_runs(d).collect())) == [(1, 0, 6, 1)]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int, w0 double")


def test_whitening(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((400, 12)) * np.linspace(3, 0.2, 12) + 900).astype(np.float32)
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(i, v[0].tolist()) for i in range(1000, 1200)] + [(None, v[1].tolist())]
    bad = [(5001, None), (5002, []), (5003, [1.0] * 3), (5004, [float("nan")] + [0.0] * 11), (5005, [None] + [0.0] * 11), (5006, [float("inf")] + [0.0] * 11)]
    got = whitening.whiten(embeddings(spark, [(i, x, 1, "x", 1, 0.5) for i, x in data + bad])).toPandas()
    x = np.floor(256 * np.array([r for _, r in data], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    d = (n * fit - sums) / n
    cov = d.T @ d / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(data) and set(got.n) == {n} and set(got.component) == {1, 2, 3, 4}
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for (i, _), r in zip(data, x)}
    for (i, _), r in zip(data[:50], x):
        mine = got[got.vec_id == i].sort_values("component")
        want = ((n * r - sums) / n) @ axes[:, :4] / np.sqrt(e[:4])
        assert np.allclose(np.abs(mine.whitened), np.abs(want), rtol=1e-9, atol=1e-9)
        assert set(mine.deviation) == {Decimal(exact[i])}
        assert np.allclose(mine.explained, e[:4] / np.trace(cov), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert got.vec_id.isna().sum() == 4


def test_whitening_of_huge_offsets_is_exact(spark):
    data = [(i, [2.0**40 + i % 7, float(i)]) for i in range(100)]
    got = whitening.whiten(embeddings(spark, [(i, x, 1, "x", 1, 0.5) for i, x in data])).toPandas()
    x = [[int(256 * float(np.float32(c))) for c in r] for _, r in data]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    for i, r in enumerate(x[:10]):
        assert set(got[got.vec_id == i].deviation) == {Decimal(sum((n * a - s) ** 2 for a, s in zip(r, sums)))}
    trace = sum(Fraction(sum((n * a - s) ** 2 for a, s in zip(r, sums)), n**3) for r in fit)
    assert np.isclose(got[got.component == 1].explained.iloc[0] * float(trace) + sum(got[got.component == 2].explained[:1]) * float(trace), float(trace), rtol=1e-6)


def test_whitening_without_spread(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None, 1, "x", 1, 0.5), (2, [], 1, "x", 1, 0.5)])).count() == 0
    assert whitening.whiten(embeddings(spark, [(i, [1.0, 2.0], 1, "x", 1, 0.5) for i in range(9)])).count() == 0
    flat = whitening.whiten(embeddings(spark, [(i, [float(i), 2.0 * i, 1.0], 1, "x", 1, 0.5) for i in range(9)])).collect()
    assert len(flat) == 9 and {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1) and flat[0].identity_error < 1e-9


def base_by_regex(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def test_base_patterns_on_made_texts():
    rng = np.random.default_rng(8)
    parts = ["a", "b.", "@", "@x.y", "-", "%", "+", "1", "12", "255.", "256", "0001.", ".", " ", "(", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "me@mail.example.com", "é", "10.0.0.1", "\n"]
    for _ in range(6000):
        t = "".join(rng.choice(parts, int(rng.integers(1, 14))))
        assert disclosure.personal(t) == base_by_regex(t), t


def test_disclosure_of_terms(spark, docs, rows):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ando", "eril", "ista", "omen", "uber")]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    ring = [(i, f"{words(30)} Zebulon Quist, zq@post.example.org {words(30)}") for i in range(12)]
    # A passage with an address and copies of it: one piece of evidence, whatever rare words it holds.
    copied = f"{words(20)} hapaxone hapaxtwo copy@post.example.org hapaxthree {words(20)}"
    copies = [(100 + i, copied) for i in range(40)]
    clean = [(1000 + i, words(60)) for i in range(200)] + [(5000, "Zebulon alone in a text without any address")]
    got = {r.doc_id: r for r in disclosure.span_digests(disclosure.sanitised_spans(spark.createDataFrame(ring + copies + clean, "doc_id long, text string"))).collect()}
    for i, t in ring:
        a, z = t.index("Zebulon"), t.index("Quist")
        assert got[i].spans.split(",")[1:] == [f"term:{a}:{a + 7}", f"term:{z}:{z + 5}"] and got[i].n_email == 1
    assert all(got[i].n_terms == 0 and got[i].n_email == 1 for i, _ in copies)
    assert all(got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i, _ in clean)
    out = {r.doc_id: r.text for r in disclosure.sanitised(spark.createDataFrame(ring + clean, "doc_id long, text string")).collect()}
    assert "Zebulon" not in out[0] and "Quist" not in out[0] and "[email]" in out[0] and out[5000].startswith("Zebulon")


def test_terms_are_generalised_where_that_hides(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(rng.choice([f"sing{a}{b}" for a in "bcdfghklmn" for b in "aeiou"], n))
    ring = [(i, f"{words(20)} singleton k@post.example.org {words(20)}") for i in range(9)]
    clean = [(100 + i, words(100)) for i in range(100)]
    out = {r.doc_id: r.text for r in disclosure.sanitised(spark.createDataFrame(ring + clean, "doc_id long, text string")).collect()}
    assert all("sing* [email]" in out[i] for i, _ in ring)


def test_disclosure_of_odd_rows(docs, rows):
    spans = disclosure.sanitised_spans(docs)
    got = sorted(((r.doc_id, [tuple(x) for x in r.base]) for r in spans.collect()), key=str)
    slow = re.compile(r"@{100}|1{100}|w{1000}|(a\.b-){9}|(1\.){99}")
    assert len(got) == len(rows)
    want = {d: base_by_regex(t or "") for d, t in rows if not slow.search(t or "") and d != 7}
    assert all(b == want[d] for d, b in got if d in want) and sum(map(bool, want.values())) > 10
    digests = disclosure.span_digests(spans).where(F.col("doc_id") < 10_000).collect()
    assert all(r.n_email == sum(k == "email" for k, _, _ in want[r.doc_id]) for r in digests if r.doc_id in want)
    assert disclosure.sanitised(docs).columns == docs.columns and disclosure.sanitised(docs.limit(0)).count() == 0
    assert disclosure.sanitised_spans(docs.limit(0)).count() == 0


def test_perplexity_by_parts_is_that_of_the_whole_model(spark, sf):
    """Beyond `entries` runs nothing is pruned: parts judge their own places, with rows that share or lack a doc_id."""
    from pyspark.sql import functions as F
    from quillon.llm import perplexity

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    rows = perplexity.ngram_counts(docs)
    few = rows.where("k <= 2").count() + rows.where("k > 2").count() // 3
    assert len(perplexity.parts(rows, few)) > 2
    names = ["doc_id", "n_words", "base_failed", "kept"]
    order = lambda df: sorted((str(r.doc_id), round(r.log_ppl, 9), *map(str, r)) for r in df.select(*names, F.round("log_ppl", 9).alias("log_ppl")).collect())
    assert order(perplexity.quality_rules(docs, entries=few)) == order(perplexity.quality_rules(docs))
    assert perplexity.quality_rules(docs, rows_too=True, entries=few).count() == docs.count()

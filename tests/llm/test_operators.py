"""The ten operators against brute force, round trips and held-out accuracy, and on odd rows."""

import base64
import collections
import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import byte_bpe, embedding_forest, packing, perplexity, quality_knn, simhash_anchor, suffix_dedup, token_rollup, toxicity, warc  # noqa: E402

ODD = [None, "", "  \n ", "a" * 700, "ab" * 400, "é" * 300, "one", "x y", "same text here now " * 9, "same text here now " * 9, "\x00\x1c\x85 ½²Ⅷ 中文 😀 <|endoftext|> 'll", "w" * 120_000]


@pytest.fixture(scope="module")
def rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return docs + [(10_000 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en" if d % 3 else None, "s", 0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def removed_by_brute_force(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        mark = np.zeros(len(b) + 1, np.int32)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                mark[p] += 1
                mark[p + 100] -= 1
            seen.add(s)
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[doc] = (len(b), int(gone.sum()), int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 2])
def test_suffix_dedup(docs, rows, many):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.duplicate_spans(docs, many).collect()}
    assert got == removed_by_brute_force(rows)


def test_suffix_dedup_texts_and_repeated_rows(spark, docs, empty):
    assert suffix_dedup.deduplicated(docs).columns == docs.columns
    assert suffix_dedup.duplicate_spans(empty).count() == 0
    t = "".join(map(str, range(100)))
    twice = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.copy, r.n_removed) for r in suffix_dedup.duplicate_spans(twice).collect())
    assert got == [(False, 1, 190), (False, 2, 190), (True, 1, 0), (True, 1, 0)]


def test_suffix_dedup_of_a_line_between_ever_new_neighbours(spark):
    rng = np.random.default_rng(4)
    line = "the same line of more than a hundred bytes stands in every one of these documents, whatever is around it, again"
    new = lambda: "".join(rng.choice(list("abcdefgh "), 150))
    rows = [(i, f"{new()}{line}{new()}{line if i % 3 else ''}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for many in (2, suffix_dedup.MANY):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.duplicate_spans(docs, many).collect()}
        assert got == removed_by_brute_force(rows)


def test_deep_shallow_is_a_sort():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (300, 40)).astype(np.uint8)
    rows[50:80] = rows[50]
    group = rng.integers(0, 5, 300)
    order, lcp = suffix_dedup.deep_shallow(group, rows, 0, 8)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for (g0, a), (g1, b), n in zip(keys, keys[1:], lcp[1:]):
        same = next((k for k in range(40) if a[k] != b[k]), 40)
        assert n == (same if g0 == g1 else -1)


def test_simhash(docs, rows, empty):
    prints = {d: simhash_anchor.fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None]) <= 2, 1))
    want = components(ids, [(ids[i], ids[j]) for i, j in near])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_anchor.simhash_dedup(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert simhash_anchor.simhash_dedup(empty).count() == 0


def test_anchors_cover_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    who, anchor, home = simhash_anchor.anchors(x)
    of_x = dict(zip(who[home], anchor[home]))
    who, anchor, _ = simhash_anchor.anchors(y)
    assert set(of_x.items()) <= set(zip(who, anchor))


def test_embeddings(spark, sf):
    rng = np.random.default_rng(5)
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in base]
    close = [(20_000 + i, (np.array(rows[i % 7][1]) + rng.normal(0, 0.03, 64) * np.linalg.norm(rows[i % 7][1]) / 8).tolist()) for i in range(60)]
    odd = [(30_000, None), (30_001, []), (30_002, [0.0] * 64), (30_003, [float("nan")] * 64), (30_004, [None] * 64), (30_005, [1.0]), (30_006, [2.0]), (20_000, close[0][1])]
    rows += close + odd
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for i in range(len(good)) for j in range(i) if len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.95]
    n = collections.Counter(k for pair in links for k in pair)
    want = components([i for i, _ in rows], [(good[i][0], good[j][0]) for i, j in links])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embedding_forest.embedding_dedup(df).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(r.n_links for r in got) == sum(n.values())
    assert embedding_forest.embedding_dedup(df.limit(0)).count() == 0


def linked_by_forest(spark, x, **kw):
    """The linked counts and components of forest_links() over vectors."""
    table = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(x)], "cid long, n long, x binary").repartition(5)
    rows = embedding_forest.forest_links(table, **kw).collect()
    n = collections.Counter()
    for r in rows:
        n[r.a] += r.linked
    return n, components(range(len(x)), [(r.a, r.b) for r in rows]), len(rows)


def linked_by_brute_force(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(u @ u.T >= 0.95, 1))
    return collections.Counter(pairs.ravel().tolist()), components(range(len(x)), pairs.tolist())


def test_large_leaves_are_compared_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 16) + rng.normal(0, 0.05, (90, 16))
    n, component, rows = linked_by_forest(spark, x, leaf=1000, leaf_rows=20)
    assert (n, component) == linked_by_brute_force(x) and rows < 90 * 5 * 9


def test_pairs_that_share_leaves_count_once_and_recall_holds_in_deep_trees(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (1500, 32))
    close = np.concatenate([base[:500] + rng.normal(0, 0.22, (500, 32)) for _ in range(3)])  # cosines around 0.976
    x = np.concatenate([base, close])
    want, component = linked_by_brute_force(x)
    assert sum(want.values()) > 2000
    n, got, rows = linked_by_forest(spark, x, depth=8)
    assert all(n[i] <= want[i] for i in range(len(x)))  # nothing twice
    assert sum(n.values()) >= 0.97 * sum(want.values())
    assert sum(got[i] == component[i] for i in range(len(x))) >= 0.97 * len(x)
    n, got, _ = linked_by_forest(spark, x, depth=3)
    assert sum(n.values()) >= 0.999 * sum(want.values())


def test_embeddings_with_clashing_columns(spark):
    rows = [(i, [1.0 + (i % 3) * 1e-3, 0.0, float(i // 6)], 1, 2, 3, 4.0) for i in range(24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cid int, n int, leaf int, x double")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_forest.embedding_dedup(df).collect()}
    n, component = linked_by_brute_force(np.array([r[1] for r in rows], np.float32).astype(float))
    assert got == {i: (n[i], component[i]) for i in range(24)}


def test_quality_rules(docs, rows, empty):
    got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(tri)
        marked = {k + i for k, x in enumerate(tri) if n[x] > 1 for i in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert perplexity.quality_rules(empty).count() == 0


def kneser_ney_by_brute_force(texts, order=5):
    """p(byte | bytes before) by interpolated modified Kneser-Ney over dictionaries."""
    top = collections.Counter()
    for t in texts:
        b = b"\0" * (order - 1) + (t or "").encode()
        top.update(b[i : i + order] for i in range(len(b) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    steps = {}
    for k, level in levels.items():
        c = [1, *(max(1, sum(n == i for n in level.values())) for i in (1, 2, 3, 4))]
        y = c[1] / (c[1] + 2 * c[2])
        steps[k] = [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        found = {h: n for h, n in levels[k].items() if h[:-1] == g[:-1]}
        total = sum(found.values())
        if not total:
            return p(g[1:])
        taken = sum(steps[k][min(n, 3) - 1] for n in found.values())
        own = found.get(g, 0)
        return (own - steps[k][min(own, 3) - 1] if own else 0) / total + taken / total * p(g[1:])

    return p


def test_log_perplexity_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat ran", "a cat sat é on", "the dog sat on the cat", "", None, "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = kneser_ney_by_brute_force(texts)
    got = {r.doc_id: r.log_ppl for r in perplexity.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        b = b"\0" * 4 + (t or "").encode()
        want = -sum(np.log(p(b[k : k + 5])) for k in range(len(b) - 4)) / max(len(b) - 4, 1)
        assert got[i] == pytest.approx(want, abs=1e-4)
    model = perplexity.train(docs)
    for context in (b"the ", b"cat ", b"qqqq", b"\0\0\0t"):
        codes = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)])
        assert np.exp(model.log_p(codes).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    pruned = perplexity.train(docs, entries=80)
    assert sum(len(k.keys) for k in pruned.runs) <= 80
    assert np.exp(pruned.log_p(np.array([int.from_bytes(b"the " + bytes([x]), "big") for x in range(256)])).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_perplexity_bands_reject_in_every_language(spark):
    rng = np.random.default_rng(11)
    rows = []
    for lang, letters in (("en", "etaoinshrdlu"), ("ru", "оеаинтсрвлкм"), (None, "日月火水木金土山川田")):
        stock = ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(150)]
        for i in range(120):
            rows.append((len(rows), " ".join(rng.choice(stock, 80)), lang, "plain"))
        for i in range(4):
            noise = "".join(chr(c) for c in rng.integers(0x21, 0x17F, 500))
            rows.append((len(rows), " ".join(noise[k : k + 6] for k in range(0, 480, 6)), lang, "noise"))
        rows.append((len(rows), " ".join(stock[k % 7] + stock[k % 11] for k in range(100)), lang, "other"))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in perplexity.quality_rules(docs).collect()}
    of = lambda kind, lang: [kept[r[0]] for r in rows if r[3] == kind and r[2] == lang]
    for lang in ("en", "ru", None):
        assert not any(of("noise", lang)) and sum(of("plain", lang)) >= 0.97 * 120


def test_toxicity_ratio_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    stock = [f"w{i}" for i in range(40)]
    made = [" ".join(rng.choice(stock, 12)) + (" foul word" if i % 3 == 0 else " fine word") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", 1000)
    first = toxicity._order(rows, 1, 3, 1 << 20, None)
    sets = [set(t.split()) for t in made]
    seen = collections.Counter(w for s in sets for w in s)
    n = [collections.Counter(w for i, s in enumerate(sets[:60]) if (i % 3 == 0) == toxic for w in s) for toxic in (True, False)]
    total = [sum(c.values()) for c in n]
    step = [perplexity.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])[3] for c in n]
    gamma = [1 - sum(v - d for v in c.values() if v > 3) / t for c, d, t in zip(n, step, total)]

    def log_p(k, w, out=0):
        c = n[k][w] - out
        return np.log((c - step[k] if c > 3 else 0) / total[k] + gamma[k] * seen[w] / sum(seen.values()))

    for w in ("foul", "fine", "word", "w3"):
        raw = np.frombuffer(w.encode(), np.uint8)
        for label, out in ((2, (0, 0)), (1, (1, 0)), (0, (0, 1))):
            got = toxicity._ratios([first], raw, np.array([0, len(raw)]), np.array([label]))[0][0]
            known = n[0][w] - out[0] > 3 or n[1][w] - out[1] > 3
            want = log_p(0, w, out[0]) - log_p(1, w, out[1]) if known else np.log(gamma[0]) - np.log(gamma[1])
            assert got == pytest.approx(want, abs=1e-4)
    few = toxicity._order(rows, 1, 3, 20, None)
    assert len(few.keys.keys) <= 20


def test_keys_find_what_they_hold():
    from quillon.llm.common import Keys, distinct, word_hashes

    rng = np.random.default_rng(1)
    some = distinct(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    asked = np.concatenate([some[::3], rng.integers(0, 2**64, 3000, dtype=np.uint64)])
    at, where = Keys(some).find(asked)
    assert set(at.tolist()) == set(np.flatnonzero(np.isin(asked, some)).tolist()) and (some[where] == asked[at]).all()
    assert not len(Keys(np.empty(0, np.uint64)).find(asked)[0])
    raw = np.frombuffer(b"ab" * 3000 + b" x ab", np.uint8)
    h = word_hashes(raw, np.array([0, 6001, 6003]), np.array([6000, 6002, 6005]), block=64)
    assert h[2] == word_hashes(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0] and len(set(h.tolist())) == 3


def test_toxicity_and_quality(spark, docs, rows, empty):
    text = "the quiet river ran past old mills and the people there read slowly in the shade "
    made = [(i, text * (1 + i % 3) + ("vile scum idiot " * 3 if i % 4 == 0 else f"kind word{i % 9} ") + ("$$$ *** ### " * 20 if i % 5 == 0 else "")) for i in range(600)]
    made += [(None, None), (1, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (5, None, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    for f, name, want, folds, fold in ((toxicity.toxicity, "toxic", lambda i: i % 4 == 0, 4, 2), (quality_knn.quality, "quality", lambda i: i % 5 != 0, 5, 0)):
        got = f(df, labels).collect()
        assert len(got) == len(made) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        held = [r for r in got if r.held_out and r.doc_id != 1]
        assert held and all((zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in held)
        assert sum(bool(r.predicted) == want(r.doc_id) for r in held) >= 0.95 * len(held), name
        assert f(empty, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(rows)


def test_warc(spark):
    rows = [(1, "http://a/b", "x" * 200), (2, None, "x" * 200), (3, "u v", None), (4, "u", ""), (5, "u", "y" * 50), (6, "u", "y" * 50), (7, "u", "é\r\n\r\n0\r\n" * 9000), (2, "u", "x" * 200)]
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    first = {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html, page)
    want = []
    for page, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and first[html] < page
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[html] if again else 0))
    assert got == sorted(want)
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_warc_keeps_rows_that_share_a_page_id(spark, tmp_path):
    long, other = "long page " * 4000, "other " * 9000
    rows = [(1, "u", long), (1, "u", long), (1, "v", long), (2, "u", long), (2, "u", other), (2, "u", "z" * 300), (3, "u", other), (None, "u", long), (None, "u", long), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect())
    first = {long: 1, other: 2}
    want = collections.Counter()
    for page, _, html in rows:
        b = (html or "").encode()
        again = page is not None and first.get(html, page) < page
        want[page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[html] if again else None] += 1
    assert got == want
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    ids = [h["warc-record-id"] for p in (tmp_path / "warc").glob("part-*") for h, _ in warc.parsed(memoryview(gzip.decompress(p.read_bytes())))]
    assert len(ids) == len(set(ids)) > len(rows)


def test_warc_returns_incomplete_records(spark, tmp_path):
    html, digest = "long page " * 4000, hashlib.sha256(b"long page " * 4000).hexdigest()
    records = warc.page_records(1, "u", html.encode(), None)[:-1] + warc.page_records(2, "u", html.encode(), 1) + warc.page_records(3, "u", html.encode(), None)
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n" for r in records))
    got = warc.indexed(warc.read_archives(spark, str(tmp_path / "a.warc"))).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == [(1, "incomplete", None, None, None), (2, "revisit", None, None, 1), (3, "response", len(html), digest, None)]


def test_warc_reads_segments_in_any_order_and_pages_without_an_id(spark, tmp_path):
    html, other = "long page " * 4000, "é" * 12_000
    records = warc.page_records(None, "u", html.encode(), None, copy=7) + warc.page_records(4, "u", other.encode(), None)
    records = records[::-1]
    for k, part in enumerate((records[::2], records[1::2])):  # segments lie in two archives, last ones first
        (tmp_path / f"{k}.warc").write_bytes(b"".join(r + b"\r\n" for r in part))
    got = warc.indexed(warc.read_archives(spark, str(tmp_path / "*.warc"))).collect()
    want = [(None, "response", len(html), hashlib.sha256(html.encode()).hexdigest(), None), (4, "response", 24_000, hashlib.sha256(other.encode()).hexdigest(), None)]
    assert {tuple(r[c] for c in ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")) for r in got} == set(want) and len(got) == 2


def test_warc_ignores_clashing_columns(spark):
    rows = [(1, "u", "x" * 200, 5, "a", 1, "d"), (2, "u", "x" * 200, 6, "b", 2, "e")]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string, copy int, record string, refers_to int, digest string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "revisit", 1)}


def test_quality_features_of_many_empty_texts_stay_small(spark):
    import tracemalloc

    import pyarrow as pa

    space = quality_knn.latent_space(np.eye(8, quality_knn.FEATURES, dtype=np.float32), np.array([0, 1] * 4, float))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([""] * 10_000)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(len(b) for b in quality_knn._scores(type("B", (), {"value": space}))(iter([batch])))
    assert rows == 10_000 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_neighbours_that_tie_all_vote():
    space = quality_knn.latent_space(np.repeat(np.eye(2, quality_knn.FEATURES, dtype=np.float32), 60, 0), np.array([1.0] * 30 + [0.0] * 30 + [1.0] * 60))
    assert space.score(np.eye(1, quality_knn.FEATURES, dtype=np.float32))[0] == pytest.approx(0.5, abs=1e-6)


def test_token_rollup(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long"
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    one = spark.createDataFrame([("insert", "a", "en", "1", 10, None), ("insert", "a", "en", "1", 5, None), ("insert", None, None, "1", None, None)], schema)
    two = spark.createDataFrame([("delete", "a", "en", "1", 5, None), ("revise", "a", "en", "1", 12, 10)], schema)
    assert rollup.commit("one", one) and not rollup.commit("one", one) and rollup.commit("two", two) and not rollup.commit("two", two)
    got = {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert got == {("a", 1, 12), (None, 1, 0)}
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("bad", spark.createDataFrame([("drop", "a", "en", "1", 5, None)], schema))
    assert {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == got


def test_packing(docs, rows, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by[d], key=lambda r: r.piece)
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist() and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 2048 for p in parts[1:])
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for items in seq.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0] + [n for _, n in items])[:-1].tolist() and sum(n for _, n in items) <= 2048
    assert len(seq) <= 1.02 * sum(r.length for r in got) / 2048 + 2
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_bins():
    sizes = [6, 4, 5, 5, 7, 3]
    start = [[0], [1, 2], [3], [4], [5]]
    end = packing.local_search([list(b) for b in start], sizes, 10)
    assert sorted(i for b in end for i in b) == list(range(6)) and all(sum(sizes[i] for i in b) <= 10 for b in end) and len(end) < len(start)


def test_rows_without_doc_id_spread_over_groups(spark):
    """Missing and repeated doc_ids are dealt as others are, and a second run packs alike."""
    rows = [(None, 0, 1 + i * 37 % 2048) for i in range(2500)] + [(7, 0, 1 + i * 53 % 2048) for i in range(500)]
    table = packing.stored(spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(3), "pieces")
    runs = [packing.pack(table, group=1000).collect() for _ in range(2)]
    assert sorted(map(tuple, runs[0]), key=str) == sorted(map(tuple, runs[1]), key=str) and len(runs[0]) == 3000
    sizes = collections.Counter(r.sequence_id >> 32 for r in runs[0])
    assert len(sizes) == 3 and max(sizes.values()) < 1200
    fill = collections.Counter()
    for r in sorted(runs[0], key=lambda r: (r.sequence_id, r.offset)):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.LENGTH


def test_local_search_does_the_packing():
    """From next fit, squared fill rises with every step and the bins fall to within 1 % of the bound."""
    rng = np.random.default_rng(9)
    sizes = np.minimum(rng.lognormal(5.5, 1, 4000).astype(int) + 1, 2048).tolist()
    start, trace = packing.next_fit(sizes, 2048), []
    squares = sum(sum(sizes[i] for i in b) ** 2 for b in start)
    bound, before = -(-sum(sizes) // 2048), len(start)
    end = packing.local_search(start, sizes, 2048, trace)
    assert all(a < b for a, b in zip([squares, *trace], trace))
    assert trace[-1] == sum(sum(sizes[i] for i in b) ** 2 for b in end)
    assert before > 1.2 * bound and len(end) <= 1.01 * bound
    assert sorted(i for b in end for i in b) == list(range(4000)) and all(sum(sizes[i] for i in b) <= 2048 for b in end)


def test_exchanges_where_no_item_can_move():
    """One for one: 6 takes the place of 5; two for one: 3 and 2 take the place of 4; then the bin is empty."""
    for sizes, start in (([6, 5, 4, 1], [[0, 3], [1, 2]]), ([3, 2, 4, 5, 9], [[0, 1], [2, 3], [4]])):
        trace = []
        end = packing.local_search([list(b) for b in start], sizes, 10, trace)
        assert sorted(i for b in end for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 10 for b in end)
        assert trace == sorted(set(trace))


def test_byte_bpe(docs, rows, empty):
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs).collect()}
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        r = got[d]
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (t or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(empty).count() == 0
    rng = np.random.default_rng(6)
    bpe = byte_bpe.load(path)
    alphabet = list("abe \n\t'!.1") + ["é", "ß", "中", "😀", "²", "\x1c", "\x85", " ", "​", "　", "th", "'ll"]
    for _ in range(2000):
        s = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        assert bpe.encode(s).tolist() == enc.encode_ordinary(s), s


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    from quillon.llm.common import stored

    labels_dir = "/root/testdata/sf0.001"
    table = docs.select(*cp.COLUMNS)
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in table.collect()}
        table = stored(stage(spark, table, labels_dir), "stage")
        after = {r.doc_id: r.text for r in table.collect()}
        assert table.columns == cp.COLUMNS and set(after) <= set(before)
        if name != "suffix_dedup":
            assert all(after[k] == before[k] for k in after)
        else:
            lost = removed_by_brute_force(list(before.items()))
            assert all(len(before[k] or "") - len(after[k]) >= 0 and (not lost[k][1] or len(after[k]) < len(before[k])) for k in after)
    packed = cp.STAGES[-1][1](spark, table, labels_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(after)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdeghilmnoprstu"), rng.integers(3, 9))) for _ in range(60)]
    prose = lambda n=90: " ".join(rng.choice(vocabulary, n))
    rude, line = " vile scum idiot" * 4, " " + prose(25)
    made = [(i, prose() + (rude if i % 4 == 0 else "") + (line if i % 7 == 0 else "")) for i in range(300)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300)]
    text = dict(made)
    made += [(1, prose() + rude), (2, prose()), (2, prose(20)), (3, prose(20)), (4, prose())]  # of one doc_id: clean and toxic, both clean, short
    made += [(5, text[5]), (5, text[5]), (400, text[6]), (None, text[6]), (None, text[9])]  # copies
    twin = prose()
    made += [(None, prose() + rude), (None, prose(20)), (None, None), (None, ""), (None, prose()), (None, twin), (None, twin)]
    rows = [(d, t, "en", f"s{k}", len(t or "")) for k, (d, t) in enumerate(made)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    civil = [(d, t) for d, t in made if not t or rude not in t]
    numbered = spark.createDataFrame([(k, t, "en") for k, (_, t) in enumerate(civil)], "doc_id long, text string, lang string")
    inside = {r.doc_id for r in perplexity.quality_rules(numbered).where("kept").collect()}  # held against brute force elsewhere
    clean = [r for k, r in enumerate(civil) if k in inside]
    assert all(t and len(t.split()) >= 50 for _, t in clean) and len(clean) >= sum(len((t or "").split()) >= 50 for _, t in civil) - 4
    prints = [simhash_anchor.fingerprint(t) for _, t in clean]
    group = components(range(len(clean)), [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= 2])
    kept = {}
    for i, (d, t) in enumerate(clean):
        kept[group[i]] = min(kept.get(group[i], (True, 0, t)), (d is None, d or 0, t))
    kept = [(-1 if none else d, t) for none, d, t in kept.values()]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, seen, shorter = collections.Counter(), set(), 0
    for d, t in sorted(kept):
        windows = [t[p : p + 100] for p in range(len(t) - 99)]
        gone = {p + k for p, w in enumerate(windows) if w in seen for k in range(100)}
        seen.update(windows)
        shorter += bool(gone)
        ids = np.array(tok.encode("".join(x for p, x in enumerate(t) if p not in gone), add_special_tokens=False).ids + [0], "<u4")
        want[None if d == -1 else d, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == want and len(kept) > 220 and shorter > 20


def test_rollup_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", "a b c " * 60, "é" * 300, "short", "the same text again " * 30, "the same text again " * 30]
    rows = [(i, t, None if i == 2 else "en", f"s{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter(), collections.Counter()
    encoders = []
    for name in token_rollup.TOKENIZERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
        encoders.append(tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    for _, t, lang, source in rows:
        n = [len(e.encode_ordinary(t or "")) for e in encoders]
        if n[0] >= token_rollup.LEAST_TOKENS:
            for name, k in zip(token_rollup.TOKENIZERS, n):
                key = (source, lang, name.removesuffix(".tiktoken"))
                want[0][key] += 1
                want[1][key] += k
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in token_rollup.op6_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {k: (want[0][k], want[1][k]) for k in want[0]} and len(got) >= 4


def test_rollup_survives_broken_commits_and_removes_old_versions(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "1", 10, None)], schema).withColumn("batch_id", F.lit("clash"))
    path = tmp_path / "rollup"
    rollup = token_rollup.TokenRollup(spark, str(path))
    assert rollup.totals().count() == 0
    for k in range(6):
        assert rollup.commit(str(k), one)
    assert len(list(path.glob("v*"))) == 3 and len(list(path.glob("batches/*/*"))) >= 6
    for marker in path.glob(f"{token_rollup.TokenRollup._marker('5')}"):
        marker.unlink()  # as if the last commit had broken off after its version was complete
    assert not rollup.commit("5", one) and not rollup.commit("0", one)
    (path / "v7").mkdir()  # and one that broke off before
    assert rollup.commit("6", one.limit(0)) and not rollup.commit("6", one)
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(6, 60)]

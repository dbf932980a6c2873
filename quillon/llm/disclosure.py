"""Personal data, and the terms that give it away, by information-theoretic sanitisation.

Addresses, numbers and the like are found by fixed patterns. Each of their values is a protected entity c. A term t (a
word within `REACH` words of a mention) reveals c as far as their point-wise mutual information,
log2(p(c | t) / p(c)), comes near all the information that c has, -log2 p(c). p(c | t) is the share of t's occurrences in
the whole corpus that stand near c, p(c) the share of all words that do. A term whose share of the information reaches
`DISCLOSURE`, by at least `SUPPORT` different contexts, is taken out where it stands near c: generalised to its first
letters if those of all words that share them reveal less than that, else removed.

A context is the two least hashes of the words around a mention, so that copies of a passage are one piece of evidence
and near copies few, while each of a term's occurrences counts against it. Rows grow with mentions times the words in reach,
never with the pairs of a document or of an entity; the counts of the corpus are summed in each task before they are
shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read_table, rows_again, stored, with_rest

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
#: Words on either side of a mention.
REACH = 8
#: Share of an entity's information, and different contexts, from which on a term reveals it.
DISCLOSURE = 0.95
SUPPORT = 3
#: A general form has so many first letters.
PREFIX = 4
#: Different words whose counts a task holds before it hands them on.
HELD = 1 << 18

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# Whole runs of digits only: a match that starts within one would start at its first digit as well. This keeps a long
# run linear; the same holds of possessive repeats.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'#*$%&|=/\\-_+~`"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: each @ with the longest local part before it."""
    out, end, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:
        # What stands before the last @ that was looked at cannot belong to this one's local part.
        start = seen + len(text[seen:at].rstrip(_LOCAL)) if at > seen else at
        seen = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            seen = end
        at = text.find("@", seen)
    return out


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def personal(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def term_of(word: str) -> str:
    """What counts as the same term: the word in lower case without marks at its edges; digits alone are none."""
    t = word.lower().strip(_EDGE)
    return t if len(t) > 1 and not t.isdigit() else ""


def general(term: str) -> str:
    return term[:PREFIX] if len(term) > PREFIX else ""


def _hash(s: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.encode())).view(np.int64))


def _value(kind: str, found: str) -> str:
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else _digits(found)}"


def _near(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple]:
    """(entity, context, term, general form, start, end) of the terms in reach of each mention."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = (np.array(x, np.int64) for x in zip(*words))
    # A word that touches personal data is none.
    edge = np.zeros(len(text) + 1, np.int32)
    for _, a, z in base:
        edge[a] += 1
        edge[z] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    clean = covered[ends] == covered[starts]
    for kind, a, z in base:
        entity = _hash(_value(kind, text[a:z]))
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, z, "left"))
        places = [i for i in (*range(max(0, lo - REACH), lo), *range(hi, min(len(words), hi + REACH))) if clean[i]]
        terms = [(i, t) for i in places if (t := term_of(text[words[i][0] : words[i][1]]))]
        hashes = {t: _hash(t) for _, t in terms}
        least = sorted(set(hashes.values()))[:3]
        for i, t in terms:
            # Two of the other words: a term is no evidence for itself.
            x, y = ([h for h in least if h != hashes[t]] + [0, 0])[:2]
            w = text[words[i][0] : words[i][1]]
            inner = words[i][1] - len(w.lstrip(_EDGE)), words[i][0] + len(w.rstrip(_EDGE))
            yield entity, x ^ (y >> 1), hashes[t], _hash(f"{g}*") if (g := general(t)) else 0, *inner


_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64()), ("general", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_FOUND = "base array<struct<kind:string,start:long,stop:long>>, near array<struct<entity:long,context:long,term:long,general:long,start:long,stop:long>>"


def _found(keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, near = [], []
            for t in column(b, "text").to_pylist():
                spans = personal(t) if t else []
                base.append(spans)
                near.append(list(_near(t, spans)) if spans else [])
            as_rows = lambda rows, kind: pa.array([[dict(zip((f.name for f in kind.value_type), x)) for x in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in keep), as_rows(base, _BASE), as_rows(near, _NEAR)], [*keep, "base", "near"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of general forms, by hash; 0 counts all."""

    def out() -> pa.RecordBatch:
        total, terms = 0, Counter()
        for w, n in words.items():
            total += n
            if t := term_of(w.decode()):
                terms[t] += n
                if g := general(t):
                    terms[f"{g}*"] += n
        keys = np.array([0, *map(_hash, terms)], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([total, *terms.values()], pa.int64())], ["term", "n"])

    words: Counter = Counter()
    for b in batches:
        for t in column(b, "text"):
            words.update((t.as_py() or "").encode().split())  # splits as _WORD does
            if len(words) > HELD:
                yield out()
                words.clear()
    if words:
        yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """term (hash, 0: all words) and n over all texts."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _share(joint: Column, each: Column, of_entity: Column, total: Column) -> Column:
    """The share of an entity's information that a term gives."""
    information = -F.log2(of_entity / total)
    return F.when(information > 0, F.log2(F.least(joint / each, F.lit(1.0)) / (of_entity / total)) / information)


def disclosing(near: DataFrame, counts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term and generalised (whether its general form reveals less) of the pairs that reveal too much.

    near: entity, context, term and general of all terms in reach of mentions. Each side of each join is a table that is
    grouped by the join's key."""
    entities = near.groupBy("entity", "context").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("of_entity"))
    contexts = near.groupBy("entity", "term", "general", "context").agg(F.lit(1).alias("one"))
    pairs = contexts.groupBy("entity", "term", "general").agg(F.count("*").alias("joint")).where(F.col("joint") >= support)
    forms = near.where("general != 0").groupBy("entity", "general", "context").agg(F.lit(1).alias("one"))
    forms = forms.groupBy("entity", "general").agg(F.count("*").alias("form_joint"))
    words = counts.where("term = 0").first()
    total = F.lit(float(words.n if words else 1))
    rows = pairs.join(counts.withColumnRenamed("n", "each"), "term").join(entities, "entity")
    rows = rows.where(_share(F.col("joint"), F.col("each"), F.col("of_entity"), total) >= disclosure)
    rows = rows.join(forms, ["entity", "general"], "left").join(counts.select(F.col("term").alias("general"), F.col("n").alias("form_each")), "general", "left")
    less = _share(F.col("form_joint"), F.col("form_each"), F.col("of_entity"), total) < disclosure
    return rows.select("entity", "term", F.coalesce((F.col("general") != 0) & less, F.lit(False)).alias("generalised"))


def sanitised_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, texts: bool = False) -> DataFrame:
    """doc_id, base (spans by kind and start) and terms (start, stop, generalised; by start) of each row of documents;
    with `texts` also text and rest, see with_rest().

    Null and empty texts have no spans; repeated rows and null doc_ids keep a row each; an empty table returns no rows.
    A term's span in a row counts once however many mentions it gives away, and as removed if it is for one of them.
    """
    whole = with_rest(docs)
    keep = [f for f in whole.schema.fields if texts or f.name == "doc_id"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    rows = (whole if texts else whole.select("doc_id", "text")).mapInArrow(_found([f.name for f in keep]), f"{kinds}, {_FOUND}")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "disclosure")
    near = rows.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    counts = stored(term_counts(docs), "disclosure-counts")
    revealing = stored(disclosing(near.drop("row"), counts, disclosure, support), "disclosure-terms")
    hits = near.select("row", "entity", "term", "start", "stop").join(revealing, ["entity", "term"])
    hits = hits.groupBy("row", "start", "stop").agg(F.min("generalised").alias("generalised"))
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "generalised"))).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,generalised:boolean>>")
    return rows.drop("near").join(hits, "row", "left").withColumn("terms", F.coalesce("terms", none)).drop("row")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, base, terms in zip(column(b, "text").to_pylist(), column(b, "base").to_pylist(), column(b, "terms").to_pylist()):
            cuts = [(s["start"], s["stop"], f"[{s['kind']}]") for s in base]
            cuts += [(s["start"], s["stop"], f"{general(term_of(text[s['start']:s['stop']]))}*" if s["generalised"] else "[removed]") for s in terms]
            parts, at = [], 0
            for a, z, put in sorted(cuts):
                if a >= at:
                    parts += [text[at:a], put]
                at = max(at, z)
            out.append("".join([*parts, text[at:]]) if cuts else text)
        yield pa.RecordBatch.from_arrays([*(column(b, n) if n != "text" else pa.array(out, pa.string()) for n in ("doc_id", "text", "rest"))], ["doc_id", "text", "rest"])


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The rows of documents with personal data replaced by its kind, of overlapping spans by the first one's, and terms
    that give it away generalised or removed."""
    spans = sanitised_spans(docs, disclosure, support, texts=True)
    kinds = ", ".join(f"{n} {spans.schema[n].dataType.simpleString()}" for n in ("doc_id", "text", "rest"))
    return rows_again(spans.mapInArrow(_written, kinds), docs)


def _joined(kind: Column | str, spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["start"], s["stop"])), ",")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as one string, from sanitised_spans()."""
    base, terms = _joined("", "base"), _joined(TERM, "terms")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.concat(base, F.when((F.size("base") > 0) & (F.size("terms") > 0), ",").otherwise(""), terms)
    return spans.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over all documents; odd rows as in sanitised_spans()."""
    return span_digests(sanitised_spans(read_table(spark, sf_dir, "documents")))


QUERIES = {"op13_disclosure": op13_disclosure}

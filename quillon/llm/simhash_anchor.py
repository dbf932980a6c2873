"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code on 46 of the 64 fingerprint bits: two binary Golay codes [23, 12], each
perfect with covering radius 3, side by side. Every fingerprint has one home anchor within 3 bits in either half. A
partner at most 2 bits away lies within 3 + i and 3 + j bits of that anchor, with i + j <= 2, so each fingerprint is
replicated to its home and to all anchors in that reach (about 60 of 16.7 million) and compared there with the
fingerprints at home. The search is exact: no link is missed, and all 64 bits are compared.

Equal fingerprints are one row before replication, so groups of copies cost nothing, and a fingerprint then has at
most C(64,1) + C(64,2) = 2080 partners: links grow with the number of different fingerprints, never with a square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import chunks, column, cut, read_table, rows_again, stored, texts_of, with_rest
from .components import connected_components

SEED = 42
MAX_BITS = 2
_HALF = 23
_RADIUS = 3
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
_GOLAY = 0b110001110101


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's 3-word shingles, A-Z lower-cased; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(w, w[1:], w[2:]))) if len(w) > 2 else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t) for t in column(b, "text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in keep), pa.array(prints)], [*keep, "fp"])

    return run


@cache
def _cosets() -> tuple[np.ndarray, ...]:
    """Syndromes of all 2^23 bit patterns; the patterns of at most 5 bits by syndrome, lightest first, with weights
    and begins; how many of each syndrome have at most 3, 4 and 5 bits."""
    remainder = np.arange(1 << _HALF, dtype=np.uint32)
    for bit in range(_HALF - 1, 10, -1):
        remainder ^= np.where(remainder >> bit & 1, np.uint32(_GOLAY << (bit - 11)), np.uint32(0))
    patterns = np.array([sum(1 << i for i in c) for n in range(_RADIUS + MAX_BITS + 1) for c in combinations(range(_HALF), n)], np.uint32)
    weight = np.bitwise_count(patterns)
    order = np.lexsort((weight, remainder[patterns]))
    begins = np.searchsorted(remainder[patterns][order], np.arange(2049))
    patterns, weight = patterns[order], weight[order]
    upto = np.stack([np.array([np.count_nonzero(weight[begins[s] : begins[s + 1]] <= _RADIUS + r) for s in range(2048)]) for r in range(MAX_BITS + 1)])
    return remainder.astype(np.uint16), patterns, weight, begins, upto


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i counts[i] entries: its number i, and 0..counts[i]-1."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint numbers, anchors and whether the anchor is the fingerprint's home."""
    syndrome, patterns, weight, begins, upto = _cosets()
    mask = np.uint64((1 << _HALF) - 1)
    left, right = (fp & mask).astype(np.uint32), (fp >> np.uint64(_HALF) & mask).astype(np.uint32)
    s1, s2 = syndrome[left].astype(np.int64), syndrome[right].astype(np.int64)
    i, k = _ragged(begins[s1 + 1] - begins[s1])
    e1 = begins[s1[i]] + k
    owner, w1 = i, np.maximum(weight[e1].astype(np.int64) - _RADIUS, 0)
    # Patterns of a coset are sorted by weight, so those in reach of the second half are a prefix.
    j, k = _ragged(upto[MAX_BITS - w1, s2[owner]])
    e2 = begins[s2[owner[j]]] + k
    who = owner[j]
    anchor = (left[who] ^ patterns[e1[j]]).astype(np.int64) << _HALF | (right[who] ^ patterns[e2]).astype(np.int64)
    home = (weight[e1[j]] <= _RADIUS) & (weight[e2] <= _RADIUS)
    return who, anchor, home


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = column(b, "fp").to_numpy().view(np.uint64)
        for i in range(0, len(fp), 5000):
            part = fp[i : i + 5000]
            who, anchor, home = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[who].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between each anchor's fingerprints at home and all that it holds, in blocks of bounded size."""
    at_home = np.flatnonzero(home)
    lo, hi = (np.searchsorted(anchor[at_home], anchor, side) for side in ("left", "right"))
    counts = hi - lo
    some = np.flatnonzero(counts)
    total = np.cumsum(counts[some])
    start = 0
    while start < len(some):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + block, "right")))
        rows = some[start:end]
        for first in range(0, int(counts[rows].max()), block):
            i, k = _ragged(np.clip(counts[rows] - first, 0, block))
            x, y = fp[rows[i]], fp[at_home[lo[rows[i]] + k + first]]
            near = (x != y) & (np.bitwise_count(x ^ y) <= MAX_BITS)
            yield x[near].view(np.int64), y[near].view(np.int64)
        start = end


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor's rows may spread over batches."""
    held: list[tuple] = []

    def out(parts):
        for x, y in _links(*(np.concatenate(c) for c in zip(*parts))):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for b in batches:
        anchor, fp, home = column(b, "anchor").to_numpy(), column(b, "fp").to_numpy().view(np.uint64), column(b, "home").to_numpy(zero_copy_only=False)
        if not len(anchor):
            continue
        whole = int(np.searchsorted(anchor, anchor[-1], "left"))
        if held and (whole or held[-1][0][-1] != anchor[-1]):
            yield from out([*held, (anchor[:whole], fp[:whole], home[:whole])])
            held = []
        elif whole:
            yield from out([(anchor[:whole], fp[:whole], home[:whole])])
        held.append((anchor[whole:], fp[whole:], home[whole:]))
    if held:
        yield from out(held)


def simhash_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of a table of different fingerprints `fp`, at most 2 bits apart."""
    copies = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")


def _members(prints: DataFrame) -> DataFrame:
    """A table of different fingerprints `fp` with the component of each."""
    label = connected_components(simhash_links(prints), "a", "b").select(F.col("node").alias("fp"), F.col("component"))
    return prints.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of documents.

    Null and blank texts have fingerprint zero and link like any other; repeated rows return one row each; an empty
    table returns no rows; rows with a null doc_id return a row, but do not name a component (null if it has no other).
    """
    rows = cut(texts_of(docs).mapInArrow(_fingerprints(["doc_id"]), "doc_id long, fp long"))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = _members(prints)
    first = member.groupBy("component").agg(F.min("least").alias("component_id"))
    names = member.join(first, "component").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of documents per component: that of the least doc_id, a missing one being the largest; rows that
    share it are told apart by their content's hash, and equal rows by where they are stored."""
    whole = with_rest(docs)
    prints = whole.mapInArrow(_fingerprints(whole.columns), StructType([*whole.schema.fields, StructField("fp", LongType())]))
    rows = stored(prints.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "rest"), "row")
    least = cut(rows.groupBy("fp").agg(F.min(rank).alias("least")))
    first = _members(least).groupBy("component").agg(F.min("least").alias("least")).select("least.row")
    return rows_again(rows.join(first, "row", "left_semi"), docs)


def op10_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_anchor": op10_simhash_anchor}

"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are one class with a count before anything else. The trees are fitted on a bounded sample (`SAMPLE`
classes with the least hashes): every node splits by a random direction at the median. All classes are routed through
all trees, and those within `spill` of a split go to both sides; within a leaf all pairs are compared by blocked
products in double precision. A leaf larger than `LEAF_ROWS` is cut into blocks and each pair of blocks becomes a task
of its own, so no leaf has to fit one task and no pair of it is left out.

Rows know all leaves that their vector is in, so a pair counts in the first of the leaves that it shares, once. Links
are counted where they are found, and a leaf hands on a row for each of its vectors that has links: how many, and the
least vector that they lead to. What is written grows with the vectors, not with their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import column, cut, read_table, stored
from .components import connected_components

COSINE = 0.95
TREES = 5
SAMPLE = 65_536
#: Most numbers in the sample, which comes to the driver: longer vectors make it smaller.
SAMPLE_NUMBERS = 1 << 23
#: Rows that a leaf is meant to hold, and most that one task compares with one another.
LEAF, LEAF_ROWS = 256, 4096
#: Half-width of the overlap, in typical projected distances of two vectors at the least cosine.
SPILL = 0.3


@dataclass
class Tree:
    """Heap-ordered: children of node i are 2i + 1 and 2i + 2; nodes from `leaves` on are leaves."""

    direction: np.ndarray
    threshold: np.ndarray
    depth: int


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    nodes = (1 << depth) - 1
    direction = rng.standard_normal((max(nodes, 1), x.shape[1]))
    direction /= np.linalg.norm(direction, axis=1, keepdims=True)
    threshold = np.zeros(max(nodes, 1))
    member = {0: np.arange(len(x))}
    for i in range(nodes):
        rows = member.pop(i, np.empty(0, np.int64))
        p = x[rows] @ direction[i]
        threshold[i] = np.median(p) if len(p) else 0.0
        member[2 * i + 1], member[2 * i + 2] = rows[p < threshold[i]], rows[p >= threshold[i]]
    return Tree(direction.astype(np.float32), threshold.astype(np.float32), depth)


def route(tree: Tree, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs; a row near a threshold goes to both sides."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        p = np.einsum("ij,ij->i", x[row], tree.direction[node]) - tree.threshold[node]
        left, right = p < spill, p >= -spill
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def _unit(blobs: list[bytes], dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to `dim`, and their lengths."""
    size = np.array([len(b) for b in blobs], np.int64) // np.dtype(kind).itemsize
    x = np.zeros((len(blobs), dim))
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        x[of, :n] = np.frombuffer(b"".join(blobs[i] for i in of), kind).reshape(-1, n)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True), size


def _packed(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.asarray(v, kind).tobytes() for v in column(b, "vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "cid"), column(b, "n"), pa.array(blobs, pa.binary())], ["cid", "n", "x"])

    return run


_ROUTED = "leaf long, cid long, n long, x binary, leaves binary"


def _route(forest: Broadcast, dim: int, kind: str, spill: float) -> Callable:
    """A row for each leaf of each vector: tree and node, the vector's length in `leaf`, and all its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.slice(lo, 2000)
                x, size = _unit(column(part, "x").to_pylist(), dim, kind)
                x = x.astype(np.float32)
                found = [route(tree, x, spill) for tree in forest.value]
                row = np.concatenate([r for r, _ in found])
                code = np.concatenate([node + (t << 24) for t, (_, node) in enumerate(found)]).astype(np.int32)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                begin = np.searchsorted(row, np.arange(len(part) + 1))
                leaves = pa.array([code[a:z].tobytes() for a, z in zip(begin, begin[1:])], pa.binary())
                index = pa.array(row)
                leaf = pa.array((size[row] << 32) + code)
                yield pa.RecordBatch.from_arrays([leaf, *(column(part, n).take(index) for n in ("cid", "n", "x")), leaves.take(index)], ["leaf", "cid", "n", "x", "leaves"])

    return run


def _earlier(leaves: list[bytes], code: int) -> np.ndarray:
    """Of each vector the leaves before this one, as rows of equal length filled up with what equals nothing."""
    own = [np.frombuffer(b, np.int32) for b in leaves]
    own = [c[c < code] for c in own]
    out = np.full((len(own), max(map(len, own), default=0)), -1, np.int32)
    for i, c in enumerate(own):
        out[i, : len(c)] = c
    return out


def _met_before(earlier: np.ndarray, r: np.ndarray, c: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """Which pairs share an earlier leaf."""
    out = np.zeros(len(r), bool)
    for lo in range(0, len(r), most):
        x, y = earlier[r[lo : lo + most]], earlier[c[lo : lo + most]]
        for k in range(earlier.shape[1]):
            out[lo : lo + most] |= ((x[:, k, None] == y) & (x[:, k, None] >= 0)).any(1)
    return out


def _least_label(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least row that each row's links lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, r, label[c])
        np.minimum.at(label, c, label[r])
        label = label[label]
        if (label == before).all():
            return label


def _compare(dim: int, kind: str, cosine: float, block: int = 1024) -> Callable:
    def links(code: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        cid, side, n = (np.concatenate([h[k] for h in rows]) for k in (0, 1, 2))
        order = np.argsort(cid)
        cid, side, n = cid[order], side[order], n[order]
        blobs, leaves = (sum((h[k] for h in rows), []) for k in (3, 4))
        x, _ = _unit([blobs[i] for i in order], dim, kind)
        earlier = _earlier([leaves[i] for i in order], code)
        linked, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for i in range(0, len(cid), block):
            for j in range(i, len(cid), block):
                r, c = np.nonzero(x[i : i + block] @ x[j : j + block].T >= cosine)
                r, c = r + i, c + j
                # of a pair of blocks, only what lies across; within a block (side 0), all; each pair one way round
                ok = (r < c) & ((side[r] == 0) | (side[r] != side[c]))
                r, c = r[ok], c[ok]
                new = ~_met_before(earlier, r, c)
                r, c = r[new], c[new]
                linked += np.bincount(r, n[c], len(cid)).astype(np.int64) + np.bincount(c, n[r], len(cid)).astype(np.int64)
                if len(r):
                    label = np.minimum(label, _least_label(len(cid), np.concatenate([r, label]), np.concatenate([c, np.arange(len(cid))])))
        some = np.flatnonzero(linked)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[label[some]]), pa.array(linked[some])], ["a", "b", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            leaf, part = column(b, "leaf").to_numpy(), column(b, "part").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(leaf)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if (leaf[lo], part[lo]) != now and held:
                    yield from links(int(now[0]) & 0xFFFFFFFF, held)
                    held = []
                now = (leaf[lo], part[lo])
                s = b.slice(lo, hi - lo)
                held.append((*(column(s, n).to_numpy() for n in ("cid", "side", "n")), column(s, "x").to_pylist(), column(s, "leaves").to_pylist()))
        if held:
            yield from links(int(now[0]) & 0xFFFFFFFF, held)

    return run


def forest_links(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, leaf_rows: int = LEAF_ROWS, seed: int = 11, kind: str = "<f8", depth: int | None = None) -> DataFrame:
    """Of a table (cid, n: how many equal vectors, x: numbers of `kind` as bytes) of different finite non-zero vectors:
    rows (a, b, linked) of vector a in a leaf, the least vector b that its links there lead to, and how many equal
    vectors its links there lead to. Summed over a's rows, `linked` is exact; all b together connect all links."""
    spark = classes.sparkSession
    n, longest = classes.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    dim = (longest or 8) // np.dtype(kind).itemsize
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))
    sample, _ = _unit([r.x for r in classes.orderBy("cid").limit(most).select("x").collect()], dim, kind)
    if depth is None:
        depth = max(0, min(math.ceil(math.log2(max(n, 1) / leaf)), int(math.log2(max(len(sample), 8) / 8))))
    spill = SPILL * math.sqrt(2 * (1 - cosine) / dim)
    rng = np.random.default_rng(seed)
    forest = spark.sparkContext.broadcast([grow(sample, depth, rng) for _ in range(trees)])
    routed = classes.mapInArrow(_route(forest, dim, kind, spill), _ROUTED)
    # Large leaves are at most all leaves of all trees for each length of vectors: few enough to broadcast.
    large = routed.groupBy("leaf").count().where(F.col("count") > leaf_rows)
    blocks = cut(large.select("leaf", F.ceil(F.col("count") * 2 / leaf_rows).cast("int").alias("blocks")))
    if blocks.count() <= trees << 14:
        blocks = F.broadcast(blocks)
    routed = routed.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int")
    dealt = routed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # (own, other) and (other, own) are one task; side tells its two blocks apart, 0 where it is one block
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("leaf", part.alias("part"), side.alias("side"), "cid", "n", "x", "leaves")
    return dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(_compare(dim, kind, cosine), "a long, b long, linked long")


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of embeddings.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Repeated rows count as vectors of their own. Rows without a vec_id link with nothing and
    have no component. An empty table returns no rows.
    """
    item = embeddings.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(item, FloatType) else "<f8"  # floats are kept as they are; all products are of doubles
    vec = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("cid", F.when(valid, F.xxhash64("vec")))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    sizes = cut(rows.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")))
    packed = stored(classes.select("cid", "n", "vec").mapInArrow(_packed(kind), "cid long, n long, x binary"), "vectors")
    links = cut(forest_links(packed, cosine, kind=kind))
    label = connected_components(links, "a", "b").withColumnRenamed("node", "cid")
    member = sizes.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = member.groupBy("component").agg(F.min("least").alias("component_id"))
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("linked").alias("linked"))
    named = member.join(first, "component").join(counts, "cid", "left")
    named = named.select("cid", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all embeddings; nulls, ties and empty tables as in embedding_dedup()."""
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_forest": op2_embedding_forest}

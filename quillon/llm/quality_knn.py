"""Quality by nearest-neighbour voting in a latent-semantic space.

Features are hashed counts of symbol pairs (4096 kinds), log-scaled and weighted by rarity. A bounded sample of
labelled training rows (`SAMPLE`, those with the least hash of their doc_id) gives the latent-semantic axes (a
truncated SVD) and the labelled vectors, which are broadcast: SAMPLE x AXES numbers, whatever the corpus holds. Every
document's vector is compared with all of them by exact blocked matrix products, and its most similar neighbours
vote with their similarities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, column, read_table, texts_of
from .symbols import SYMBOLS, codes
from .toxicity import labelled, remainder

FEATURES = SYMBOLS**2
SAMPLE = 4096
AXES = 64
NEIGHBOURS = 32
THRESHOLD = 0.3
#: Rows whose features are held at a time, and rows in a block of products: 256 x 4096 counts of 8 bytes are 8 MB.
BLOCK = 256
#: Similarities count by this power, so that close neighbours outweigh the many of the same language.
SHARPNESS = 8


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per text: log(1 + count) of each symbol pair, relative to the text's length."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(owner * FEATURES + codes(raw, at, 2), minlength=n * FEATURES).reshape(n, FEATURES)
    share = counts / np.maximum(np.diff(at), 1)[:, None]
    return np.log1p(1000 * share).astype(np.float32)


@dataclass
class Space:
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; all that tie with the last of the
        `NEIGHBOURS` vote too."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), BLOCK):
            cos = self.project(x[i : i + BLOCK]) @ self.vectors.T
            least = np.partition(cos, -k, axis=1)[:, -k, None]
            row, near = np.nonzero(cos >= least)
            w = np.maximum(cos[row, near], 0).astype(np.float64) ** SHARPNESS + 1e-9
            out[i : i + BLOCK] = np.bincount(row, w * self.labels[near], len(cos)) / np.bincount(row, w, len(cos))
        return out


def latent_space(x: np.ndarray, y: np.ndarray, axes: int = AXES, seed: int = 7) -> Space:
    """Rarity weights, the leading right singular vectors (randomised subspace iteration), and the labelled vectors."""
    if not len(x):
        return Space(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), y)
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    a = x * weight
    rng = np.random.default_rng(seed)
    k = min(axes + 16, min(a.shape))
    q = np.linalg.qr(a @ rng.standard_normal((a.shape[1], k)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    v = np.linalg.svd(q.T @ a, full_matrices=False)[2][:axes].T
    space = Space(weight, np.ascontiguousarray(v, np.float32), np.empty(0), y)
    space.vectors = space.project(x)
    return space


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, at in chunks(column(b, "text"), rows=BLOCK):
            rows = [r.tobytes() for r in features(raw, at)]
            yield pa.RecordBatch.from_arrays([column(b, "label")[lo:hi], pa.array(rows, pa.binary())], ["label", "x"])


def _scores(space: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.empty(0)]
            for _, _, raw, at in chunks(column(b, "text"), rows=BLOCK):
                out.append(space.value.score(features(raw, at)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, name: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of documents.

    Null and empty texts are scored as a vector of zeros; repeated rows are scored alike; without labels all scores
    are 0.5; an empty table returns no rows.
    """
    fold = remainder(folds)
    rows = labelled(docs, labels.where(fold != held_out), name, sample).where("label is not null").select("label", "text")
    t = rows.mapInArrow(_sampled, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    space = docs.sparkSession.sparkContext.broadcast(latent_space(x, t.column("label").to_numpy().astype(float)))
    scored = texts_of(docs).mapInArrow(_scores(space), "doc_id long, score double")
    out = scored.withColumn("held_out", F.coalesce(fold == held_out, F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents; nulls, ties and empty tables as in quality()."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality_knn": op7_quality_knn}

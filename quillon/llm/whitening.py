"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers. The fit list (each different vector once) is written to the shared folder; its sums are
exact integers, and each row is centred as (n x - S) / n, where n x - S is exact, so that a large common offset costs
no digits. `RowMatrix.computeSVD` over the centred rows gives the components; squared singular values over n are the
eigenvalues of the covariance. The total variance is summed apart from that, from the exact squared deviations.

All components are asked for, for which MLlib takes the dense decomposition of the Gramian (dims x dims numbers on the
driver, summed in a tree) and not its iterative one, which stops at a tolerance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, column, read_table, stored

#: Entries are counted in steps of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Singular values below this share of the largest one are noise of the Gramian: no such component is returned.
NOISE = 1e-7
_WIDE = pa.decimal128(38, 0)


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (long entries) of the rows whose vector has no null or non-finite entry and the length that most
    rows have (of lengths that tie, the longest)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    rows = rows.where(F.size("v") == (length.n if length else 0))
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * SCALE)).alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = column(b, "x")
    return x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.empty((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and the sum of each dimension, one batch's sums in 64 bits only where they fit."""
    schema = pa.schema([("dim", pa.int32()), ("rows", pa.int64()), ("total", _WIDE)])
    for b in batches:
        x = _matrix(b)
        if len(x):
            fits = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 1 << 62
            total = [Decimal(int(t)) for t in (x if fits else x.astype(object)).sum(0)]
            yield batch_of(schema, list(range(len(total))), [len(x)] * len(total), total)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit where they and their squares' sum fit, else Python's integers."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most**2 * len(sums) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(d: np.ndarray, n: int) -> np.ndarray:
    return np.array(d / n, np.float64)


def _fit_rows(n: int, sums: list[int]) -> Callable:
    schema = pa.schema([("c", pa.list_(pa.float64())), ("deviation", _WIDE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _deviations(_matrix(b), n, sums)
                c = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(_centred(d, n).ravel()))
                yield pa.RecordBatch.from_arrays([c, _squares(d)], schema=schema)

    return run


def _squares(d: np.ndarray) -> pa.Array:
    total = (d * d).sum(1)
    return pa.array(total, pa.int64()).cast(_WIDE) if total.dtype != object else pa.array([Decimal(int(t)) for t in total], _WIDE)


def _whitened(n: int, sums: list[int], axes: np.ndarray, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _deviations(_matrix(b), n, sums)
                w = _centred(d, n) @ axes
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), _squares(d), *map(pa.array, w.T)], [*keep, "deviation", *(f"w{i}" for i in range(w.shape[1]))])

    return run


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row per remaining vector and component: vec_id, component (from 1), n, deviation (decimal, exact), whitened,
    explained and identity_error.

    Rows whose vector is null, empty, of another length than most or holds a null or non-finite entry are dropped; null
    and repeated vec_ids keep their rows; an entry beyond 64 bits counts as the largest one. Equal eigenvalues may come
    in any rotation. Without a row, or where all vectors are equal, there is no component and no row is returned; there
    are fewer components than asked for where the vectors span fewer. A component's largest entry is positive.
    """
    spark = table.sparkSession
    rows = whole_vectors(table, vector)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    parts = fit.mapInArrow(_sums, "dim int, rows long, total decimal(38,0)")
    totals = parts.groupBy("dim").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).orderBy("dim").collect()
    ids = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not totals:
        return spark.createDataFrame([], ids)
    n, sums, dims = totals[0].rows, [int(t.total) for t in totals], len(totals)
    centred = stored(fit.mapInArrow(_fit_rows(n, sums), "c array<double>, deviation decimal(38,0)"), "whitening-centred")
    whole = centred.agg(F.sum("deviation")).first()[0]
    if not whole:
        return spark.createDataFrame([], ids)
    variance = float(Decimal(whole) / Decimal(n) ** 3)
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("c")), "c")
    svd = RowMatrix(vectors, n, dims).computeSVD(dims, False, NOISE)
    e = svd.s.toArray()[:components] ** 2 / n
    axes = svd.V.toArray()[:, : len(e)]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(e))])
    names = [f"w{i}" for i in range(len(e))]
    kinds = ", ".join(f"{w} double" for w in names)
    scaled = axes / np.sqrt(e)
    seen = fit.mapInArrow(_whitened(n, sums, scaled, []), f"deviation decimal(38,0), {kinds}")
    pairs = [(i, j) for i in range(len(e)) for j in range(i + 1)]
    covariance = seen.agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))
    out = rows.mapInArrow(_whitened(n, sums, scaled, ["vec_id"]), f"vec_id long, deviation decimal(38,0), {kinds}")
    each = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.col(w).alias("whitened"), F.lit(float(e[i]) / variance).alias("explained")) for i, w in enumerate(names)))
    out = out.select("vec_id", "deviation", F.explode(each).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over all embeddings; odd rows as in whiten(). A deviation beyond 64 bits is null here and whole in
    deviation_exact."""
    out = whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation_exact", F.col("deviation").cast("string")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {"op11_whitening": op11_whitening}

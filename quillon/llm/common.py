"""Helpers that the training-data operators share: input columns, shared storage, byte chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again (compressed, unlike checkpoint())."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, in that order; whatever other columns there are stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_rest(docs: DataFrame) -> DataFrame:
    """doc_id as long, text, and the other columns in a struct `rest`: whole rows, for operators that hand them on."""
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))


def rows_again(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of with_rest() that `found` still has, with the columns and types of `docs`."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return found.select(*(F.col(c).cast(kinds[c]).alias(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and the len+1 offsets of the texts; nulls are empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(array: pa.Array, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi), at most `rows`, whose texts hold about `most` bytes (a longer text stands alone), with bytes and
    offsets."""
    raw, at = utf8(array)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, lo + rows)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Random 64-bit values of the bytes, from a fixed rule.
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word [^\\x20\\x09-\\x0D]+; no word crosses from one text to the next."""
    solid = ~IS_BLANK[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = solid
    inner = at[1:-1]
    starts = solid & ~before[:-1]
    cutting = inner[inner < len(raw)]
    starts[cutting] = solid[cutting]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = cutting[cutting > 0] - 1
    ends[last] = solid[last]
    lo = np.flatnonzero(starts)
    hi = np.flatnonzero(ends) + 1
    return lo, hi, np.searchsorted(at, lo, "right") - 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of the hash's factor and of its inverse modulo 2^64."""
    out = []
    for factor in (int(_POWER), pow(int(_POWER), -1, 1 << 64)):
        p = np.full(n, factor, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of a running polynomial sum, shifted to the word's start; a
    block of text at a time."""
    out = np.empty(len(lo), np.uint64)
    first = 0
    while first < len(lo):
        base = int(lo[first])
        last = max(first + 1, int(np.searchsorted(hi, base + block, "right")))
        part = BYTE_HASH[raw[base : hi[last - 1]]]
        size = max(block, 1 << (len(part) - 1).bit_length())
        power, inverse = _powers(size) if size == block else _powers.__wrapped__(size)  # for one very long word
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        a, z = lo[first:last] - base, hi[first:last] - base
        out[first:last] = (total[z] - total[a]) * inverse[a]
        first = last
    return mixed(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of an array, sorted (a plain sort is several times faster here than numpy.unique)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Keys:
    """A sorted array of 64-bit hashes, searched from where the top bits of a hash begin; a search of n hashes takes
    as many vector steps as the fullest of those ranges holds keys, two or three for most."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - max(8, min(22, int(len(keys)).bit_length())))
        tops = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.begin = np.concatenate([[0], np.cumsum(tops)]).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are keys (their numbers, ascending), and which keys they are."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.begin[top], self.begin[top + 1]
        found = np.full(len(h), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, want = at[open_], end[open_], h[open_]
        while len(open_):
            key = self.keys[at]
            hit = key == want
            found[open_[hit]] = at[hit]
            on = key < want
            at += 1
            on &= at < end
            open_, at, end, want = open_[on], at[on], end[on], want[on]
        hit = np.flatnonzero(found >= 0)
        return hit, found[hit]

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        out[self.find(h)[0]] = True
        return out


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

"""Token counts kept as delta-maintained rollups.

Totals are additive by source, language and tokenizer version. Inserts, deletes and revised counts come as signed
deltas in batches; a commit adds a batch's sums to the totals and writes them as a new version that names its batch,
complete only with Spark's success marker. Then the batch gets a marker file of its own, in a folder by its hash, so to
know a batch takes one look-up however many there are. A batch that is known is not added again; a commit that broke
off before its version was complete leaves the version before in force, one that broke off after it is found by the
batch that the last version names. So batches may be replayed at will.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read_table, shared_dir, stored

KEYS = ["source", "lang", "tokenizer_version"]
_STATE = "batch_id string, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Kinds of change and the sign of their documents; a revision changes tokens alone.
SIGNS = {"insert": 1, "delete": -1, "revise": 0}


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (kind, source, lang, tokenizer_version, n_tokens and, for revisions, old_n_tokens).

    Null counts are 0; null keys are a group of their own; unknown kinds raise an error; no changes give no rows.
    """
    kind = F.col("kind")
    n, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "old_n_tokens"))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "delete", -n).when(kind == "revise", n - old).otherwise(n)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class TokenRollup:
    """Versions of a rollup in a folder on any file system that Spark reads."""

    #: Complete versions that are kept; older totals are removed.
    KEPT = 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        """The complete versions, in order."""
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def _state(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/v{versions[-1]}")

    @staticmethod
    def _marker(batch_id: str) -> str:
        name = hashlib.sha256(batch_id.encode()).hexdigest()
        return f"batches/{name[:3]}/{name}"

    def _mark(self, batch_id: str) -> None:
        self._fs.create(self._at(self._marker(batch_id)), True).close()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, without effect, where it has been committed before. An empty batch counts as committed."""
        versions = self._versions()
        state = self._state(versions)
        last = state.where("batch_id is not null").first()
        if last is not None:
            self._mark(last["batch_id"])  # its commit may have broken off before it could
        if self._fs.exists(self._at(self._marker(batch_id))):
            return False
        totals = state.where("batch_id is null").drop("batch_id").unionByName(signed(changes))
        totals = totals.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")
        named = self.spark.createDataFrame([(batch_id,)], "batch_id string")
        rows = totals.unionByName(named, allowMissingColumns=True).select("batch_id", *KEYS, "n_docs", "n_tokens")
        rows.write.mode("overwrite").parquet(f"{self.path}/v{(versions or [0])[-1] + 1}")
        self._mark(batch_id)
        for old in versions[: -self.KEPT + 1]:
            self._fs.delete(self._at(f"v{old}"), True)
        return True

    def totals(self) -> DataFrame:
        return self._state(self._versions()).where("batch_id is null").drop("batch_id")


@cache
def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(paths: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                text = [t or "" for t in column(part, "text").to_pylist()]
                counts = [pa.array([len(_encoder(p).encode_ordinary(t)) for t in text], pa.int64()) for p in paths]
                yield pa.RecordBatch.from_arrays([column(part, "source"), column(part, "lang"), column(part, "bytes"), *counts], ["source", "lang", "bytes", *(f"n{i}" for i in range(len(paths)))])

    return run


#: Rank files of the query's two tokenizers; the file's name is the tokenizer version.
TOKENIZERS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Bytes of a token in a provisional count.
BYTES_A_TOKEN = 4
#: Documents of fewer tokens of the first tokenizer are deleted again.
LEAST_TOKENS = 64


def token_counts(docs: DataFrame, names: tuple[str, ...] = TOKENIZERS) -> DataFrame:
    """source, lang, bytes and n0, n1, ... (tokens of each tokenizer) of each row of documents; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    schema = "source string, lang string, bytes long, " + ", ".join(f"n{i} long" for i in range(len(names)))
    return rows.mapInArrow(_counted([public_tokenizers.path(n) for n in names]), schema)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches over all documents, the first of them
    replayed: provisional counts (from the bytes) of the first tokenizer, counts of the second, revised counts of the
    first, now that the texts are encoded, and deletes of short documents from both.

    Null texts are empty, with no tokens; null sources and languages are groups of their own; repeated rows count as
    often as they are there; an empty table gives no rows.
    """
    docs = stored(token_counts(read_table(spark, sf_dir, "documents")).withColumn("guess", F.ceil(F.col("bytes") / BYTES_A_TOKEN).cast("long")), "counts")

    def changes(kind: str, version: int, n: str, old: str | None = None) -> DataFrame:
        name = F.lit(TOKENIZERS[version].removesuffix(".tiktoken")).alias("tokenizer_version")
        return docs.select(F.lit(kind).alias("kind"), "source", "lang", name, F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_n_tokens"), F.col("n0").alias("size"))

    inserts = changes("insert", 0, "guess")
    short = [changes("delete", k, f"n{k}").where(F.col("size") < LEAST_TOKENS) for k in (0, 1)]
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for batch, rows in (
        ("1-insert", inserts),
        ("2-insert", changes("insert", 1, "n1")),
        ("3-revise", changes("revise", 0, "n0", "guess")),
        ("1-insert", inserts),
        ("4-delete", reduce(DataFrame.unionByName, short)),
    ):
        rollup.commit(batch, rows)
    return rollup.totals()


QUERIES = {"op6_token_rollup": op6_token_rollup}

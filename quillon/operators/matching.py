"""Dictionary matching by a join of word n-grams, for dictionaries of any size.

Words are runs of letters and digits of the lower-case text. Every run of as many words as some entry has is hashed
(two independent 64-bit hashes) and joined with the hashed entries, so cost does not grow with the dictionary. While
the entries are few enough to broadcast (their number is counted first), runs that are none are dropped where they
arise; beyond that all runs go through the join. Of overlapping hits the leftmost, at one place the longest, stays, as
a longest-first alternation would find them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources.tables import materialised

#: Entries whose hashes are broadcast, 8 bytes each; more are joined.
BROADCAST = 1 << 20
#: Words of the longest entry.
LONGEST = 8
_FOUND = "word int, n int, start int, stop int, h1 long, h2 long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def plain(text: Column) -> Column:
    """Lower case, with a blank for each character that is neither letter nor digit: places stay as they are."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " ")


def surface_key(text: Column) -> Column:
    """A surface as its words with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Owner, number in its text, start and stop (code points) and two hashes of each word of plain texts."""
    pieces = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
    flat = pieces.flatten()
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    stop = np.cumsum(size + 1) - 1
    first = np.searchsorted(owner, np.arange(len(texts)))
    base = np.append(stop, 0)[np.minimum(first, len(stop))] - np.append(size, 0)[np.minimum(first, len(size))]
    stop = stop - base[owner]
    real = size > 0
    coded = flat.filter(pa.array(real)).dictionary_encode()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    hashes = [np.array([xxhash.xxh64_intdigest(w, seed) for w in distinct], np.uint64) for seed in (1, 2)]
    index = coded.indices.to_numpy()
    owner, start, stop = owner[real], (stop - size)[real], stop[real]
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner, number, start, stop, *(h[index] if len(h) else np.empty(0, np.uint64) for h in hashes)


def _runs(lengths: list[int], known: Callable[[np.ndarray], np.ndarray] | None, keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):  # bounds what a batch's runs take
                owner, number, start, stop, *words = _words(b.column(b.schema.get_field_index("_plain")))
                both = words
                for n in range(1, max(lengths, default=0) + 1):
                    if n > 1:
                        both = [_mixed(h[:-1] * np.uint64(3)) + w[n - 1 :] for h, w in zip(both, words)]
                    if n not in lengths or not len(both[0]):
                        continue
                    here = np.flatnonzero(owner[: len(both[0])] == owner[n - 1 :])
                    h1 = both[0][here].view(np.int64)
                    if known is not None:
                        hit = known(h1)
                        here, h1 = here[hit], h1[hit]
                    if len(here):
                        who = pa.array(owner[here])
                        cols = [number[here], np.full(len(here), n), start[here], stop[here + n - 1]]
                        yield pa.RecordBatch.from_arrays(
                            [*(b.column(b.schema.get_field_index(k)).take(who) for k in keys), *(pa.array(c.astype(np.int32)) for c in cols), pa.array(h1), pa.array(both[1][here].view(np.int64))], [*keys, *_NAMES]
                        )

    return run


class _Known:
    """Membership in a sorted broadcast array."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, h: np.ndarray) -> np.ndarray:
        keys = self.shared.value
        if not len(keys):
            return np.zeros(len(h), bool)
        return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def word_runs(texts: DataFrame, key: str, text: str, lengths: list[int], known: Callable | None = None) -> DataFrame:
    """key, word (number from 0), n, start, stop (code points of the lower-case text) and two hashes of the runs of
    words of the given lengths. Null texts have none."""
    rows = texts.select(key, plain(F.col(text)).alias("_plain"))
    kind = StructType([rows.schema[key]]).simpleString()[len("struct<") : -1].replace(":", " ", 1)
    return rows.mapInArrow(_runs(lengths, known, [key]), f"{kind}, {_FOUND}")


def entries(dictionary: DataFrame) -> DataFrame:
    """The dictionary's rows whose surface has one to LONGEST words, with n and the hashes of the whole surface."""
    clean = dictionary.withColumn("surface", surface_key(F.col("surface"))).where("surface != ''").withColumn("n", F.size(F.split("surface", " "))).where(F.col("n") <= LONGEST)
    runs = word_runs(clean.select("surface").distinct(), "surface", "surface", list(range(1, LONGEST + 1))).where("word = 0")
    return clean.join(runs.select("surface", "n", "h1", "h2"), ["surface", "n"])


def hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, most: int = BROADCAST) -> DataFrame:
    """key, word, n, start, stop and the entry's columns for every occurrence of every entry, overlapping ones too.

    dictionary: `surface` and any other columns; entries with the same words are an occurrence each."""
    known, spark = entries(dictionary), texts.sparkSession
    sizes = known.groupBy("n").agg(F.count("*").alias("entries")).collect()  # at most LONGEST rows
    lengths, total = sorted(r.n for r in sizes), sum(r.entries for r in sizes)
    keep = None
    if total <= most:
        keys = known.select("h1").distinct().toArrow().column("h1").to_numpy() if total else np.empty(0, np.int64)
        keep = _Known(spark.sparkContext.broadcast(np.sort(keys)))
    runs = word_runs(texts, key, text, lengths, keep)
    return runs.join(known, ["h1", "h2", "n"]).drop("h1", "h2")


def longest(found: DataFrame, key: str) -> DataFrame:
    """The hits that a scan from the left keeps: at each place the longest, then on from its end.

    Hits are put into clusters of overlapping ones by a window over each text's hits, and only a cluster is scanned."""
    at = Window.partitionBy(key).orderBy("word")
    rows = found.withColumn("_most", F.max("n").over(at.rangeBetween(0, 0))).where("n = _most").drop("_most")
    end = F.max(F.col("word") + F.col("n")).over(at.rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.coalesce(end, F.lit(0)) <= F.col("word")).cast("int"))
    # Several entries at one place are one step of the scan.
    rows = rows.withColumn("_group", F.max(F.when(F.col("_new") == 1, F.col("word"))).over(at.rangeBetween(Window.unboundedPreceding, 0)))
    others = [c for c in found.columns if c not in (key, "word", "n")]
    packed = rows.groupBy(key, "_group").agg(F.sort_array(F.collect_list(F.struct("word", "n", *others))).alias("h"))
    empty = F.slice("h", F.lit(1), F.lit(0))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("end"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        takes = (x["word"] == acc["at"]) | (x["word"] >= acc["end"])
        return F.struct(F.when(takes, x["word"]).otherwise(acc["at"]).alias("at"), F.when(takes, x["word"] + x["n"]).otherwise(acc["end"]).alias("end"), F.when(takes, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    kept = packed.select(key, F.explode(F.aggregate("h", start, step, lambda acc: acc["out"])).alias("x"))
    return kept.select(key, *(F.col(f"x.{c}").alias(c) for c in ("word", "n", *others)))


def dictionary_spans(texts: DataFrame, key: str, text: str, dictionary: DataFrame, most: int = BROADCAST) -> DataFrame:
    """key, word, n, start, stop and the entry's columns of the non-overlapping, longest-first occurrences."""
    return longest(hits(texts, key, text, dictionary, most), key)


def spans_of_each(texts: DataFrame, key: str, text: str, dictionaries: list[DataFrame], most: int = BROADCAST) -> list[DataFrame]:
    """dictionary_spans() of several dictionaries, which know nothing of each other; the texts are read once."""
    every = dictionaries[0].withColumn("_of", F.lit(0))
    for i, d in enumerate(dictionaries[1:], 1):
        every = every.unionByName(d.withColumn("_of", F.lit(i)), allowMissingColumns=True)
    found = materialised(hits(texts, key, text, every, most), "hits")
    return [longest(found.where(F.col("_of") == i).select(key, "word", "n", "start", "stop", *d.columns), key) for i, d in enumerate(dictionaries)]


def negated(spans: DataFrame, cues: DataFrame, key: str, reach: int = 6) -> DataFrame:
    """Spans with `negated`: of the `reach` words before a span, a trigger stands after the last terminator, and no
    phrase that only looks like a negation is among them.

    cues: key, word, n and `cue` (trigger, terminator or pseudo), as dictionary_spans() finds them."""
    both = spans.withColumn("cue", F.lit(None).cast("string")).unionByName(cues.select(key, (F.col("word") + F.col("n") - 1).alias("word"), "cue"), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("word").rangeBetween(-reach, -1)
    last = lambda cue: F.max(F.when(F.col("cue") == cue, F.col("word"))).over(before)
    judged = (F.coalesce(last("trigger"), F.lit(-1)) > F.coalesce(last("terminator"), F.lit(-1))) & last("pseudo").isNull()
    return both.withColumn("negated", judged).where("cue is null").drop("cue")

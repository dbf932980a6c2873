"""Exact similarity joins of different terms by prefix, length and position filters over rarest-first grams.

Two sets that must share c grams share one among the first n - c + 1 of each, in any common order of grams. Rarest first
keeps those prefixes to grams that few terms have, so no gram brings a large share of the candidates. All joins are
equi-joins; terms are compared once, whatever the number of rows that hold them.

Where the right side is a dictionary (`INDEX` bounds it, its grams are counted first), every task gets its inverted
index instead, and the shared grams of each term with each entry of a fitting size are counted outright: no candidates
are shuffled, and cost grows with the left side alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.tables import materialised

#: Grams of the right side (all entries together), and pairs of sizes, up to which its index is broadcast, 16 bytes a gram
#: and the entries' text; beyond either the sides are joined.
INDEX = 1 << 20
#: Counters and counted grams that a task holds at a time.
_COUNTERS = 1 << 18


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def numbered_grams(text: Column, size: int, pad: int) -> Column:
    """Character n-grams of a text with `pad` marks on either side, sorted; the second of equal ones is told from the
    first by its number. A null text has none (null)."""
    padded = F.concat(F.repeat(F.lit("\x01"), F.lit(pad)), text, F.repeat(F.lit("\x02"), F.lit(pad)))
    plain = lambda p: F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (size - 1), F.lit(1))), lambda i: F.substring(p, i, F.lit(size))))
    numbered = lambda grams: F.transform(grams, lambda g, i: F.concat(g, (i + 2 - F.array_position(grams, g)).cast("string")))
    return _bound(padded, lambda p: _bound(plain(p), numbered))


def _rarest_first(x: DataFrame, key: str, seen: DataFrame) -> DataFrame:
    rows = x.select(key, F.explode("grams").alias("gram")).join(seen, "gram")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda g: g["id"]).alias("grams"))


def _gram_arrays(size: int, pad: int) -> Callable:
    """numbered_grams() of a column of terms, for up to three characters a gram and at least as many marks as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = "\x01" * pad, "\x02" * pad
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                text = b.column(0).to_pylist()
                point = np.frombuffer("".join(before + t + after for t in text).encode("utf-32-le"), np.uint32).astype(np.int64)
                many = np.array([len(t) for t in text], np.int64) + 2 * pad - size + 1
                end = np.cumsum(many)
                owner = np.repeat(np.arange(len(text)), many)
                at = np.arange(len(owner)) + owner * (size - 1)
                code = np.zeros(len(owner), np.int64)
                for k in range(size):
                    code = (code << 21) | point[at + k]
                order = np.lexsort((code, owner))
                new = np.ones(len(order), bool)
                new[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                step = np.arange(len(order))
                number = step - np.maximum.accumulate(np.where(new, step, 0)) + 1
                kind, where = np.unique(code[order], return_inverse=True)
                name = pa.array(["".join(chr((c >> 21 * k) & 0x1FFFFF) for k in range(size - 1, -1, -1)) for c in kind.tolist()], pa.string())
                most = int(number.max(initial=0))
                flat = pc.binary_join_element_wise(name.take(pa.array(where)), pa.array([str(i) for i in range(most + 1)]).take(pa.array(number)), "")
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), grams], [b.schema.names[0], "grams"])

    return run


def _with_grams(terms: DataFrame, key: str, size: int, pad: int) -> DataFrame:
    rows = terms.select(key).where(F.col(key).isNotNull()).distinct()
    if size > 3 or 2 * pad < size:
        return rows.withColumn("grams", numbered_grams(F.col(key), size, pad))
    return rows.mapInArrow(_gram_arrays(size, pad), f"{key} string, grams array<string>")


class _Index:
    """The entries of the right side by size, where each gram is found among them, and the needs by pair of sizes."""

    def __init__(self, b: pa.Array, grams: pa.Array, needs: dict[int, dict[int, int]]):
        size = pc.list_value_length(grams).to_numpy(zero_copy_only=False)
        order = np.argsort(size, kind="stable")
        self.b, self.size, self.needs = b.take(pa.array(order)), size[order], needs
        coded = pc.list_flatten(grams.take(pa.array(order))).dictionary_encode()
        self.grams = coded.dictionary
        #: gram * entries + entry, sorted: a gram's entries of a range of sizes are a slice.
        self.at = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(b) + np.repeat(np.arange(len(b)), self.size))

    def fitting(self, n: int) -> tuple[int, int, np.ndarray]:
        """The entries [lo, hi) of the sizes that a term of n grams may have as partners, and what each needs."""
        sizes, where = np.unique(self.size, return_inverse=True)
        need = np.maximum(np.array([self.needs[n][m] for m in sizes.tolist()]), 1)
        fit = np.flatnonzero((need <= np.minimum(n, sizes))[where])
        lo, hi = (int(fit[0]), int(fit[-1]) + 1) if len(fit) else (0, 0)
        return lo, hi, need[where][lo:hi]


def _counted(index: _Index, n: int, rows: np.ndarray, owner: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, entry, common) of the pairs of rows, all of n grams, given which row has which known gram (by row).

    The grams of a row that most entries have, half as many as it must share, are left out of the count; of the entries
    that can still reach their need, it is then looked up whether they have those."""
    lo, hi, need = index.fitting(n)
    width = hi - lo
    if not width or not len(gram):
        return
    first = np.searchsorted(index.at, np.arange(len(index.grams)) * len(index.b) + lo)
    last = np.searchsorted(index.at, np.arange(len(index.grams)) * len(index.b) + hi)
    start, many = first[gram], (last - first)[gram]
    local = np.searchsorted(rows, owner)
    order = np.lexsort((many, local))
    local, gram, start, many = local[order], gram[order], start[order], many[order]
    skip = int(need.min()) // 2
    left = np.searchsorted(local, local, "right") - np.arange(len(local))  # 1 for the gram of a row that most entries have
    late = left <= skip
    common_ones = np.full((len(rows), skip), -1)
    common_ones[local[late], left[late] - 1] = gram[late]
    local, gram, start, many = local[~late], gram[~late], start[~late], many[~late]
    weight = np.cumsum(np.bincount(local, many, len(rows)).astype(np.int64) + width)
    begin = 0
    while begin < len(rows):
        done = int(weight[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(weight, done + _COUNTERS, "right")))
        one = slice(*np.searchsorted(local, [begin, end]))
        k, s, row = many[one], start[one], local[one] - begin
        step = np.arange(int(k.sum())) + np.repeat(s - np.cumsum(k) + k, k)
        cell = index.at[step] - np.repeat(gram[one] * len(index.b) + lo - row * width, k)
        common = np.bincount(cell, minlength=(end - begin) * width).reshape(end - begin, width)
        who, entry = np.nonzero(common >= need - skip)
        common = common[who, entry]
        for j in range(skip):
            g = common_ones[begin + who, j]
            key = g * len(index.b) + lo + entry
            common += (g >= 0) & (index.at[np.minimum(np.searchsorted(index.at, key), len(index.at) - 1)] == key)
            on = common >= need[entry] - (skip - 1 - j)
            who, entry, common = who[on], entry[on], common[on]
        yield rows[begin + who], lo + entry, common
        begin = end


def _probe(shared: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            a, grams = (b.column(b.schema.get_field_index(c)) for c in ("a", "grams"))
            size = pc.list_value_length(grams).to_numpy(zero_copy_only=False)
            gram = pc.index_in(pc.list_flatten(grams), value_set=index.grams)
            known = gram.is_valid().to_numpy(zero_copy_only=False)
            owner, gram = np.repeat(np.arange(len(a)), size)[known], gram.drop_null().to_numpy().astype(np.int64)
            of = size[owner]
            for n in np.unique(size[size > 0]).tolist():
                mine = of == n
                for row, entry, common in _counted(index, n, np.flatnonzero(size == n), owner[mine], gram[mine]):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([a.take(pa.array(row)), index.b.take(pa.array(entry)), pa.array(common.astype(np.int32))], ["a", "b", "common"])

    return run


def _probed(left: DataFrame, right: DataFrame, need: Callable[[Column, Column], Column], most: int) -> DataFrame | None:
    """overlap_join() by the index of the right side, or None where that is too large."""
    if (right.agg(F.sum(F.size("grams"))).first()[0] or 0) > most:
        return None
    sizes = lambda df, name: df.select(F.size("grams").alias(name)).where(F.col(name) > 0).distinct()
    pairs = sizes(left, "n").crossJoin(F.broadcast(sizes(right, "m"))).select("n", "m", need(F.col("n"), F.col("m")).cast("int").alias("need"))
    found = pairs.limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    needs: dict[int, dict[int, int]] = {}
    for n, m, k in zip(*(found.column(c).to_pylist() for c in ("n", "m", "need"))):
        needs.setdefault(n, {})[m] = k
    t = right.where(F.size("grams") > 0).select("b", "grams").toArrow().combine_chunks()
    if not t.num_rows:
        return left.sparkSession.createDataFrame([], "a string, b string, common int")
    index = _Index(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("b"), t.column("grams"))), needs)
    return left.select("a", "grams").mapInArrow(_probe(left.sparkSession.sparkContext.broadcast(index)), "a string, b string, common int")


def overlap_join(left: DataFrame, right: DataFrame, need: Callable[[Column, Column], Column], floor: Callable[[Column], Column], most: int | None = None) -> DataFrame:
    """(a, b, common) of the pairs of left (a, grams) and right (b, grams), keys and grams being different, that share at
    least need(|a|, |b|) grams. floor(n): the least that a set of n grams needs with any partner; pairs that need less
    than one are found only if they share a gram. most: grams of the right side up to which it is broadcast (`INDEX`)."""
    left, right = materialised(left, "grams-a"), materialised(right, "grams-b")
    found = _probed(left, right, need, INDEX if most is None else most)
    return _prefixed(left, right, need, floor) if found is None else found


def _prefixed(left: DataFrame, right: DataFrame, need: Callable[[Column, Column], Column], floor: Callable[[Column], Column]) -> DataFrame:
    """overlap_join() of sides of any size by an equi-join of prefixes."""
    seen = left.select(F.explode("grams").alias("gram")).unionByName(right.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    seen = materialised(seen.withColumn("id", F.monotonically_increasing_id()), "grams-seen")  # stored, so a gram keeps its number
    # Candidates outnumber the rows they come from, so tasks are not merged by the size of those.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for rows, key, own in ((left, "a", "x"), (right, "b", "y")):
        rows = _rarest_first(rows, key, seen).withColumn(f"n{own}", F.size("grams"))
        prefix = F.slice("grams", F.lit(1), F.col(f"n{own}") - F.greatest(floor(F.col(f"n{own}")), F.lit(1)).cast("int") + 1)
        sides.append(rows.select(key, F.col("grams").alias(own), f"n{own}", F.posexplode(prefix).alias(f"at_{own}", "gram")).repartition(parts, "gram"))
    least = F.greatest(need(F.col("nx"), F.col("ny")), F.lit(1))
    rest = F.least(F.col("nx") - F.col("at_x"), F.col("ny") - F.col("at_y"))  # what can be shared from here on
    pairs = sides[0].join(sides[1], "gram").where((F.least("nx", "ny") >= least) & (rest >= least))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("x", "y"))).where(F.col("common") >= least)
    return pairs.select("a", "b", "common").distinct()


def _sides(left: DataFrame, right: DataFrame, size: int, pad: int) -> tuple[DataFrame, DataFrame]:
    return _with_grams(left, "a", size, pad), _with_grams(right, "b", size, pad)


def jaccard_join(left: DataFrame, right: DataFrame, least: float, size: int = 3, pad: int = 2) -> DataFrame:
    """(a, b, jaccard) of terms whose grams (repeats told apart) have a Jaccard likeness of at least `least` > 0."""
    share = least / (1 + least)
    exact = 1e-9  # a need that is whole but for rounding is whole
    pairs = overlap_join(*_sides(left, right, size, pad), lambda n, m: F.ceil((n + m) * share - exact), lambda n: F.ceil(n * least - exact))
    a, b = (F.length(c) + 2 * pad - size + 1 for c in ("a", "b"))
    return pairs.withColumn("jaccard", F.col("common") / (a + b - F.col("common"))).where(F.col("jaccard") >= least - exact).drop("common")


def ratio_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio) of terms with 1 - edits / longer length of at least `least`, from 0.5 on.

    An edit changes at most two of a term's bigrams (with a mark at either end), so terms of length n within k edits
    share n + 1 - 2 k of them, which is one or more here."""
    if least < 0.5:
        raise ValueError("bigrams bound the edit ratio from 0.5 on")
    lost = lambda n: 2 * F.floor((n - 1) * (1 - least) + 1e-9)
    floor = lambda n: F.ceil(n - 2 * (n - 1) * (1 - least) - 1e-9)  # noqa: E731  a longer partner may need less than n - lost(n)
    pairs = overlap_join(*_sides(left, right, 2, 1), lambda n, m: F.greatest(n, m) - lost(F.greatest(n, m)), floor)
    longest = F.greatest(F.length("a"), F.length("b"))
    ratio = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("a", "b") / longest)
    return pairs.select("a", "b", ratio.alias("ratio")).where(F.col("ratio") >= least - 1e-9)


def _deletions(text: Column, most: int) -> Column:
    """The text with none to `most` of its characters left out."""
    out = F.array(text)
    for _ in range(most):
        cut = F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
        out = F.array_distinct(F.concat(out, F.flatten(cut)))
    return out


def edit_join(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(a, b, distance) of terms within `most` edits of each other, whatever their first letters.

    Pairs with one term of 2 * most characters or more share a bigram. Shorter ones, which need not, meet at a common
    rest after at most `most` deletions on either side; such terms are a bounded number of strings each."""
    need = lambda n, m: F.greatest(n, m) - 2 * most
    long = overlap_join(*_sides(left, right, 2, 1), need, lambda n: n - 2 * most).select("a", "b")
    rest = lambda df, key: df.where(F.length(key) < 2 * most).select(key).distinct().select(key, F.explode(_deletions(F.col(key), most)).alias("rest"))
    short = rest(left, "a").join(rest(right, "b"), "rest").select("a", "b")
    pairs = long.unionByName(short).distinct()
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance")).where(F.col("distance") <= most)


def containing(terms: DataFrame, entries: DataFrame, size: int = 5) -> DataFrame:
    """(a, b) of the different terms a that hold the entry b (of `size` characters or more) as a substring.

    Each entry is looked for by the one of its grams that fewest terms have."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size)))
    long = lambda df, key: df.select(key).where(F.length(key) >= size).distinct()
    held = long(terms, "a").select("a", F.explode(F.array_distinct(grams(F.col("a")))).alias("gram"))
    asked = long(entries, "b").select("b", F.explode(F.array_distinct(grams(F.col("b")))).alias("gram"))
    return _by_rarest(held, asked).where(F.contains("a", F.col("b"))).select("a", "b")


def holding_all(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b) of the keys of terms (a, words) that have all words of entries (b, words), found by an entry's rarest."""
    held = terms.select("a", F.explode(F.array_distinct("words")).alias("gram"))
    asked = entries.select("b", F.explode(F.array_distinct("words")).alias("gram"))
    pairs = _by_rarest(held, asked)
    rows = pairs.join(terms.select("a", F.col("words").alias("x")), "a").join(entries.select("b", F.col("words").alias("y")), "b")
    return rows.where(F.size(F.array_except("y", "x")) == 0).select("a", "b")


def _by_rarest(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b): terms that hold the entry's rarest gram. Grams that no term has count as rarest: such entries drop out.

    While the entries have few grams (counted first), those of terms that no entry has go where they arise; what is left
    is kept, so the terms are read once."""
    grams = asked.select("gram").distinct()
    if grams.limit(INDEX + 1).count() <= INDEX:
        held = materialised(held.join(F.broadcast(grams), "gram", "left_semi"), "grams")
    seen = held.groupBy("gram").agg(F.count("*").alias("n"))
    first = asked.join(seen, "gram", "left").groupBy("b").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r"))
    first = materialised(first.select("b", F.col("r.gram").alias("gram")), "rarest")
    return held.join(F.broadcast(first) if first.count() <= INDEX else first, "gram").select("a", "b")


def cosine_join(left: DataFrame, right: DataFrame, least: float, size: int = 3, pad: int = 2) -> DataFrame:
    """(a, b, cosine) of terms whose grams (repeats told apart) have a cosine of at least `least` > 0."""
    exact = 1e-9
    pairs = overlap_join(*_sides(left, right, size, pad), lambda n, m: F.ceil(F.sqrt((n * m).cast("double")) * least - exact), lambda n: F.ceil(n * (least * least) - exact))
    a, b = (F.length(c) + 2 * pad - size + 1 for c in ("a", "b"))
    return pairs.withColumn("cosine", F.col("common") / F.sqrt((a * b).cast("double"))).where(F.col("cosine") >= least - exact).drop("common")

"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are kept in classes of equal factors, for lengths 1, 2, 3, ... A class splits when the followers of
its positions have come to lie in different classes, and of the parts of a split class only the smaller ones are
followed up at the next length (smaller half), so that a text of n words costs O(n log n) moves whatever its period.
Each class is a linked list in the order of the text: two neighbours i and i + q of a class for length q are a square
of period q at i, and q is its smallest period, since the factor would else occur in between. Squares at consecutive
places are one run.

Texts are refined side by side, a bounded block of words at a time; Spark deals the documents, and no row needs
another one. A class of fewer than three positions cannot lie in a run of four periods and is left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, read_table, texts_of

#: A run holds at least so many words and so many periods.
LEAST = 6
PERIODS = 4
#: Words that are refined side by side; a longer text stands alone.
BLOCK = 1 << 19
#: So many moved positions are handled one by one, more as arrays.
FEW = 40
_ALIVE = 3
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


@dataclass
class _Classes:
    """Positions in classes: each class is a segment of `members` and a list by `after` and `before` (-1: none). `born`
    is the length at which the link from a position to the one after it came to be."""

    of: np.ndarray
    members: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    after: np.ndarray
    before: np.ndarray
    born: np.ndarray
    used: int


def _first(of: np.ndarray) -> _Classes:
    n = len(of)
    members = np.argsort(of, kind="stable").astype(np.int32)
    found = of[members]
    cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    size = np.diff(np.append(cut, n))
    number = np.empty(n, np.int32)
    number[members] = np.repeat(np.arange(len(cut), dtype=np.int32), size)
    place = np.empty(n, np.int32)
    place[members] = np.arange(n, dtype=np.int32)
    after, before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    linked = np.flatnonzero(found[1:] == found[:-1])
    after[members[linked]] = members[linked + 1]
    before[members[linked + 1]] = members[linked]
    begin, sizes = np.zeros(n, np.int32), np.zeros(n, np.int32)
    begin[: len(cut)], sizes[: len(cut)] = cut, size
    return _Classes(number, members, place, begin, sizes, after, before, np.ones(n, np.int32), len(cut))


def _slots(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each segment, one segment after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


def _by(major: np.ndarray, minor: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The positions `at` sorted by (major, minor, at)."""
    if 3 * bits <= 63:
        key = (major.astype(np.int64) << (2 * bits)) | (minor.astype(np.int64) << bits) | at
        return np.sort(key) & ((1 << bits) - 1)
    return at[np.lexsort((at, minor, major))]


def _many(c: _Classes, at: np.ndarray, length: int, ended: Callable, moved: np.ndarray, bits: int) -> np.ndarray:
    """Take the positions `at` out of their classes, grouped by the classes of their followers; returns the positions
    of the smaller parts."""
    at = _by(c.of[at], c.of[at + 1], at, bits)
    own, next_ = c.of[at], c.of[at + 1]
    new_class = np.concatenate([[True], own[1:] != own[:-1]])
    new_group = new_class | np.concatenate([[True], next_[1:] != next_[:-1]])
    starts = np.flatnonzero(new_class)
    taken = np.diff(np.append(starts, len(at)))
    groups = np.add.reduceat(new_group.astype(np.int64), starts)
    splits = (groups > 1) | (taken < c.size[own[starts]])
    if not splits.all():
        keep = np.repeat(splits, taken)
        at, own, new_class, new_group = at[keep], own[keep], new_class[keep], new_group[keep]
        if not len(at):
            return at
        starts, taken, groups = np.flatnonzero(new_class), taken[splits], groups[splits]
    classes = own[starts]
    whole = c.size[classes]
    rest = whole - taken
    firsts = np.flatnonzero(new_group)
    sizes = np.diff(np.append(firsts, len(at)))
    owner = np.repeat(np.arange(len(starts)), groups)

    # Links that end, and lists without what is taken out.
    moved[at] = True
    nxt, prv = c.after[at], c.before[at]
    together = np.concatenate([~new_group[1:], [False]])
    follows = np.concatenate([at[1:], [-1]])
    stays = together & (nxt == follows)
    gone = (nxt >= 0) & ~stays
    ended(at[gone], nxt[gone], length)
    left = (prv >= 0) & ~moved[prv]
    ended(prv[left], at[left], length)
    inline = _by(own, np.zeros_like(own), at, bits) if len(firsts) > len(starts) else at
    nxt_in, prv_in = c.after[inline], c.before[inline]
    heads = prv_in[(prv_in < 0) | ~moved[prv_in]]
    tails = nxt_in[(nxt_in < 0) | ~moved[nxt_in]]
    c.after[heads[heads >= 0]] = tails[heads >= 0]
    c.before[tails[tails >= 0]] = heads[tails >= 0]
    c.born[heads[(heads >= 0) & (tails >= 0)]] = length
    c.after[at] = np.where(together, follows, -1)
    c.before[at] = np.where(new_group, -1, np.concatenate([[-1], at[:-1]]))
    c.born[at[together & ~stays]] = length

    # Segments: what is taken out goes to the end of its class's segment, group by group.
    ends = c.begin[classes] + whole
    zone = _slots(ends - taken, taken)
    stay = c.members[zone]
    stay = stay[~moved[stay]]
    holes = c.place[inline]
    holes = holes[holes < np.repeat(ends - taken, taken)]
    c.members[holes], c.place[stay] = stay, holes
    c.members[zone], c.place[at] = at, zone
    moved[at] = False

    # Numbers: the rest keeps the class's; without a rest, the largest group does.
    most = np.maximum.reduceat(sizes, np.cumsum(groups) - groups)
    large = sizes == most[owner]
    order = np.cumsum(large)
    before_class = (order - large)[np.cumsum(groups) - groups]
    large &= order == before_class[owner] + 1  # the first of the largest
    inherits = large & (rest == 0)[owner]
    number = np.empty(len(firsts), np.int32)
    number[inherits] = classes[owner[inherits]]
    fresh = np.flatnonzero(~inherits)
    number[fresh] = np.arange(c.used, c.used + len(fresh))
    c.used += len(fresh)
    c.size[classes] = rest
    c.begin[number], c.size[number] = zone[firsts], sizes
    c.of[at] = np.repeat(number, sizes)

    # Classes that get too small keep their links for good.
    pairs = [at[firsts[sizes == 2]], c.members[c.begin[classes[rest == 2]]], c.members[c.begin[classes[rest == 2]] + 1]]
    last = np.concatenate(pairs).astype(np.int64)
    last = last[c.after[last] >= 0]
    ended(last, c.after[last], length)

    # The largest part of each split class is not followed up.
    skip = large & (rest < most)[owner]
    followers = at[np.repeat(~skip, sizes)]
    small_rest = (rest > 0) & (rest < most)
    if small_rest.any():
        followers = np.concatenate([followers, c.members[_slots(c.begin[classes[small_rest]], rest[small_rest])]])
    return followers.astype(np.int64)


def _few(c: _Classes, at: list[int], length: int, ended: Callable) -> list[int]:
    """As _many(), for a handful of positions, one by one."""
    of, members, place, begin, size, after, before, born = (memoryview(x) for x in (c.of, c.members, c.place, c.begin, c.size, c.after, c.before, c.born))
    classes: dict[int, dict[int, list[int]]] = {}
    for x in sorted(at):
        classes.setdefault(of[x], {}).setdefault(of[x + 1], []).append(x)
    followers: list[int] = []
    for own, by_next in classes.items():
        groups = list(by_next.values())
        taken, whole = sum(map(len, groups)), size[own]
        rest = whole - taken
        if len(groups) == 1 and not rest:
            continue
        out = {x for g in groups for x in g}
        for g in groups:
            for x, y in zip(g, [*g[1:], -1]):
                if after[x] >= 0 and after[x] != y:
                    ended(x, after[x])
                if before[x] >= 0 and before[x] not in out:
                    ended(before[x], x)
        for x in out:
            if (head := before[x]) not in out:
                tail = after[x]
                while tail in out:
                    tail = after[tail]
                if head >= 0:
                    after[head] = tail
                    if tail >= 0:
                        born[head] = length
                if tail >= 0:
                    before[tail] = head
        for g in groups:
            before[g[0]] = after[g[-1]] = -1
            for x, y in zip(g, g[1:]):
                if after[x] != y:
                    after[x], born[x] = y, length
                before[y] = x
        zone = begin[own] + rest
        stay = [x for x in members[zone : zone + taken] if x not in out]
        for hole, x in zip([place[x] for x in out if place[x] < zone], stay):
            members[hole], place[x] = x, hole
        size[own] = rest
        largest = max(groups, key=len)
        for g in groups:
            number = own
            if rest or g is not largest:
                number, c.used = c.used, c.used + 1
            begin[number], size[number] = zone, len(g)
            for x in g:
                members[zone], place[x], of[x] = x, zone, number
                zone += 1
            if len(g) == 2 and after[g[0]] >= 0:
                ended(g[0], after[g[0]])
            if g is not largest or rest >= len(g):
                followers += g
        if rest:
            left = members[begin[own] : begin[own] + rest].tolist() if rest == 2 or rest < len(largest) else []
            if rest == 2:
                first = min(left)
                ended(first, after[first])
            if rest < len(largest):
                followers += left
    return followers


def squares(of: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and period of the squares with a primitive root that may lie in a run, of texts side by side.

    of: a number for each position, equal where words of one text are equal; each text ends with a number that occurs
    once. limit: the longest period asked for at each position (of its text). Squares in classes of fewer than three
    positions are left out.
    """
    n, bits = len(of), max(1, int(len(of)).bit_length())
    c = _first(of)
    moved = np.zeros(n, bool)
    places, periods = [], []
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    followers: np.ndarray | list[int] = np.arange(1, n)
    size, of_, limit_, born = memoryview(c.size), memoryview(c.of), memoryview(limit), memoryview(c.born)
    for length in range(2, int(limit.max(initial=0)) + 1):
        # A link from x to y that ends at this length was a square if it held at the length of its distance.
        def ended(x: np.ndarray, y: np.ndarray, length: int = length) -> None:
            apart = y - x
            ok = (apart < length) & (c.born[x] <= apart)
            if ok.any():
                blocks.append((x[ok], apart[ok]))

        def one_ended(x: int, y: int, length: int = length) -> None:
            if born[x] <= y - x < length:
                places.append(x)
                periods.append(y - x)

        if len(followers) <= FEW:
            at = [x - 1 for x in map(int, followers) if x and size[of_[x - 1]] >= _ALIVE and limit_[x - 1] >= length]
            followers = _few(c, at, length, one_ended) if at else []
        else:
            at = np.asarray(followers, np.int64) - 1
            at = at[at >= 0]
            at = at[(c.size[c.of[at]] >= _ALIVE) & (limit[at] >= length)]
            followers = _many(c, at, length, ended, moved, bits) if len(at) else []
        if not len(followers):
            break
    left = np.flatnonzero((c.after >= 0) & (c.size[c.of] >= _ALIVE))
    apart = c.after[left] - left
    ok = (apart <= limit[left]) & (c.born[left] <= apart)
    blocks += [(left[ok], apart[ok]), (np.array(places, np.int64), np.array(periods, np.int64))]
    place, period = (np.concatenate(x).astype(np.int64) for x in zip(*blocks))
    return place, period


def runs_of(of: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of texts side by side, by start and then period."""
    place, period = squares(of, limit)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    period = period[first]
    length = np.diff(np.append(first, len(place))) - 1 + 2 * period
    ok = length >= np.maximum(LEAST, PERIODS * period)
    start, length, period = place[first][ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _block(words: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text, places from 0."""
    at = np.cumsum([0] + [len(w) + 1 for w in words])
    of = np.empty(at[-1], np.int64)
    limit = np.zeros(at[-1], np.int32)
    used = 0
    for w, lo in zip(words, at):
        ids: dict[bytes, int] = defaultdict(count(used).__next__)
        of[lo : lo + len(w)] = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
        used += len(ids) + 1
        of[lo + len(w)] = used - 1
        limit[lo : lo + len(w)] = len(w) // PERIODS if len(w) >= LEAST else 0
    start, length, period = runs_of(of, limit)
    cut = np.searchsorted(start, at)
    for i, lo in enumerate(at[:-1]):
        a, z = cut[i], cut[i + 1]
        yield start[a:z] - lo, length[a:z], period[a:z]


def _row(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    best: tuple = (None, None, None, None)
    dropped = 0
    if len(start):
        k = int(np.lexsort((period, start, -length))[0])
        s, m, p = int(start[k]), int(length[k]), int(period[k])
        best = (s, m, p, 1000 * m // p)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        dropped = int(gone.sum())
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in zip(start.tolist(), length.tolist(), period.tolist()))
    return (len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), words, dropped)


def _blocks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for t in texts:
        w = (t.as_py() or "").encode().split()  # bytes split at \x20 and \x09-\x0D alone
        if held and n + len(w) > BLOCK:
            yield held
            held, n = [], 0
        held.append(w)
        n += len(w) + 1
    if held:
        yield held


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
    for b in batches:
        done = 0
        for words in _blocks(column(b, "text")):
            rows = []
            for w, found in zip(words, _block(words)):
                *head, kept, dropped = _row(w, *found)
                rows.append((*head, hashlib.sha256(b" ".join(kept)).hexdigest(), len(w), dropped))
            columns = [column(b, "doc_id")[done : done + len(rows)], *(pa.array(x, k) for x, k in zip(zip(*rows), kinds[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names)
            done += len(rows)


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = 0
        for words in _blocks(column(b, "text")):
            kept = [b" ".join(_row(w, *found)[-2]).decode() for w, found in zip(words, _block(words))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id")[done : done + len(kept)], pa.array(kept, pa.string())], ["doc_id", "text"])
            done += len(kept)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = 0
        for words in _blocks(column(b, "text")):
            found = list(_block(words))
            who = column(b, "doc_id")[done : done + len(words)].take(pa.array(np.repeat(np.arange(len(words)), [len(s) for s, _, _ in found])))
            yield pa.RecordBatch.from_arrays([who, *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*found))], ["doc_id", "start", "length", "period"])
            done += len(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row per run: doc_id, start (word number), length and period. Rows as in run_digests()."""
    return texts_of(docs).mapInArrow(_listed, "doc_id long, start long, length long, period long")


def without_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the text of each row, of each run its first period alone, words joined by one space."""
    return texts_of(docs).mapInArrow(_collapsed, "doc_id long, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """A row per row of documents: the number of runs, the longest (ties: smallest start, then period), digests of all
    runs and of the text without their repetitions, words and dropped words.

    Null, empty and blank texts have no words and no runs: nulls for the longest run, digests of the empty string.
    Repeated rows and null doc_ids return a row each; a text of any length is one piece; an empty table returns no rows.
    """
    return texts_of(docs).mapInArrow(_digests, SCHEMA)


def _with_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, t in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
            h = 1 if d is None else zlib.crc32(str(d).encode())
            if h % 10 == 0 and t is not None and (w := t.encode().split()):
                n, g = len(w), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                t = b" ".join(w[:a] + (w[a : a + p] * (1 + (n - a) // p))[: n - a]).decode()
            out.append(t)
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def with_tails(docs: DataFrame) -> DataFrame:
    """The texts of the query's rule: of one document in ten (by its doc_id's checksum) the words from a place on are
    a stretch of it over and over. Rows without a doc_id stay as they are."""
    return texts_of(docs).mapInArrow(_with_tails, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all documents; odd rows as in run_digests()."""
    return run_digests(with_tails(read_table(spark, sf_dir, "documents")))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}

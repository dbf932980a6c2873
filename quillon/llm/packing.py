"""Packing of documents into training sequences by swap-based local search.

Documents are tokenized where they lie and cut into pieces of at most the sequence length. Lengths alone, not tokens,
are dealt into packing groups of bounded size (a hash of the row's number), so every group sees the same mix of
lengths. In a group, pieces are laid down in order of arrival (next fit), which leaves many bins underfull; then bins
are emptied, emptiest first, by moves, one-for-one and two-for-one exchanges with fuller underfull bins, each of which
increases the sum of squared fills, until no bin can be emptied or the bins are as few as the total length allows.
Where there are several groups, each gathers its room in few bins; the underfull bins of all groups are dealt anew, whole,
and searched on, in ever fewer groups. Full bins take part in no step, so once one group holds all underfull bins, each
has met all others.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read_table, stored, texts_of

LENGTH = 2048
END_ID = 0
#: The vocabulary of byte_bpe_50k.json as ranks; encoding by ranks gives the ids of the JSON file, several times faster.
RANKS = "byte_bpe_50k.tiktoken"
#: The one added token of the JSON file, which stands for itself wherever its text occurs.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pieces in a packing group.
GROUP = 20_000
#: Pairs of items of bins with at most so many are tried first; those of other bins once the search would end without.
FEW = 5


@cache
def _encoder(path: str) -> Callable[[str], list[int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> list[int]:
        if SPECIAL not in text:
            return encode(text)
        first, *rest = text.split(SPECIAL)
        out = encode(first)
        for part in rest:
            out.append(SPECIAL_ID)
            out += encode(part)
        return out

    return ids


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than `length`."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def _pieces(path: str, length: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for b in batches:
            doc, text = column(b, "doc_id").to_pylist(), column(b, "text")
            for lo in range(0, len(doc), 500):
                rows: list[tuple] = []
                for d, t in zip(doc[lo : lo + 500], text[lo : lo + 500].to_pylist()):
                    ids = np.array([*encode(t or ""), END_ID], "<u4")
                    for k, (s, n) in enumerate(cuts(len(ids), length)):
                        part = ids[s : s + n]
                        rows.append((d, k, s, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

    return run


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece of each row of documents."""
    path = path or public_tokenizers.path(RANKS)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts_of(docs).mapInArrow(_pieces(path, length, with_ids), schema)


def next_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Item numbers by bin, in order of arrival: what does not fit the last bin opens the next."""
    bins: list[list[int]] = []
    room = -1
    for i, size in enumerate(sizes):
        if size > room:
            bins.append([])
            room = length
        bins[-1].append(i)
        room -= size
    return bins


class _Places:
    """What could be taken back from underfull bins, by what could take its place (its size and the bin's room), and
    then by that room; bit masks hold which amounts there are."""

    def __init__(self, length: int):
        self.at: list[dict[int, set[tuple[int, ...]]]] = [{} for _ in range(length + 1)]
        self.rooms = [0] * (length + 1)
        self.mask = 0

    def add(self, k: int, room: int, entry: tuple[int, ...]) -> None:
        self.at[k].setdefault(room, set()).add(entry)
        self.rooms[k] |= 1 << room
        self.mask |= 1 << k

    def remove(self, k: int, room: int, entry: tuple[int, ...]) -> None:
        here = self.at[k][room]
        here.discard(entry)
        if not here:
            del self.at[k][room]
            self.rooms[k] &= ~(1 << room)
            if not self.rooms[k]:
                self.mask &= ~(1 << k)

    def find(self, size: int, exact: bool) -> tuple[int, ...] | None:
        """The bin and its item (or two) of less length that `size` replaces so that the least room, or none, is left."""
        mask, k = self.mask >> size, size
        while mask:
            step = (mask & -mask).bit_length() - 1
            mask >>= step
            k += step
            if exact and k > size:
                return None
            some = self.rooms[k] >> (k - size + 1)  # more room than would be left
            if some:
                return next(iter(self.at[k][k - size + (some & -some).bit_length()]))
            mask >>= 1
            k += 1
        return None


def twice_at_most(items: list[int], sizes: list[int]) -> list[int]:
    """Of items in order of size two of each size, which stand for the others."""
    return [i for k, i in enumerate(items) if k < 2 or sizes[items[k - 2]] != sizes[i]]


class _Underfull:
    """The underfull bins by room, and what they hold."""

    def __init__(self, bins: list[list[int]], fill: list[int], sizes: list[int], length: int):
        self.bins, self.fill, self.sizes, self.length = bins, fill, sizes, length
        self.rooms: list[set[int]] = [set() for _ in range(length + 1)]
        self.room_mask = 0
        self.one, self.two = _Places(length), _Places(length)
        self.rest: _Places | None = None
        for b in range(len(bins)):
            self.add(b)

    def _entries(self, b: int, room: int) -> Iterator[tuple[_Places, int, tuple[int, ...]]]:
        items, sizes = self.bins[b], self.sizes
        for i in items:
            yield self.one, room + sizes[i], (b, i)
        if len(items) <= FEW:
            for i, j in combinations(items, 2):
                yield self.two, room + sizes[i] + sizes[j], (b, i, j)
        elif self.rest is not None:
            yield from self._pairs(b, room)

    def _pairs(self, b: int, room: int) -> Iterator[tuple[_Places, int, tuple[int, ...]]]:
        """One pair for each sum of two items of a bin: pairs of one sum are exchanged for the same."""
        sizes, sums = self.sizes, {}
        for i, j in combinations(twice_at_most(sorted(self.bins[b], key=sizes.__getitem__), sizes), 2):
            sums.setdefault(sizes[i] + sizes[j], (b, i, j))
        for total, entry in sums.items():
            yield self.rest, room + total, entry

    def open_rest(self) -> None:
        """From now on all pairs can be found."""
        if self.rest is None:
            self.rest = _Places(self.length)
            for b, items in enumerate(self.bins):
                room = self.length - self.fill[b]
                if room and len(items) > FEW:
                    for places, k, entry in self._pairs(b, room):
                        places.add(k, room, entry)

    def add(self, b: int) -> None:
        room = self.length - self.fill[b]
        if room and self.bins[b]:
            self.rooms[room].add(b)
            self.room_mask |= 1 << room
            for places, k, entry in self._entries(b, room):
                places.add(k, room, entry)

    def remove(self, b: int) -> None:
        room = self.length - self.fill[b]
        if room and self.bins[b]:
            self.rooms[room].discard(b)
            if not self.rooms[room]:
                self.room_mask &= ~(1 << room)
            for places, k, entry in self._entries(b, room):
                places.remove(k, room, entry)

    def bin_for(self, size: int) -> int | None:
        """The tightest bin that `size` fits."""
        mask = self.room_mask >> size
        return next(iter(self.rooms[size + (mask & -mask).bit_length() - 1])) if mask else None

    def place_for(self, give: list[int], exact: bool, rest: bool = False) -> tuple[int, ...] | None:
        """What `give` is exchanged for: one item for one or two, or two for one; with `rest`, two of a bin of more than
        FEW for one."""
        size = sum(self.sizes[i] for i in give)
        if rest:
            return self.rest.find(size, exact) if len(give) == 1 else None
        found = self.one.find(size, exact)
        return found if found is not None or len(give) > 1 else self.two.find(size, exact)


def local_search(bins: list[list[int]], sizes: list[int], length: int, trace: list[int] | None = None, gather: bool = False) -> list[list[int]]:
    """Empty underfull bins into fuller ones, emptiest first, until no bin can be emptied or the bins are as few as
    the total length allows.

    An item of the bin moves into the tightest bin with room; where none has, it takes the place of a smaller item
    (one for one), two items do or it takes the place of two smaller ones (two for one), exact fits first, and what
    was there comes back. Pairs of bins of more than FEW items are tried once a pass over all bins has emptied none
    without them. Each step increases the sum of squared fills (`trace` gets it after each), so the search ends; no bin
    and no pair is left out. `bins` is changed in place, and emptied ones stay in it. With `gather` steps go on where the
    bins are as few as can be, so that what room there is ends up in few of them.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    fewest = -(-sum(sizes) // length)
    count = sum(map(bool, bins))
    squares = sum(f * f for f in fill)
    open_ = _Underfull(bins, fill, sizes, length)

    def gained(e: int, give: list[int], o: int, *back: int) -> int:
        gain = sum(sizes[i] for i in give) - sum(sizes[i] for i in back)
        return 2 * gain * (fill[o] - fill[e] + gain)

    def step(e: int, give: list[int], o: int, back: list[int]) -> None:
        nonlocal squares
        gain = sum(sizes[i] for i in give) - sum(sizes[i] for i in back)
        squares += gained(e, give, o, *back)
        open_.remove(o)
        bins[e] = [i for i in bins[e] if i not in give] + back
        bins[o] = [i for i in bins[o] if i not in back] + give
        fill[e] -= gain
        fill[o] += gain
        open_.add(o)
        if trace is not None:
            trace.append(squares)

    def better(e: int, rest: bool) -> bool:
        """One step that takes from bin e, if there is one."""
        mine = sorted(bins[e], key=sizes.__getitem__, reverse=True)
        for i in mine:
            o = open_.bin_for(sizes[i])
            if o is not None and fill[o] + sizes[i] > fill[e]:
                step(e, [i], o, [])
                return True
        some = twice_at_most(mine, sizes)
        gifts = [[i] for i in some] + [list(p) for p in combinations(some, 2)]
        for far, exact in [(False, True), (False, False)] + [(True, True), (True, False)] * rest:
            for give in gifts:
                found = open_.place_for(give, exact, far)
                if found is not None and gained(e, give, *found) > 0:
                    step(e, give, found[0], list(found[1:]))
                    return True
        return False

    rest, emptied = False, True
    while (emptied or not rest) and (gather or count > fewest):
        rest, emptied = not emptied, False
        if rest:
            open_.open_rest()
        for e in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < length), key=fill.__getitem__):
            if count <= fewest and not gather:
                break
            open_.remove(e)
            while bins[e] and better(e, rest):
                pass
            if bins[e]:
                open_.add(e)
            else:
                count -= 1
                emptied = True
    return [b for b in bins if b]


def _pack(length: int, again: bool, gather: bool) -> Callable:
    """Search a group at a time: from next fit, or `again` from the bins that its rows are in. Bins keep their numbers."""

    def group(b: pa.Table) -> pa.RecordBatch:
        b = b.combine_chunks()
        sizes = column(b, "length").to_pylist()
        if again:
            ids, first = np.unique(column(b, "sequence_id").to_numpy(), return_index=True)
            bins = [list(range(lo, hi)) for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(sizes)])]
            b = b.drop_columns(["sequence_id", "offset"])
        else:
            bins = next_fit(sizes, length)
            ids = column(b, "pack")[0].as_py() << 32 | np.arange(len(bins))
            b = b.drop_columns(["arrival"])
        local_search(bins, sizes, length, gather=gather)
        sequence, offset, room = (np.empty(len(sizes), np.int64) for _ in range(3))
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = ids[k], at
                at += sizes[i]
            room[items] = length - at
        out = b.drop_columns(["pack"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("room", room)):
            out = out.append_column(name, pa.array(values))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = column(b, "pack").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if held and column(held[-1], "pack")[0].as_py() != keys[lo]:
                    yield group(pa.Table.from_batches(held))
                    held = []
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield group(pa.Table.from_batches(held))

    return run


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to `length` tokens.

    Rows are dealt out by their number, so that equal or missing doc_ids spread as others do, and packed in its order; the
    number is that of a stored table (as pack_documents() passes), so a task that runs again packs alike. The underfull
    bins of all groups then meet in new groups, fewer each time, until one holds them all, or what room they have together
    is less than a sequence, or the groups do not get fewer and none could empty a bin.
    """
    groups = -(-pieces.count() // group) or 1
    names = [f.name for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, room long"
    dealt = pieces.withColumn("arrival", F.monotonically_increasing_id()).withColumn("pack", F.pmod(F.xxhash64("arrival"), F.lit(groups)))
    packed = dealt.select(*names, "arrival", "pack").repartition("pack").sortWithinPartitions("pack", "arrival").mapInArrow(_pack(length, False, groups > 1), schema)
    full, before, turn = [], None, 0
    while groups > 1:
        packed = stored(packed, "packed")
        left = packed.where("room > 0")
        n, room = left.agg(F.count("*"), F.sum(F.when(F.col("offset") == 0, F.col("room")))).first()
        fewer = -(-n // group)
        if (room or 0) < length or (fewer >= groups and room == before):
            break
        full.append(packed.where("room = 0"))
        groups, before, turn = min(fewer, groups), room, turn + 1
        dealt = left.drop("room").withColumn("pack", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)))
        packed = dealt.repartition("pack").sortWithinPartitions("pack", "sequence_id", "offset").mapInArrow(_pack(length, True, groups > 1), schema)
    for part in full:
        packed = packed.unionByName(part)
    return packed.drop("room")


def pack_documents(docs: DataFrame) -> DataFrame:
    """A row per piece of each row of documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed once each; an empty table gives no rows.
    """
    return pack(stored(token_pieces(docs, with_ids=False), "pieces"))


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents; nulls, ties and empty tables as in pack_documents()."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_swap_packing": op8_swap_packing}

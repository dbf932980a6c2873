"""Packing without caps on what may be exchanged: pairs of bins with many items, bins of different groups."""

import collections

import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import packing  # noqa: E402


@pytest.mark.parametrize("sizes, bound", [
    ([17, 10, 18, 24, 8, 12, 12, 24, 19, 14, 24, 29, 8, 27, 10, 21, 28, 15, 21, 14, 24, 17, 21, 14, 10, 20, 10, 11, 10], 5),
    ([28, 28, 12, 13, 11, 12, 10, 25, 24, 27, 10, 14, 25, 14, 23, 5, 15], 3),
])
def test_pairs_of_bins_with_many_items_are_exchanged(sizes, bound):
    start, trace = packing.next_fit(sizes, 100), []
    end = packing.local_search(start, sizes, 100, trace)
    assert sorted(i for b in end for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in end)
    assert trace == sorted(set(trace)) and len(end) == bound == -(-sum(sizes) // 100)


def test_room_is_gathered_in_few_bins():
    sizes = [1 + i * 37 % 61 for i in range(600)]
    fills = [sorted(sum(sizes[i] for i in b) for b in packing.local_search(packing.next_fit(sizes, 2048), sizes, 2048, gather=g)) for g in (False, True)]
    assert len(fills[0]) == len(fills[1]) == -(-sum(sizes) // 2048) and fills[1][1] == 2048 > fills[0][1]


@pytest.mark.parametrize("group", [7, 50, 10_000])
def test_bins_of_different_groups_meet(spark, group):
    rows = [(None if i % 9 == 0 else i // 2, i, 1024) for i in range(200)]
    table = packing.stored(spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(3), "pieces")
    got, again = (packing.pack(table, group=group).collect() for _ in range(2))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert collections.Counter(r.piece for r in got) == collections.Counter(range(200))
    assert {tuple(sorted(v)) for v in _places(got).values()} == {((0, 1024), (1024, 1024))} and len(_places(got)) == 100


def test_groups_of_odd_sizes_lose_nothing(spark):
    rows = [(i, 0, 1 + i * 37 % 700) for i in range(1500)] + [(i, 1, 2048) for i in range(300)]
    table = packing.stored(spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(3), "pieces")
    got = packing.pack(table, group=40).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(rows)
    for items in _places(got).values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(_places(got)) <= -(-sum(n for *_, n in rows) // 2048) + 2  # groups alone need some 25 more
    assert packing.pack(table.limit(0)).count() == 0


def _places(rows):
    found = collections.defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    return found

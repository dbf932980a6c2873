"""Exact substring dedup with a sampled suffix array, sorted deep-shallow.

Bytes covered by a 100-byte string that also starts earlier go. Only suffixes at anchors are sorted: an anchor is a
position whose 32-byte hash is the least of some window of 69 starts, so every 100-byte string holds an anchor and
equal strings hold it at the same place. Two equal strings therefore show up as two anchors whose contexts agree for
o bytes to the left and 100 - o to the right, and nothing else has to be compared.

1. Scan: anchors with the hash of their 32 bytes and of their whole context (68 bytes left, 100 right), packed into
   one binary row per bucket of hashes. An anchor whose whole context stood earlier in the same batch of documents is
   settled at once, so thousands of copies of a passage leave one row a batch.
2. By bucket: hashes found once are dropped, repeated whole contexts settled; what is left needs its bytes.
3. Join with the texts: the contexts of those anchors, packed by bucket. Anchor strings with very many different
   contexts (a frequent line between ever new neighbours) are cut at all depths instead, a narrow row for each 100-byte
   string; of equal strings of a batch only the first goes on.
4. By bucket, deep-shallow sorting of the contexts in both directions: multikey quicksort on 8-byte symbols to a
   shallow depth, blind tries for the groups that agree beyond it; the common-prefix lengths of neighbours give the
   classes of equal strings for each o, of which all but the first occurrence are removed.
5. Join with the texts: the union of the removed runs, and the hash of the bytes kept.

All joins with the texts share one exchange by document. No prefix of a text stands for the whole, no group is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BYTE_HASH, chunks, column, mixed, partitions, read_table, texts_of

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM
#: Buckets for each shuffle partition; a task holds one bucket at a time.
BUCKETS = 4
#: An anchor string with more different contexts than this is cut at all depths.
MANY = 4096
#: Bytes beyond the anchor string that multikey quicksort sorts by; deeper groups go to blind tries.
SHALLOW = 16

_A = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("pos", "<i4")])
_ASK = np.dtype([("pos", "<i4"), ("kind", "<i4")])
_RUN = np.dtype([("lo", "<i4"), ("hi", "<i4")])
_CTX = np.dtype([("h", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", f"S{LEFT + LENGTH}")])
_CUT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("lo", "<i4")])
#: What an anchor is asked for: its bytes, a row for each string through it, or nothing as its whole context repeats.
NEED, CUT, SETTLED = 0, 1, 2


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width], for each i with a whole window."""
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each 32 bytes, by doubling."""
    h, size = BYTE_HASH[raw], 1
    for factor in mixed(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1):
        h = h[:-size] * factor + h[size:]
        size *= 2
    return mixed(h)


def _joined(h: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(starts[0]), np.uint64)
    for i, s in enumerate(starts):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[s] + np.uint64(i + 1))
    return out


def _string_hashes(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of the 100 bytes from each start, from those of its four covering 32-byte strings."""
    return _joined(h, [start, start + 32, start + 64, start + LENGTH - GRAM])


def anchors_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of some texts: text number, position in it, anchor hash, and the hash of its context,
    which a text's ends may cut short."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    h = _gram_hashes(raw)
    h |= np.uint64(1)
    least = _slide(h, LEFT + 1, np.minimum)
    inside = np.zeros(len(raw) + 1, np.int32)
    ends = np.maximum(at[1:] - LENGTH + 1, at[:-1])
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, ends, -1)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint64(0))
    padded = np.zeros(len(h) + LEFT, np.uint64)
    padded[LEFT : LEFT + len(least)] = least
    pos = np.flatnonzero(_slide(padded, LEFT + 1, np.maximum) == h)
    text = np.searchsorted(at, pos, "right") - 1
    whole = (pos - LEFT >= at[text]) & (pos + LENGTH <= at[text + 1])
    ctx = np.zeros(len(pos), np.uint64)
    p = pos[whole]
    ctx[whole] = _joined(h, [p - LEFT, p - LEFT + 32, p - 32, p, p + 32, p + 64, p + LENGTH - GRAM])
    for i in np.flatnonzero(~whole).tolist():
        a, z = max(pos[i] - LEFT, at[text[i]]), min(pos[i] + LENGTH, at[text[i] + 1])
        ctx[i] = xxhash.xxh64_intdigest(raw[a:z], int(pos[i] - a + 1))
    return text, pos - at[text], h[pos], ctx


def _packed(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(bucket)]):
        yield int(bucket[lo]), rows[lo:hi].tobytes()


def _emit(known: list[tuple[int, int, bytes]], buckets: int, **pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Packed rows by bucket, a column for each kind of them, and what is known already, by document."""
    n = sum(map(len, pairs.values()))
    cols = {
        "bucket": pa.array([p[0] for kind in pairs.values() for p in kind] + [k[0] % buckets for k in known], pa.int32()),
        "doc_id": pa.array([None] * n + [k[0] for k in known], pa.int64()),
        "copy": pa.array([None] * n + [k[1] for k in known], pa.int32()),
        "known": pa.array([None] * n + [k[2] for k in known], pa.binary()),
    }
    for name in pairs:
        cols[name] = pa.array([p[1] if kind == name else None for kind, part in pairs.items() for p in part] + [None] * len(known), pa.binary())
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _first_of(rows: np.ndarray, keys: list[str]) -> np.ndarray:
    """The number of the first row (by document and position) of each row's class by keys; rows come in that order."""
    order = np.lexsort([rows[k] for k in reversed(keys)])
    s = rows[order]
    new = np.ones(len(s), bool)
    for i, k in enumerate(keys):
        new[1:] = (s[k][1:] != s[k][:-1]) | (new[1:] if i else False)
    first = np.empty(len(s), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first


def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["pos"], rows["copy"], rows["doc"]))]


def _asks(rows: np.ndarray, kind: np.ndarray | int) -> Iterator[tuple[int, int, bytes]]:
    """(doc, copy, packed positions and kinds) of anchors in order of documents."""
    ask = np.empty(len(rows), _ASK)
    ask["pos"], ask["kind"] = rows["pos"], kind
    edges = np.flatnonzero(np.diff(rows["doc"], prepend=rows["doc"][:1] - 1).astype(bool) | np.diff(rows["copy"], prepend=-1).astype(bool))
    for lo, hi in zip(edges, [*edges[1:], len(rows)]):
        yield int(rows["doc"][lo]), int(rows["copy"][lo]), ask[lo:hi].tobytes()


def _scan(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, copy = (column(b, n).to_numpy() for n in ("doc_id", "copy"))
            got = []
            for lo, _, raw, at in chunks(column(b, "text")):
                text, pos, h, ctx = anchors_of(raw, at)
                rows = np.empty(len(pos), _KEY)
                rows["h"], rows["ctx"], rows["doc"], rows["copy"], rows["pos"] = h, ctx, doc[lo + text], copy[lo + text], pos
                got.append(rows)
            rows = _sorted_rows(np.concatenate(got)) if got else np.empty(0, _KEY)
            if not len(rows):
                continue
            first = _first_of(rows, ["h", "ctx"])
            settled = first != np.arange(len(rows))
            known = [(d, c, a) for d, c, a in _asks(rows[settled], SETTLED)] if settled.any() else []
            rows = rows[~settled]
            yield _emit(known, buckets, rows=list(_packed((rows["h"] >> np.uint64(20)) % np.uint64(buckets), rows)))

    return run


def _by_bucket(f: Callable[..., Iterator[pa.RecordBatch]], name: str, **kinds: np.dtype) -> Callable:
    """Rows come sorted by bucket: f gets the unpacked rows of one bucket at a time, by kind. What is known already
    (with a document) passes as `name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {k: [] for k in kinds}

        def out() -> Iterator[pa.RecordBatch]:
            if any(held.values()):
                yield from f(**{k: np.concatenate([np.empty(0, t), *held[k]]) for k, t in kinds.items()})
            for part in held.values():
                part.clear()

        for b in batches:
            known = b.filter(column(b, "doc_id").is_valid())
            if len(known):
                yield pa.RecordBatch.from_arrays([column(known, n) for n in ("doc_id", "copy", "known")], ["doc_id", "copy", name])
            b = b.filter(column(b, "doc_id").is_null())
            cols = [column(b, k) for k in kinds]
            for i, bucket in enumerate(column(b, "bucket").to_pylist()):
                if bucket != now:
                    yield from out()
                now = bucket
                for (k, t), col in zip(kinds.items(), cols):
                    if col[i].is_valid:
                        held[k].append(np.frombuffer(col[i].as_buffer(), t).copy())
        yield from out()

    return run


def _decide(many: int) -> Callable:
    def f(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(rows["h"], kind="stable")
        h = rows["h"][order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        rows = _sorted_rows(rows[order[twice]])
        if not len(rows):
            return
        settled = _first_of(rows, ["h", "ctx"]) != np.arange(len(rows))
        group = _first_of(rows, ["h"])
        contexts = np.bincount(group[~settled], minlength=len(rows))[group]
        kind = np.where(settled, SETTLED, np.where(contexts > many, CUT, NEED))
        use = settled | (contexts > 1)
        rows, kind = rows[use], kind[use]
        if len(rows):
            out = list(_asks(rows, kind))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "copy", "asks"])

    return _by_bucket(f, "asks", rows=_KEY)


def _own(parts: list[dict] | None, copy: int, name: str, dtype: np.dtype) -> np.ndarray:
    """The unpacked entries of one copy of a document."""
    return np.frombuffer(b"".join(p[name] for p in parts or () if p["copy"] == copy), dtype)


def _contexts(buckets: int) -> Callable:
    """Of texts with their asks: the contexts of the anchors that need comparing, and the strings of those that are
    cut, packed by bucket. Of equal strings of a batch only the first goes on; the others are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, copy, asked = column(b, "doc_id").to_numpy(), column(b, "copy").to_numpy(), column(b, "asks").to_pylist()
            near, far = [np.empty(0, _CTX)], [np.empty(0, _CUT)]
            for lo, hi, raw, at in chunks(column(b, "text")):
                if len(raw) < LENGTH:
                    continue
                asks = [_own(a, c, "asks", _ASK) for a, c in zip(asked[lo:hi], copy[lo:hi])]
                text = np.repeat(np.arange(hi - lo), [len(a) for a in asks])
                asks = np.concatenate(asks)
                keep = asks["kind"] != SETTLED
                text, asks = text[keep], asks[keep]
                if not len(asks):
                    continue
                h = _gram_hashes(raw)
                pos = at[text] + asks["pos"]
                left = np.minimum(asks["pos"], LEFT)
                right = np.minimum(at[text + 1] - pos, LENGTH)
                i = np.flatnonzero(asks["kind"] == NEED)
                out = np.zeros(len(i), _CTX)
                padded = np.zeros(len(raw) + LEFT + LENGTH, np.uint8)
                padded[LEFT : LEFT + len(raw)] = raw
                whole = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[pos[i]].copy()
                slot = np.arange(LEFT + LENGTH)
                whole[(slot < LEFT - left[i, None]) | (slot >= LEFT + right[i, None])] = 0
                out["h"], out["doc"], out["copy"], out["pos"] = h[pos[i]] | np.uint64(1), doc[lo + text[i]], copy[lo + text[i]], asks["pos"][i]
                out["left"], out["right"], out["bytes"] = left[i], right[i], whole.view(f"S{LEFT + LENGTH}").ravel()
                near.append(out)
                i = np.flatnonzero(asks["kind"] == CUT)
                for some in np.array_split(i, max(1, len(i) // 4096)):  # a bounded number of strings at a time
                    j, o = (x.ravel() for x in np.meshgrid(some, np.arange(LEFT + 1), indexing="ij"))
                    fits = (o <= left[j]) & (LENGTH - o <= right[j])
                    j, o = j[fits], o[fits]
                    start = np.unique(pos[j] - o)  # neighbouring anchors share strings
                    out = np.zeros(len(start), _CUT)
                    of = np.searchsorted(at, start, "right") - 1
                    out["h"], out["doc"], out["copy"], out["lo"] = _string_hashes(h, start), doc[lo + of], copy[lo + of], start - at[of]
                    far.append(out)
            near, far = np.concatenate(near), np.concatenate(far)
            far = np.unique(far[np.lexsort((far["lo"], far["copy"], far["doc"]))]) if len(far) else far
            far = far[np.lexsort((far["lo"], far["copy"], far["doc"]))]
            again = _first_of(far, ["h"]) != np.arange(len(far)) if len(far) else np.empty(0, bool)
            known = _known_runs(far[again])
            far = far[~again]
            by = lambda rows: list(_packed((rows["h"] >> np.uint64(20)) % np.uint64(buckets), rows))
            if len(near) or len(far):
                yield _emit(known, buckets, rows=by(near), far=by(far))

    return run


# --- deep-shallow sorting ----------------------------------------------------------------------------------------


def _multikey(group: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by group and then by their 8-byte symbols, each level sorting only what is still tied.

    Returns the order and, in that order, the number of the tie group that every row is left in.
    """
    order = np.argsort(group, kind="stable")
    tie = group[order]
    tie = np.cumsum(np.concatenate([[False], tie[1:] != tie[:-1]])) if len(tie) else tie.astype(np.int64)
    for level in symbols.T:
        size = np.bincount(tie, minlength=1)
        open_ = np.flatnonzero(size[tie] > 1)
        if not len(open_):
            break
        sub = np.lexsort((level[order[open_]], tie[open_]))
        order[open_] = order[open_][sub]
        value, changed = level[order], np.zeros(len(order), bool)
        changed[1:] = (tie[1:] != tie[:-1]) | (value[1:] != value[:-1])
        tie = np.cumsum(changed)
    return order, tie


def _blind_trie(strings: list[bytes]) -> list[int]:
    """Sort strings of one length through a blind trie; equal strings stay in their order.

    Inner nodes hold only the depth at which their strings part and a child for each byte found there; the bytes
    between are looked up in one string of the subtree.
    """
    root: list = [None, [0]]  # a leaf: [None, members]; an inner node: [depth, children by byte, any member]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while node[0] is not None:
            nxt = node[1].get(s[node[0]])
            if nxt is None:
                break
            node = nxt
        t = strings[node[1][0] if node[0] is None else node[2]]
        if s == t:
            node[1].append(i)
            continue
        lo, hi = 0, len(s)
        while hi - lo > 1:  # the common prefix, by halving
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if s[:mid] == t[:mid] else (lo, mid)
        depth = lo
        up, node = None, root
        while node[0] is not None and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        leaf = [None, [i]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            continue
        inner = [depth, {t[depth]: node, s[depth]: leaf}, i]
        if up is None:
            root = inner
        else:
            up[1][s[up[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray, skip: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order rows (a byte matrix) by group and content; the common prefix of each with the one before (-1: new group).

    The first `skip` bytes are known to agree in a group.
    """
    width = rows.shape[1]
    depth = min(width, skip + shallow)
    part = rows[:, skip:depth]
    part = np.pad(part, ((0, 0), (0, -part.shape[1] % 8)))
    order, tie = _multikey(group, np.ascontiguousarray(part).view(">u8").astype(np.uint64))
    size = np.bincount(tie, minlength=1)
    begin = np.cumsum(size) - size
    for lo, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
        deep = rows[order[lo : lo + n], depth:]
        order[lo : lo + n] = order[lo : lo + n][_blind_trie([r.tobytes() for r in deep])]
    s, g = rows[order], group[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.full(len(order), -1, np.int64)
    lcp[1:] = np.where(g[1:] == g[:-1], common, -1)
    return order, lcp


def repeated_runs(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors with contexts: those with a string that starts earlier, and the least and largest such o.

    Rows come in order of documents and positions.
    """
    n = len(ctx)
    least, most = np.full(n, LENGTH), np.full(n, -1)
    if not n:
        return np.empty(0, np.int64), least, most
    group = np.unique(ctx["h"], return_inverse=True)[1]
    both = np.ascontiguousarray(ctx["bytes"]).view(np.uint8).reshape(n, LEFT + LENGTH)
    right_order, right_lcp = deep_shallow(group, both[:, LEFT:], GRAM)
    left_order, left_lcp = deep_shallow(group, np.ascontiguousarray(both[:, LEFT - 1 :: -1] if LEFT else both[:, :0]), 0)
    left, right = ctx["left"].astype(np.int64), ctx["right"].astype(np.int64)
    rank = np.empty(n, np.int64)
    side = np.empty(n, np.int64)
    for o in range(LEFT + 1):
        ok = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(ok) < 2:
            continue
        rank[right_order] = np.cumsum(right_lcp < LENGTH - o)
        side[left_order] = np.cumsum(left_lcp < o)
        key = rank[ok] * (n + 1) + side[ok]
        order = np.argsort(key, kind="stable")
        again = ok[order[1:][key[order[1:]] == key[order[:-1]]]]
        least[again] = np.minimum(least[again], o)
        most[again] = np.maximum(most[again], o)
    return np.flatnonzero(most >= 0), least, most


def _packed_runs(doc, copy, lo, hi) -> list[tuple[int, int, bytes]]:
    """(doc, copy, packed runs) of removed runs."""
    order = np.lexsort((lo, copy, doc))
    doc, copy = doc[order], copy[order]
    run = np.empty(len(order), _RUN)
    run["lo"], run["hi"] = lo[order], hi[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])
    edges = np.flatnonzero(new)
    return [(int(doc[a]), int(copy[a]), merged(run[a:z]).tobytes()) for a, z in zip(edges, [*edges[1:], len(order)])]


def _known_runs(far: np.ndarray) -> list[tuple[int, int, bytes]]:
    return _packed_runs(far["doc"], far["copy"], far["lo"], far["lo"] + LENGTH) if len(far) else []


def _compare() -> Callable:
    def f(rows: np.ndarray, far: np.ndarray) -> Iterator[pa.RecordBatch]:
        far = far[np.lexsort((far["lo"], far["copy"], far["doc"]))]
        known = _known_runs(far[_first_of(far, ["h"]) != np.arange(len(far))]) if len(far) else []
        rows = _sorted_rows(rows)
        hit, least, most = repeated_runs(rows)
        found = rows[hit]
        if len(found):
            known += _packed_runs(found["doc"], found["copy"], found["pos"] - most[hit], found["pos"] - least[hit] + LENGTH)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in known], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "copy", "runs"])

    return _by_bucket(f, "runs", rows=_CTX, far=_CUT)


def _settled_runs(asks: np.ndarray, size: int) -> np.ndarray:
    pos = asks["pos"][asks["kind"] == SETTLED]
    run = np.empty(len(pos), _RUN)
    run["lo"], run["hi"] = np.maximum(pos - LEFT, 0), np.minimum(pos + LENGTH, size)
    return run


def merged(run: np.ndarray) -> np.ndarray:
    """The maximal runs of a union of runs (touching ones join)."""
    if not len(run):
        return run
    run = run[np.argsort(run["lo"], kind="stable")]
    top = np.maximum.accumulate(run["hi"])
    new = np.ones(len(run), bool)
    new[1:] = run["lo"][1:] > top[:-1]
    at = np.flatnonzero(new)
    out = run[at].copy()
    out["hi"] = top[np.append(at[1:] - 1, len(run) - 1)]
    return out


_RESULT = "doc_id long, copy int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>"


def _finish(with_text: bool) -> Callable:
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["text"] * with_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            asks, runs, copy = (column(b, n).to_pylist() for n in ("asks", "runs", "copy"))
            for lo, hi, raw, at in chunks(column(b, "text")):
                for i in range(lo, hi):
                    text = raw[at[i - lo] : at[i - lo + 1]]
                    run = [_settled_runs(_own(asks[i], copy[i], "asks", _ASK), len(text)), _own(runs[i], copy[i], "runs", _RUN)]
                    run = merged(np.concatenate(run)).tolist()
                    ends = [0, *(z for _, z in run)], [*(a for a, _ in run), len(text)]
                    kept = b"".join(text[a:z].tobytes() for a, z in zip(*ends))
                    spans = [{"lo": a, "hi": z} for a, z in run]
                    rows.append((len(text), len(text) - len(kept), len(run), hashlib.sha256(kept).hexdigest(), spans, kept.decode(errors="ignore") if with_text else None))
            out = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names))]
            first = ["doc_id", "copy"] + ["rest"] * with_text
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in first), *out], [*first, *names])

    return run


def _spans(docs: DataFrame, many: int, rest: list[str] | None) -> DataFrame:
    n = partitions(docs.sparkSession)
    buckets = BUCKETS * n
    texts = docs.select(
        # rows without a doc_id come before all others, in order of storage; a number each spreads them
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)) + F.monotonically_increasing_id()).alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *([F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest is not None else []),
    )
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    scanned = texts.mapInArrow(_scan(buckets), "bucket int, doc_id long, copy int, known binary, rows binary")
    asks = scanned.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_decide(many), "doc_id long, copy int, asks binary")
    asks = asks.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "asks")).alias("asks"))
    contexts = texts.join(asks, "doc_id").mapInArrow(_contexts(buckets), "bucket int, doc_id long, copy int, known binary, rows binary, far binary")
    runs = contexts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(), "doc_id long, copy int, runs binary")
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "runs")).alias("runs"))
    schema = _RESULT
    if rest is not None:
        schema = _RESULT.replace("copy int,", f"copy int, rest {texts.schema['rest'].dataType.simpleString()},") + ", text string"
    found = texts.join(asks, "doc_id", "left").join(runs, "doc_id", "left").mapInArrow(_finish(rest is not None), schema)
    return found.withColumn("doc_id", F.when(F.col("doc_id") >= -(2**62), F.col("doc_id")))


def duplicate_spans(docs: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id, copy, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges removed) of each row of documents.

    Null texts are empty. Rows that repeat a doc_id are told apart by `copy`, in the order of their texts' hashes, the
    first being 1; rows without a doc_id come before all others, in the order in which they are stored. An empty table
    returns no rows. doc_ids below -2^62 are taken for missing.
    """
    return _spans(docs, many, None)


def deduplicated(docs: DataFrame, many: int = MANY) -> DataFrame:
    """The rows of documents, with the bytes that `duplicate_spans` removes cut out of their texts (a character cut in
    two goes whole) and n_chars, where there is one, renewed; null texts come back empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = _spans(docs, many, rest)
    cols = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(cols[c].alias(c) if c in cols else F.col("rest").getField(c).alias(c) for c in docs.columns))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}

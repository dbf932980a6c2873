"""Byte-level BPE by longest matches and backtracking, and decoding.

A piece's bytes are read as Latin-1, so that an Aho-Corasick automaton over all tokens gives the longest token from
each byte in one pass. The encoder takes the longest match; where it cannot follow the token before it, it tries the
next shorter prefix, and where none can, it goes one token back and marks the place as dead. Whether two tokens can
stand side by side (the merges of their joint bytes give exactly the two) depends on the pair alone and is memoised.
Each place is left at most once, so the work is linear in the piece, and the result is that of the merges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import column, read_table, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pieces and ids, and pairs of tokens, that a worker keeps at most; a store is emptied when full.
STORE_BYTES = 64 << 20
PAIRS = 1_000_000
#: Longer pieces are not kept.
KEPT_PIECE = 256


class Bpe:
    """A vocabulary of ranks with its automaton and merge tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.find = _matcher(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            half = self._merge(token, rank) if len(token) > 1 else None
            if half:
                self.halves[rank] = half
                self.pairs[half] = rank
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.stored: dict[str, bytes] = {}
        self.stored_bytes = 0

    def _merge(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that merge last into this one, by plain merges of lower rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks = self.ranks
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
            if ranks.get(parts[best] + parts[best + 1], below) >= below:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _prefix(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if rank not in self.shorter:
            token = self.bytes_of[rank]
            self.shorter[rank] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[rank]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before one that keeps the tokens apart.

        The tokens are taken apart from the border, last merge first; a merge of the pieces that meet there breaks
        the pair if its rank is below that of the merge last undone.
        """
        found = self.fits.get((a, b))
        if found is not None:
            return found
        x, y, limit, ok = a, b, 1 << 60, True
        while True:
            joined = self.pairs.get((x, y))
            if joined is not None and joined < limit:
                ok = False
                break
            # Undo the later of the two merges; on the left the merge of equal rank comes first.
            nx, ny = self.halves.get(x), self.halves.get(y)
            if nx is None and ny is None:
                break
            if ny is None or nx is not None and x > y:
                limit, x = x, nx[1]
            else:
                limit, y = y + 1, ny[0]
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of text."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[tuple[int, int]] = [(0, 0)] * n
        for end, entry in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - entry[1]] = entry  # ends ascend, so the longest comes last
        ids: list[int] = []
        begins: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, (token, size) = 0, longest[0]
        side, size_of = self.side_by_side, self.bytes_of
        while True:
            end = at + size
            if alive[end] and (not ids or side(ids[-1], token)):
                ids.append(token)
                begins.append(at)
                if end == n:
                    return ids
                at = end
                token, size = longest[at]
                continue
            less = self._prefix(token)
            while less is None:
                # No token from here: this place is dead, and the token before it gives way.
                alive[at] = 0
                token, at = ids.pop(), begins.pop()
                less = self._prefix(token)
            token, size = less, len(size_of[less])

    def _ids(self, piece: str) -> bytes:
        found = self.stored.get(piece)
        if found is None:
            found = np.array(self.piece(piece.encode()), "<u4").tobytes()
            if len(piece) <= KEPT_PIECE:
                size = 150 + 4 * len(piece) + len(found)  # with what the objects themselves take
                if self.stored_bytes + size > STORE_BYTES:
                    self.stored.clear()
                    self.stored_bytes = 0
                self.stored[piece] = found
                self.stored_bytes += size
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, piece by piece, as unsigned 32-bit integers."""
        stored = self.stored
        pieces = self.find(text)
        try:
            packed = b"".join(map(stored.__getitem__, pieces))
        except KeyError:
            packed = b"".join(map(self._ids, pieces))
        return np.frombuffer(packed, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _matcher(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern; texts of ASCII go through the faster of two equivalent expressions."""
    find = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return find
    plain = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
    return lambda text: plain(text) if text.isascii() else find(text)


@cache
def load(path: str, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _run(path: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        for b in batches:
            doc, text = column(b, "doc_id"), column(b, "text")
            for lo in range(0, len(b), 500):
                rows = []
                for t in text[lo : lo + 500].to_pylist():
                    ids = bpe.encode(t or "")
                    back = bpe.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), ids.astype(np.int32) if with_ids else None, back))
                yield pa.RecordBatch.from_arrays([doc[lo : lo + 500], *(pa.array([r[i] for r in rows], types[i + 1]) for i in range(len(names) - 1))], names)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of ids and of the decoded bytes, and if asked for ids and decoded, row by row.

    Null and empty texts have no tokens; repeated rows are encoded alike; an empty table returns no rows.
    """
    path = path or public_tokenizers.path(RANKS)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return texts_of(docs).mapInArrow(_run(path, with_ids), schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents; nulls, ties and empty tables as in encode_documents()."""
    return encode_documents(read_table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op9_byte_bpe": op9_byte_bpe}

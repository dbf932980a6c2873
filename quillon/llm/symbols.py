"""Bytes as 64 symbols, and codes of runs of symbols."""

from __future__ import annotations

import numpy as np

SYMBOLS = 64
BITS = 6


def _table() -> np.ndarray:
    """0 is the text's edge; letters, with capitals of their own; other bytes by kind."""
    t = np.empty(256, np.int64)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            t[b] = 1 + b - 97
        elif "A" <= c <= "Z":
            t[b] = 27 + (b - 65) // 2
        elif c.isascii() and c.isdigit():
            t[b] = 40
        elif b < 128:
            t[b] = 41 + (" \n.,!|#*$%&?'-:/".find(c) + 1)
        else:
            t[b] = 58 + (0 if b >= 0xC4 else 1 if b >= 0xC0 else 2 + (b & 3))
    return t


SYMBOL_OF = _table()


def codes(raw: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The code of each byte's symbol with the order-1 symbols before it in its text (edges before the first)."""
    s = SYMBOL_OF[raw]
    out = s.copy()
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, order):
        part = np.where(place[k:] >= k, s[: len(s) - k], 0) if len(s) > k else s[:0]
        out[k:] += part << (BITS * k)
    return out

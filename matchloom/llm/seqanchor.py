"""Content-defined anchors over symbol sequences (bytes or words), vectorised with NumPy.

A *window* is W consecutive symbols of one document.  Every window picks one anchor: the leftmost of its k-grams
with the smallest hash.  The choice depends on the window's content alone, so equal windows pick equal anchors at
equal offsets.  Windows that follow one another and pick the same anchor form a *block*: the symbols
``[a, b + W)`` of a document, whose windows start at a..b.  Hence

* an anchor gram that occurs once in the corpus proves every window of its block unique;
* two blocks with the same symbols and the same anchor prove all their windows repeated;
* only blocks that share an anchor but differ elsewhere (the edges of repeated passages) need a closer look.

A document of n symbols has about 2n / (W - k + 2) blocks, which is what travels through a shuffle, not n windows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit integers."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, U64)
            out[0] = 1
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * U64(pow(base, have, 1 << 64))
                have *= 2
            _POW[i] = out
    return _POW[0][:n], _POW[1][:n]


class Rolling:
    """Hashes of any range of a symbol array in constant time each (polynomial, modulo 2**64, over mixed symbols)."""

    def __init__(self, sym: np.ndarray) -> None:
        n = len(sym)
        pw, self.ipw = _powers(n + 1)
        self.pre = np.empty(n + 1, U64)
        self.pre[0] = 0
        np.cumsum(sym * pw[:n], out=self.pre[1:])

    def grams(self, k: int) -> np.ndarray:
        h = self.pre[k:] - self.pre[:-k]
        h *= self.ipw[: len(h)]
        return mix(h)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.pre[end] - self.pre[start]) * self.ipw[start]
        return mix(h + U64(0xA0761D6478BD642F) * (end - start).astype(U64))


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _byte_table()[buf]


def word_symbols(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 20, 09-0D hex): 64-bit hashes, starts, ends."""
    word = ~((buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D)))
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U64), start, end
    return Rolling(byte_symbols(buf)).ranges(start, end), start, end


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries (prefix and suffix minima of blocks of w)."""
    n = len(key)
    full = -(-n // w) * w
    x = np.full(full, _MASK, U64)
    x[:n] = key
    x = x.reshape(-1, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def blocks(sym: np.ndarray, lengths: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Blocks of the documents laid end to end in ``sym``.

    Returns arrays: doc (index into lengths), a (first window start, within the document), n (windows in the
    block), p (anchor start minus a), anchor (hash of its gram), body (hash of the block with p).
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    have = lengths >= window
    if not have.any():
        none = np.empty(0, np.int64)
        return {"doc": none, "a": none, "n": none, "p": none, "anchor": none, "body": none}
    roll = Rolling(sym)
    h = roll.grams(k)
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    at = (_sliding_min(key, window - k + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(sym) + 1, np.int8)
    np.add.at(valid, starts[have], 1)
    np.add.at(valid, (starts + lengths - window + 1)[have], -1)
    ok = np.cumsum(valid[: len(at)], dtype=np.int8).astype(bool)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = at[1:] != at[:-1]
    new[starts[have]] = True
    new &= ok
    a = np.flatnonzero(new)
    stop = np.ones(len(at) + 1, bool)
    stop[: len(at)] = new | ~ok
    stops = np.flatnonzero(stop)
    b = stops[np.searchsorted(stops, a, side="right")]
    doc = np.searchsorted(starts, a, side="right") - 1
    while (empty := lengths[doc] == 0).any():  # documents without symbols share their start with the next one
        doc[empty] -= 1
    p = at[a]
    body = roll.ranges(a, b - 1 + window)
    return {"doc": doc, "a": a - starts[doc], "n": b - a, "p": p - a, "anchor": h[p].view(np.int64), "body": mix(body ^ (p - a).astype(U64)).view(np.int64)}

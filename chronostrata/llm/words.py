"""Hashes of words, computed for whole Arrow arrays of texts at a time.

A word is a longest run of letters, digits, underscores and non-ASCII characters of the lower-cased text.
Its hash is a polynomial of its bytes modulo 2**64, taken from prefix sums over the buffer that all texts
share, and scrambled: no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), 95]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[str, np.ndarray] = {}
#: Bytes that are hashed at a time.
SEGMENT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n - 1, and their inverses."""
    if n > len(_POWERS.get("up", ())):
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), np.uint64(base))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for ordered, disjoint, non-empty ranges."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + SEGMENT, "right")))
        part = data[base : int(end[hi - 1])]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and for each text the place where its words begin (one more at the end).

    Nulls have no words.
    """
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    n = len(lower)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, raw = lower.buffers()
    offsets = np.frombuffer(offsets, np.int32)[lower.offset : lower.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    on = _WORD[data]
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = on[cut]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = on[:-1] & ~on[1:]
    ends[cut] |= on[cut - 1]
    if len(data):
        ends[-1] = on[-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return _hash(data, start, end), np.searchsorted(start, offsets)


def pair(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
    """Hashes of pairs of hashes; tag tells kinds of pair apart."""
    return mix(a * _A + b * _B + np.uint64(tag))


def shingles(h: np.ndarray, at: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """For each text, the hashes of its runs of `width` words; of all its words, if it has fewer, but some."""
    full = h
    for k in range(1, width):
        full = mix(full[: len(h) - k] * _A + h[k:]) if len(h) > k else h[:0]
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(full[lo : hi - width + 1])
        elif hi > lo:
            x = h[lo : lo + 1]
            for k in range(lo + 1, hi):
                x = mix(x * _B + h[k : k + 1])
            out.append(x)
        else:
            out.append(h[:0])
    return out

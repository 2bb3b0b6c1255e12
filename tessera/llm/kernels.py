"""Vectorised byte-level kernels run inside Arrow batches: word spans, word and window hashes, sliding minima.

All of them work on the UTF-8 bytes of many texts at once. Both word classes in use here split at ASCII
bytes only, so working on bytes is exact for any Unicode text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; a longer single text is taken whole.
SLICE = 1 << 20


def _table(pattern_out: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, bool)
    for lo, hi in pattern_out:
        t[lo : hi + 1] = False
    return t


#: Words [^\x20\x09-\x0D]+
BLANK_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text: digits, a-z and whatever isn't ASCII)
ALNUM_WORDS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(20240607)
BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Cache(dict):
    """A worker's own cache: pickled empty, as this module travels by value."""

    def __reduce__(self):
        return Cache, ()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = Cache()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, SLICE + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        got = _powers[base] = tuple(both)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of about `most` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a run of texts. starts, ends: byte positions; first: index of each text's first word, one more at the end; h: hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False, code: np.ndarray = BYTE_CODE):
        n = len(data)
        if lower:
            data = LOWER[data]
        inside = table[data]
        heads = offsets[:-1][offsets[:-1] < n]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        before[heads] = False
        if n:
            before[0] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        if n:
            after[-1] = False
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n = np.diff(self.first)
        self.inside = inside
        p, inverse = powers(_BYTE_BASE, n)
        sums = np.zeros(n + 1, U)
        np.cumsum(code[data] * p[:n], dtype=U, out=sums[1:])
        self.h = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of `width` words that starts at each word, and whether that window ends in the same text."""
        return windows(self.h, self.first, width)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    p, inverse = powers(_WORD_BASE, n)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * p[:n], dtype=U, out=sums[1:])
    out = np.zeros(n, U)
    if n >= width:
        out[: n - width + 1] = mix((sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return out, left >= width


def fold(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence of hashes."""
    n = len(h)
    p, inverse = powers(_WORD_BASE, n)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * p[:n], dtype=U, out=sums[1:])
    at = np.minimum(first[:-1], max(n - 1, 0))
    return mix((sums[first[1:]] - sums[first[:-1]]) * inverse[at] + np.diff(first).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i up to len(x) - width, by doubling."""
    if len(x) < width:
        return x[:0]
    got, out = 1, x
    while got * 2 <= width:
        out = np.minimum(out[: len(out) - got], out[got:])
        got *= 2
    if got < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - got : width - got + len(x) - width + 1])
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window of `width` words that starts at one of `starts`."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def sums_by_text(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of x (bool or int, one per byte or word) for each text."""
    c = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """list<int64> array of consecutive runs of values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind or pa.int64()))

"""Vectorised words of whole Arrow text batches: offsets and 64-bit hashes, with no Python loop over words.

A word is a maximal run of bytes that are neither space nor 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``; in UTF-8 no other
character contains those bytes, so bytes and code points split alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
#: Text bytes that one numpy pass holds at a time; about 60 bytes of memory for each. Longer texts take several passes, and 32 bytes a word.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words; every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = powers(pow(base, -1, 1 << 64) if inverse else base, size)
        if size <= 1 << 23:
            _POWERS[base, inverse] = have
    return have[:n]


def spans_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of codes[start:end] for each pair, by one prefix sum modulo 2**64."""
    n = len(codes)
    if not len(start):
        return np.zeros(0, dtype=U64)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(codes * _powers(base, n), out=sums[1:])
    out = (sums[end] - sums[start]) * _powers(base, n + 1, True)[start]
    return mix(out + (end - start).astype(U64) * U64(0x165667B19E3779F9))


def _blocks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE_BYTES that end where a document or a run of spaces does, so that no word is cut, however long the texts."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + SLICE_BYTES
        while hi < n:
            ends = bounds[np.searchsorted(bounds, hi - 4096, side="right") : np.searchsorted(bounds, hi, side="right")]
            spaces = np.flatnonzero(_SPACE[data[hi - 4096 : hi]])
            place = max(int(ends[-1]) if len(ends) else 0, hi - 4095 + int(spaces[-1]) if len(spaces) else 0)
            if place > lo:
                hi = place
                break
            hi += 4096
        yield lo, min(hi, n)
        lo = hi


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and hashes of all words; bounds are places where a word ends even without a space."""
    space = _SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    word = ~space
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        return start, end, spans_hash(_CODE[data], start, end, BYTE_BASE)


class Words:
    """The words of some documents: flat bytes, and for each word its first byte, its end, its hash; words of document i are first[i]:first[i+1]."""

    __slots__ = ("data", "doc", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        """data: bytes of all documents; bounds: byte offsets of documents, one more than there are."""
        if lower:
            data = _LOWER[data]
        starts, ends, hashes = [], [], []
        for lo, hi in _blocks(data, bounds):
            start, end, own = _words(data[lo:hi], bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, side="right")] - lo)
            starts.append(start + lo)
            ends.append(end + lo)
            hashes.append(own)
        self.data = data
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, ends))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every run of width words within one document: the index of its first word, its hash."""
        n = len(self.start)
        at = np.arange(max(0, n - width + 1))
        at = at[self.doc[at] == self.doc[at + width - 1]] if len(at) else at
        with np.errstate(over="ignore"):
            return at, spans_hash(self.hash, at, at + width, WORD_BASE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and offsets of a string array; a null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_binary()) if texts.null_count else texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of at most limit bytes, or one document that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def give_back() -> None:
    """Returns freed memory to the system: workers live on beyond their tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def lean(f: Callable) -> Callable:
    """A function of a group (key, table), or of two (key, table, table), after which freed memory is given back. Spark counts arguments, so each number has its own."""

    def one(key, table):
        out = f(key, table)
        give_back()
        return out

    def two(key, left, right):
        out = f(key, left, right)
        give_back()
        return out

    return two if f.__code__.co_argcount == 3 else one

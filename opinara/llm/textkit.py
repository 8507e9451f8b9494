"""Byte-level text kernels on numpy, shared by the operators of this subpackage.

Texts arrive as Arrow batches.  ``doc_chunks`` cuts a batch into runs of whole documents of a few MB, so that the
working memory of a kernel doesn't depend on the batch; within a run everything is vectorised over bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes in one run; a longer document is a run of its own.  A kernel takes about a hundred times as much for a moment.
CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[0-9A-Za-z]`` or of a character above U+007F.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes that aren't ASCII white space.
GRAPH = np.ones(256, bool)
GRAPH[9:14] = GRAPH[32] = False


try:
    _TRIM = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    """Gives memory that a batch has freed back to the system: a Python worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, CHUNK + 1)
        for key, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
        if m > 4 * CHUNK:  # don't hold on to the tables of one giant document
            up, down = _POWERS.pop("up"), _POWERS.pop("down")
            return up[:n], down[:n]
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [lo, hi)."""
    _, down = powers(len(h))
    return mix((h[hi] - h[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def doc_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_large_binary(texts.type) else texts, "" if not pa.types.is_large_binary(texts.type) else b"")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    release()


def token_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``table``, never across texts, and each text's first token
    (an array one longer than the texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = table[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def token_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens after lower-casing A-Z, and each text's first token."""
    starts, ends, first = token_spans(data, offsets, table)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return span_hash(prefix_hash(LOWER[data]), starts, ends), first


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``token_hashes`` gives to these words."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw]).astype(np.int64)
    if not len(data):
        return np.zeros(len(words), np.uint64)
    return span_hash(prefix_hash(LOWER[data]), ends - [len(w) for w in raw], ends)


class HashIndex:
    """Positions of 64-bit keys in a fixed set: two-slot direct addressing, then binary search for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        bits = max(8, int(len(self.keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        at = (self.keys * BASE) >> self.shift
        self.slot[at] = np.arange(len(self.keys), dtype=np.int32)
        lost = np.flatnonzero(self.slot[at] != np.arange(len(self.keys)))
        order = np.argsort(self.keys[lost])
        self.rest, self.rest_at = self.keys[lost][order], lost[order].astype(np.int32)
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[at[lost]] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of each value, -1 for those not in the set."""
        if not len(self.keys) or not len(x):
            return np.full(len(x), -1, np.int32)
        at = (x * BASE) >> self.shift
        got = self.slot[at]
        wrong = self.keys[np.maximum(got, 0)] != x
        got = np.where(wrong, np.int32(-1), got)
        if len(self.rest):
            open_ = np.flatnonzero(wrong & self.crowded[at])
            k = np.minimum(np.searchsorted(self.rest, x[open_]), len(self.rest) - 1)
            hit = self.rest[k] == x[open_]
            got[open_[hit]] = self.rest_at[k[hit]]
        return got


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text number of each token."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs: run i is [first[i], first[i + 1]).  Each run of floats is added up by itself, in order, so
    that equal runs have equal sums to the last bit."""
    if values.dtype.kind == "f":
        return np.bincount(doc_of(first), values, len(first) - 1)
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]

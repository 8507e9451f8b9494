"""MD5 of many short texts at once, and the normal numbers that are drawn from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Texts whose words are laid out at once, and hashes that are computed side by side: few enough for a core's cache.
ROWS, SIDE = 4096, 16384

_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_ADD = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURN = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).reshape(4, 4, 4).reshape(-1).astype(np.uint32)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _block(state: Sequence[np.ndarray], words: Sequence[np.ndarray]) -> list[np.ndarray]:
    """MD5's state after one block of sixteen words; each word is an array that broadcasts to the state's shape."""
    a, b, c, d = (x.copy() for x in state)
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_WORD[i]] + _ADD[i]
        np.left_shift(f, _TURN[i], out=a)
        f >>= np.uint32(32) - _TURN[i]
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip((a, b, c, d), state, strict=True)]


def _words(skip: int, data: np.ndarray, at: np.ndarray, size: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The padded blocks of ``skip`` bytes of 0 and each text, an array for each word's place."""
    text = np.zeros((len(at), 64 * blocks), np.uint8)
    row = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    text[row, skip + place] = data[np.repeat(at, size) + place]
    text[np.arange(len(at)), skip + size] = 0x80
    text[:, -8:] = ((skip + size) * 8).astype("<u8")[:, None].view(np.uint8)
    return list(np.ascontiguousarray(text.view("<u4").T))


def md5_numbers(heads: Sequence[bytes], tails: pa.Array) -> np.ndarray:
    """The first 40 bits of the MD5 of every head (all of one length) followed by every tail (texts, none null): whole numbers, a
    row for each head."""
    tails = tails.cast(pa.large_binary())
    at = np.frombuffer(tails.buffers()[1], np.int64)[tails.offset : tails.offset + len(tails) + 1]
    data = np.frombuffer(tails.buffers()[2] or b"", np.uint8)
    size, skip = np.diff(at), len(heads[0])
    blocks = (skip + size + 8) // 64 + 1
    begun = np.frombuffer(b"".join(h + bytes(-skip % 4) for h in heads), "<u4").reshape(len(heads), -1)
    out = np.empty((len(heads), len(tails)))
    for n in np.unique(blocks):
        alike = np.flatnonzero(blocks == n)
        for s in range(0, len(alike), ROWS):
            of = alike[s : s + ROWS]
            plain = _words(skip, data, at[of], size[of], int(n))
            step = max(1, SIDE // len(of))
            for h in range(0, len(heads), step):
                first = begun[h : h + step]
                words = [w | first[:, k, None] if k < first.shape[1] else w for k, w in enumerate(plain)]
                state = [np.full((len(first), len(of)), x, np.uint32) for x in _START]
                for k in range(0, len(words), 16):
                    state = _block(state, words[k : k + 16])
                out[h : h + step, of] = state[0].byteswap() * 256.0 + (state[1] & np.uint32(255))
    return out


def hashed_normals(seed: int, draws: range, tails: pa.Array) -> np.ndarray:
    """Standard normal numbers, a row for each tail and a column for each draw, from the MD5 of ``seed + k:draw:tail`` for k = 1 and 2
    (Box and Muller's)."""
    out = np.empty((len(tails), len(draws)))
    for length in {len(str(d)) for d in draws}:
        mine = [d for d in draws if len(str(d)) == length]
        u1, u2 = ((md5_numbers([f"{seed + k}:{d}:".encode() for d in mine], tails) + 0.5) / float(1 << 40) for k in (1, 2))
        out[:, mine[0] - draws[0] : mine[-1] - draws[0] + 1] = (np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)).T
    return out

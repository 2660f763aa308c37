"""Vectorised tokenising and hashing of whole Arrow text columns.

Texts are handled as one byte buffer with document offsets, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step takes on; a longer document is taken in pieces cut at white space.
STEP = 1 << 19

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


_BYTE = keys(256, 1)
_P = 0x9FB21C651E98DF25
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP + 4096)
        have = np.full(size, U64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 8 * STEP:
            return have
        _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its document offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STEP bytes that cut no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STEP)
        while end < n and not _WS[data[end]]:
            window = data[end : end + 4096]
            ws = np.flatnonzero(_WS[window])
            nxt = off[np.searchsorted(off, end)]
            end = min(end + (int(ws[0]) if len(ws) else len(window)), int(max(nxt, end)) if nxt >= end else n)
            if end == nxt:
                break
        yield at, end
        at = end


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, in order; words never cross documents."""
    hashes, starts, ends = [], [], []
    for a, b in _pieces(data, off):
        part = data[a:b]
        solid = ~_WS[part]
        cut = off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inside = cut[(cut >= 0) & (cut < len(part))]
        first[inside] = solid[inside]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        before = inside[inside > 0] - 1
        last[before] = solid[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if not len(s):
            continue
        value = _BYTE[_LOWER[part] if lower else part]
        value *= powers(_P, len(part))
        np.add.accumulate(value, out=value)
        h = value[e]
        h[s > 0] -= value[s[s > 0] - 1]
        h *= powers(_P_INV, len(part))[s]
        hashes.append(mix64(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(s + a)
        ends.append(e + 1 + a)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a word sequence; of the whole sequence if it has fewer than k words."""
    if not len(words):
        return words
    k = min(k, len(words))
    salt = keys(k, 7)
    out = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j] + salt[j])
    return out


def numbers(column: pa.Array, fill: int = 0) -> np.ndarray:
    return column.fill_null(fill).to_numpy(zero_copy_only=False)


def crc32_texts(ids: pa.Array) -> np.ndarray:
    """crc32 of the ids written as text; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()], np.int64)

"""Vectorised words, word hashes and rolling hashes over Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 never
uses those bytes inside a longer character, so working on bytes is exact.
Hashing goes through the text in slices of bounded size, whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_SLICE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U(33))
        x = x * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


#: Words of more bytes are hashed one at a time.
_LONG = 64
_K = _U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = 4 * _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is at most ``limit`` bytes, or one row."""
    _, offs = utf8(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: Every ASCII byte but letters and digits, for text whose punctuation should not stick to words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def bounds(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document its first word (n + 1); ``between`` marks the bytes between words."""
    word = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~word[:-1]
    after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z, and each ``seed`` gives a hash unrelated to the others.

    Eight bytes at a time are mixed into what came before; a word of more than
    ``_LONG`` bytes gets a cryptographic digest instead.
    """
    out = np.empty(len(starts), _U)
    key = seed.to_bytes(8, "little")
    a = 0
    with np.errstate(over="ignore"):
        salt = mix(np.array([seed + 1], _U) * _K)[0]
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SLICE, "right")))
            lo, hi = starts[a], ends[b - 1]
            part = np.zeros(int(hi - lo) + 8, np.uint8)
            part[:-8] = _LOWER[data[lo:hi]] if lower else data[lo:hi]
            eight = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
            s, n = starts[a:b] - lo, ends[a:b] - starts[a:b]
            h = mix((salt + n.astype(_U) * _K) ^ (eight[s] & _KEEP[np.minimum(n, 8)]))
            for j in range(8, _LONG, 8):
                more = np.flatnonzero(n > j)
                if not len(more):
                    break
                h[more] = mix(h[more] ^ (eight[s[more] + j] & _KEEP[np.minimum(n[more] - j, 8)]))
            for i in np.flatnonzero(n > _LONG).tolist():
                h[i] = int.from_bytes(blake2b(part[s[i] : s[i] + n[i]], digest_size=8, key=key).digest(), "little")
            out[a:b] = h
            a = b
    return out


def rolling(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each ``k`` consecutive values (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    acc = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            acc *= _U(base)
            acc += h[j : j + n]
    return mix(acc)


def starts_within(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which ``k`` words of one document start; ``first`` as from bounds()."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    total = int(n.sum())
    return np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Hashes of words and of byte ranges for whole Arrow batches at a time, with NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are handled together until they come to so many bytes; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
WORD_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=8)
def byte_codes(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, CHUNK_BYTES + 4096)
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 2 * CHUNK_BYTES:
        _powers[:] = out
    return out[0][:n], out[1][:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, the rows' bytes, and where each row starts in them (with the end)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, starts: np.ndarray, seed: int = 7, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (run of bytes that aren't ASCII white space): row, hash, first byte, end byte. Words end with their row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~WORD_SPACE[data]
    edge = inside[1:] != inside[:-1]
    first = np.flatnonzero(edge & inside[1:])
    end = np.flatnonzero(edge & inside[:-1])
    cuts = starts[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        first, end = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([end, cuts]))
    pw, inv = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    codes = byte_codes(seed)
    np.cumsum((codes[LOWERED] if lower else codes)[data] * pw, out=sums[1:])
    h = mixed((sums[end] - sums[first]) * inv[first] + (end - first).astype(np.uint64))
    return np.searchsorted(starts, first, "right") - 1, h, first, end


def range_hashes(data: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of bytes [a, b) is (sums[b] - sums[a]) * inv[a]."""
    pw, inv = powers(max(len(data), 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * pw[: len(data)], out=sums[1:])
    return sums, inv

"""Hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; one longer text goes by itself.
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 8 * CHUNK_BYTES:
            return tables[0], tables[1]  # not kept
        _powers = tables[0], tables[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def fold(parts: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros_like(parts[0])
        for p in parts:
            h = h * np.uint64(_BASE) + p
        return mix(h)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= most:
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash, start, end of each word, the first word of each text and the number of all, the
    joined bytes). A-Z count as a-z."""
    joined = b" " + b" ".join(texts).lower() + b" "
    b = np.frombuffer(joined, np.uint8)
    gap = _GAP[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(b))
    with np.errstate(over="ignore"):
        run = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)
        h = mix((run[end - 1] - run[start - 1]) * down[start] + (end - start).astype(np.uint64))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]) + 1)
    return h, start, end, first, joined

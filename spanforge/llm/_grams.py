"""Runs of few bytes inside words, over whole buffers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def grams(flat: np.ndarray, blank: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the buckets of the runs that start at each byte, and which of them count:
    those without a blank but at either end.  Sizes are between 2 and 8; the first is the least."""
    n = len(flat)
    x = flat.astype(np.uint64)
    code = x.copy()
    inner = np.zeros(n + 9, np.int32)  # blanks before each place
    np.cumsum(blank, out=inner[1 : n + 1])
    inner[n + 1 :] = inner[n] + 1
    for size in range(2, max(sizes) + 1):
        if n >= size:
            code[: n - size + 1] |= x[size - 1 :] << np.uint64(8 * (size - 1))
        if size not in sizes:
            continue
        h = (code + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        ok = inner[1 : n + 1] == inner[size - 1 : n + size - 1]
        ok[max(0, n - size + 1) :] = False
        yield (h >> np.uint64(64 - bits)).astype(np.int32), ok

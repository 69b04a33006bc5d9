"""Words of many UTF-8 texts at once, as numpy arrays over one joined buffer.

Texts are joined by line feeds, which separate words in every use here.  A word is a
half-open span of the buffer, and its 64-bit hash comes from prefix sums of a polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LOWER = np.frombuffer(LOWER, np.uint8)
_BASE = 0x9E3779B97F4A7C15

#: Bytes that separate words: white space, and all that is no ASCII letter or digit below 0x80.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and those of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences are the polynomials of spans."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], dtype=np.uint64, out=h[1:])
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = prefix(data)
    return mix((h[ends] - h[starts]) * powers(len(data) + 1)[1][starts])


def words(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = (~separators[data]).view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def chunks(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buffer, offsets) of runs of texts of about ``limit`` bytes; text i starts
    at offsets[i - first] and each is followed by one line feed.  None counts as empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1]) + 1
        if size >= limit or i == len(texts) - 1:
            lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
            yield first, i + 1, np.frombuffer(b"\n".join(held) + b"\n", np.uint8), offsets
            first, size, held = i + 1, 0, []


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by block prefixes and suffixes."""
    n = len(a)
    p = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    p[:n] = a
    p = p.reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])

"""A run-length text index and the repeats that it finds.

The Burrows-Wheeler transform of some contexts is kept as runs with the text positions of each
run's first and last suffix.  Within a run, neighbours in suffix order stay neighbours one
byte to the left, so a suffix's longest match elsewhere follows from that of the suffix before
it, less one byte; only at run ends it has to be measured.  Matching statistics of the whole
text against its other places are therefore one pass over the text with two numbers a run.
"""

from __future__ import annotations

import numpy as np


def _ranks(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the keys' order, equal for equal keys."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))) if len(k) else k
    return out


class RunLengthIndex:
    """Of the contexts data[edge[i]:edge[i + 1]]; matches never cross their ends."""

    def __init__(self, data: np.ndarray, edge: np.ndarray) -> None:
        n = len(data)
        self.edge = edge
        rest = np.repeat(edge[1:], np.diff(edge)) - np.arange(n)  # bytes up to the context's end
        # seven symbols of nine bits a key; 0 ends a context
        code = np.zeros(n, np.uint64)
        symbol = data.astype(np.uint64) + np.uint64(1)
        for j in range(min(7, n)):
            code[: n - j] |= symbol[j:] << np.uint64(9 * (6 - j))
        for j in range(1, 7):  # what lies past the end
            at = edge[1:] - j
            at = at[at >= 0]
            at = at[rest[at] == j]
            code[at] &= np.uint64(((1 << 63) - 1) ^ ((1 << (9 * (7 - j))) - 1))
        levels: list[tuple[int, np.ndarray]] = []
        rank = _ranks(code)
        levels.append((7, rank))
        size, longest = 7, int(np.diff(edge).max(initial=0))
        while size < longest and rank.max(initial=0) + 1 < n:
            # suffixes are ranked by twice the length; past a context's end the rank is 0
            second = np.zeros(n, np.int64)
            inside = rest > size
            second[inside] = rank[np.flatnonzero(inside) + size] + 1
            rank = _ranks(rank * (n + 1) + second)
            size *= 2
            levels.append((size, rank))
        order = np.argsort(rank * n + np.arange(n))  # equal suffixes in text order, which the step to the left keeps
        head = np.zeros(n, bool)
        head[edge[:-1][np.diff(edge) > 0]] = True
        before = np.where(head[order], -1 - np.arange(n), data[order - 1].astype(np.int64))
        new = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))) if n else order
        self.n_runs = len(new)
        self.heads = before[new]
        self.first = order[new]
        self.last = order[np.append(new[1:], n) - 1] if n else order
        self._rest, self._levels, self._symbol = rest, levels, symbol

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, by their ranks for falling lengths."""
        out = np.zeros(len(a), np.int64)
        most = np.minimum(self._rest[a], self._rest[b])
        for size, rank in reversed(self._levels):
            ok = np.flatnonzero(out + size <= most)
            ok = ok[rank[a[ok] + out[ok]] == rank[b[ok] + out[ok]]]
            out[ok] += size
        for _ in range(6):
            ok = np.flatnonzero(out < most)
            ok = ok[self._symbol[a[ok] + out[ok]] == self._symbol[b[ok] + out[ok]]]
            out[ok] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of its longest match that starts elsewhere."""
        n = len(self._rest)
        best = np.zeros(n, np.int64)
        if self.n_runs < 2:
            runs = [(self.first[:0], self.first[:0])] * 2
        else:
            runs = [(self.first[1:], self.last[:-1]), (self.last[:-1], self.first[1:])]
        for own, other in runs:
            at = np.full(n, -1, np.int64)
            length = np.zeros(n, np.int64)
            edge = self.first[:1] if own is runs[0][0] else self.last[-1:]  # no neighbour on this side
            at[edge] = edge
            at[own] = own
            length[own] = self._common(own, other)
            from_ = np.maximum.accumulate(at)
            known = from_ >= 0
            best[known] = np.maximum(best[known], length[from_[known]] - (np.flatnonzero(known) - from_[known]))
        return np.maximum(best, 0)


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the places whose next ``length`` bytes also start at another place."""
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, contexts), np.int64, len(contexts)))))
    ms = RunLengthIndex(np.frombuffer(b"".join(contexts), np.uint8), edge).matching_statistics()
    return [np.flatnonzero(ms[a:b] >= length) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

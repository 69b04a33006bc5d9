"""Periodic runs of words inside texts (operator 11).

A run is a longest stretch of words that repeats with its smallest period q, at least ``times`` (3 or
more) periods and ``least`` words long.  ``collapsed`` texts keep a run's first period.

*Lag scans.*  Periods below ``_DIRECT`` are found by comparing all words with those q further on.
*Minimizers.*  Longer periods are dealt to scales: one for the periods from ``a`` to ``b`` (half as much
again).  A scale hashes every run of ``b - 1`` words and marks the minima of all windows of
``2a - b + 2`` neighbouring hashes.  A run of period q in [a, b) holds two whole windows that lie q
apart; their words are equal, so their minima lie q apart too.  Between them the same hash can't
occur: b - 1 >= q words that are equal at a smaller distance would give the run a smaller period.
So each run is seen as two equal minima that are next to each other in order of hash and place,
and there are no more such pairs than words.  Pairs whose distance is in the scale are seeds;
they are extended word by word in both directions until the period breaks.  Texts without any two
equal minima on the least scale have no long periods at all and take no part in the others.

All texts of a batch are worked through at once: words of different texts have different numbers,
so no stretch crosses from one text to the next.  Equal numbers mean equal words, and stretches are
compared by numbers; hashes only choose what is compared.  The work is about n log n for n
words, and its memory some hundred bytes a word of one batch or of the longest text.

Defined results: a null or empty text has no words and no runs and collapses to an empty one;
repeated rows are judged row by row; an empty table gives an empty one; other columns are
ignored by ``periodic_runs`` and kept by ``collapsed``, where null texts stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mix, sliding_min
from ._frame import Framed, narrow, table

_DIRECT = 12
_CHUNK = 64
_MIXER = np.uint64(0xD6E8FEB86659FD93)


def stretches(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(ok.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice as many words; where the words end, a value that nothing else has."""
    out = mix(np.arange(len(h), dtype=np.uint64) + np.uint64(step << 40))
    if len(h) > step:
        out[: len(h) - step] = mix(h[:-step] * _MIXER + h[step:])
    return out


def _minima(g: np.ndarray, window: int) -> np.ndarray:
    """Places of all minima of ``window`` neighbours."""
    low = np.zeros(len(g) + window - 1, np.uint64)
    low[window - 1 : len(g)] = sliding_min(g, window)
    return np.flatnonzero(~sliding_min(~low, window) == g)


def _seeds(h: np.ndarray, step: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance) of equal neighbouring minima of the scale [a, b), and all their places."""
    size, window = b - 1, 2 * a - b + 2
    if len(h) < size + window:
        return (np.zeros(0, np.int64),) * 3
    g = mix(h[: len(h) - size + 1] * _MIXER + h[size - step : size - step + len(h) - size + 1])
    at = _minima(g, window)
    at = at[np.argsort(g[at], kind="stable")]
    same = np.flatnonzero(g[at[1:]] == g[at[:-1]])
    left, far = at[same], at[same + 1] - at[same]
    fit = (far >= a) & (far < b)
    return left[fit], far[fit], at[same]


def _extended(w: np.ndarray, at: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (step 1) or before it (step -1) equal those q further on."""
    total, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    reach = np.arange(_CHUNK)
    while len(todo):
        i = at[todo, None] + step * (total[todo, None] + reach) - (step < 0)
        j = i + q[todo, None]
        same = (w[np.clip(i, 0, len(w) - 1)] == w[np.clip(j, 0, len(w) - 1)]) & (i >= 0) & (j < len(w))
        n = np.where(same.all(axis=1), _CHUNK, np.argmin(same, axis=1))
        total[todo] += n
        todo = todo[n == _CHUNK]
    return total


def _grown(w: np.ndarray, at: np.ndarray, q: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches around the seeds; ``size`` words from each place on are as the hash says."""
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (at[1:] > at[:-1] + size)))
    first = np.flatnonzero(new)
    lo, hi, q = at[first], at[np.append(first[1:], len(at)) - 1] + size, q[first]
    hi = hi + _extended(w, hi, q, 1)
    lo = lo - _extended(w, lo, q, -1)
    for a, b, p in sorted(set(zip(lo.tolist(), hi.tolist(), q.tolist(), strict=True))):
        for s, e in zip(*stretches(w[a:b] == w[a + p : b + p]), strict=True):
            yield a + int(s), a + int(e) + p, p


def _factors(q: int) -> Iterator[int]:
    f = 2
    while f * f <= q:
        if q % f == 0:
            yield f
            while q % f == 0:
                q //= f
        f += 1
    if q > 1:
        yield q


def _smallest(w: np.ndarray, s: int, e: int, q: int) -> bool:
    return not any(np.array_equal(w[s : e - q // f], w[s + q // f : e]) for f in _factors(q))


def numbered(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts and the edges of the texts; each text has its own numbers."""
    ids: list[int] = []
    edges, base = [0], 0
    for words in texts:
        known: dict = {}
        ids += [known.setdefault(x, base + len(known)) for x in words]
        base += len(known)
        edges.append(len(ids))
    return np.array(ids, np.int64), np.array(edges)


def find_runs(texts: list[list], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start, then period."""
    if times < 3:
        raise ValueError("runs have three periods at least")
    w, edges = numbered(texts)
    found: set[tuple[int, int, int]] = set()
    for q in range(1, min(_DIRECT, len(w))):
        s, e = stretches(w[:-q] == w[q:])
        long = np.flatnonzero(e - s + q >= max(least, times * q))
        found.update((int(s[i]), int(e[i]) + q, q) for i in long)
    place, h, step, a = np.arange(len(w)), mix(w.astype(np.uint64)), 1, _DIRECT
    size = np.diff(edges)
    while True:
        b = a * 3 // 2
        fit = np.repeat(size >= times * a, size)[place]
        place, h = place[fit], h[fit]
        if not len(place):
            break
        while 2 * step <= b - 1:
            h, step = _doubled(h, step), 2 * step
        at, q, twice = _seeds(h, step, a, b)
        if len(at):
            found.update(x for x in _grown(w, place[at], q, b - 1) if x[1] - x[0] >= max(least, times * x[2]))
        if a == _DIRECT:
            some = np.zeros(len(size), bool)
            some[np.searchsorted(edges, place[twice], "right") - 1] = True
            open_ = np.repeat(some, size)[place]
            place, h = place[open_], h[open_]
        a = b
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in sorted(found, key=lambda x: (x[0], x[2])):
        if _smallest(w, s, e, q):
            doc = int(np.searchsorted(edges, s, "right")) - 1
            out[doc].append((s - int(edges[doc]), e - s, q))
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    ok = np.ones(n, bool)
    for s, length, q in runs:
        ok[s + q : s + length] = False
    return ok


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))
REPORT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.BinaryType())])


def report_udf(least: int = 24, times: int = 3, limit: int = 1 << 20):
    """binary text -> (number of words, runs, the text of the words that stay)."""

    @F.arrow_udf(REPORT)
    def report(texts: pa.Array) -> pa.Array:
        counts, flat, ends, left = [], [], [0], []

        def solve(part: list[list[bytes]]) -> None:
            for words, runs in zip(part, find_runs(part, least, times), strict=True):
                counts.append(len(words))
                flat.extend(runs)
                ends.append(len(flat))
                if runs:
                    words = [x for x, ok in zip(words, kept(len(words), runs).tolist(), strict=True) if ok]
                left.append(b" ".join(words))

        held, size = [], 0
        for t in texts:
            t = t.as_py() or b""
            held.append(t.split())  # at the bytes 0x20 and 0x09 to 0x0D
            size += len(t)
            if size > limit:
                solve(held)
                held, size = [], 0
        solve(held)
        columns = np.array(flat, np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(left, pa.binary())], REPORT.names)

    return report


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row; runs: (start, length, period) by start, then period; collapsed: bytes."""
    f = narrow(docs, id_col, text_col).select(F.col(id_col), report_udf(least, times)(F.col(text_col).cast("binary")).alias("_r"))
    return f.select(id_col, "_r.n_words", "_r.runs", "_r.collapsed")


def collapsed(docs: DataFrame, least: int = 24, times: int = 3, text_col: str = "text") -> DataFrame:
    """docs, all columns, with each run reduced to its first period; texts without a run are left as they are."""
    f = Framed(docs, text_col)
    text = F.col(f.columns[0])
    r = report_udf(least, times)(text.cast("binary"))
    return f.keep(lambda d: d.withColumn("_r", r), **{text_col: F.when(F.size("_r.runs") > 0, F.col("_r.collapsed").cast("string")).otherwise(text)})


def longest(runs: Column) -> Column:
    """Of runs the one with the greatest exact length/period; ties go to the smallest start, then period."""
    def before(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        sooner = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))
        return F.when((a > b) | ((a == b) & sooner), x).otherwise(y)

    return F.reduce(F.slice(runs, 2, 1 << 30), F.get(runs, F.lit(0)), lambda best, x: before(x, best))


@F.arrow_udf(T.BinaryType())
def _planted(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    """Texts whose words go on periodically from some word on, in one of ten; see the operator's contract."""
    out = []
    for t, h in zip(texts, hashes.to_pylist(), strict=True):
        t = t.as_py()
        if h is not None and h % 10 == 0 and t and (n := len(words := t.split())):
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            t = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        out.append(t)
    return pa.array(out, pa.binary())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    texts = docs.select("doc_id", _planted(F.col("text").cast("binary"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    found = periodic_runs(texts).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

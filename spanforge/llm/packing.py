"""Packing of token sequences by patterns and non-negative least squares (operator 3).

1. Each text is encoded and cut into pieces of at most ``capacity`` tokens.
2. The histogram of the pieces' lengths (at most ``capacity`` counts) comes to the driver.
3. Patterns of few lengths that fill a sequence are enumerated: one to four lengths with exact
   sums.  Non-negative repeat counts are fitted so that the patterns use up the histogram
   (multiplicative least squares), rounded down and clipped to what is there.
4. What remains is packed by best fit, longest first, on counts instead of pieces.
5. The plan lists, for each pattern and slot, which ranks of a length it takes.  Its size is
   bounded by the number of patterns and slots, not by the corpus, so it is broadcast; each
   piece finds its place by its length and its rank among the pieces of this length.

Ranks come from salted windows: pieces of one length are numbered within ``salts`` groups, and
the groups' sizes are added up, so a length that a third of all pieces share is not one task.

Defined results: a null or empty text is the end mark alone; repeated rows are packed each; a
null id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frame import narrow, table
from ._scratch import cut, parts
from ._tokens import tokenizer

CAPACITY = 4096
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_udf(path: str, capacity: int, end_id: int):
    """binary text -> its pieces (piece, start, length, ids_crc32)."""
    kind = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))

    @F.arrow_udf(kind)
    def pieces(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        count, piece, start, length, crc = [], [], [], [], []
        end = np.array([end_id], "<u4")
        for _, ids in tokenizer(path).encode(rows):
            ids = np.concatenate((ids, end))
            raw = memoryview(ids).cast("B")
            n = len(ids)
            for p, a in enumerate(range(0, n, capacity)):
                b = min(n, a + capacity)
                piece.append(p)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            count.append(-(-n // capacity))
        values = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), values)

    return pieces


def few_piece_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (0: none) with the exact sum ``capacity``, all among ``lengths``.

    All single lengths and pairs; for three and four, each length with splits of the rest into
    halves, thirds and quarters and their neighbourhood.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    a = lengths[:, None]
    rest = capacity - a
    splits = []
    spread = np.array([0, 7, 31, 101, 233])
    for share in (2, 3, 4):
        b = rest // share + spread
        splits.append(np.stack([np.broadcast_to(a, b.shape), b, rest - b, np.zeros_like(b)], -1).reshape(-1, 4))
        c = (rest - b) // 2 + spread[::-1]
        splits.append(np.stack([np.broadcast_to(a, b.shape), b, c, rest - b - c], -1).reshape(-1, 4))
    zero = np.zeros_like(lengths)
    splits.append(np.stack([lengths, capacity - lengths, zero, zero], -1))
    p = np.concatenate(splits)
    p = p[(p >= 0).all(1) & (p <= capacity).all(1)]
    return np.unique(np.sort(p[have[p].all(1)], axis=1)[:, ::-1], axis=0)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that makes the patterns' use of each length close to the histogram.

    Multiplicative updates x <- x * (A'h) / (A'Ax) of least squares; A is never formed.
    """
    if not len(patterns):
        return np.zeros(0)
    h = histogram.astype(np.float64)
    h[0] = 0
    used = patterns > 0

    def back(y: np.ndarray) -> np.ndarray:
        return (y[patterns] * used).sum(1)

    target = back(h)
    x = np.full(len(patterns), h.sum() / (4.0 * len(patterns)))
    for _ in range(rounds):
        use = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=len(h))
        use[0] = 0
        x *= target / np.maximum(back(use), 1e-12)
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of sequences, longest pieces first, each into the fullest that has room."""
    room: dict[int, list[list]] = defaultdict(list)
    free = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            at = length + int(free[length:].argmax())
            if at > capacity or not free[at]:
                fit = max(1, capacity // length)
                whole, rest = divmod(left, fit)
                # no open sequence has room: new ones take as many of this length as they can
                for count, k in ((whole, fit), (1 if rest else 0, rest)):
                    if count:
                        r = capacity - k * length
                        room[r].append([count, (length,) * k])
                        free[r] = True
                break
            group = room[at][-1]
            k = min(at // length, max(1, left // group[0]))
            take = min(group[0], left // k)
            group[0] -= take
            if not group[0]:
                room[at].pop()
                free[at] = bool(room[at])
            r = at - k * length
            room[r].append([take, group[1] + (length,) * k])
            free[r] = True
            left -= take * k
    return [(c, p) for groups in room.values() for c, p in groups if c]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of all sequences; together they use up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    patterns = few_piece_patterns(lengths, capacity) if len(lengths) else np.zeros((0, 4), np.int64)
    x = fit_counts(patterns, left)
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 1:
            break
        lens, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        if n := min(int(x[i]), int((left[lens] // times).min())):
            left[lens] -= n * times
            out.append((n, tuple(int(v) for v in patterns[i] if v)))
    return out + best_fit(left, capacity)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first, offset) of each pattern's slots."""
    out, taken, sequence = [], defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            out.append((n, taken[n], taken[n] + count, sequence, offset))
            taken[n] += count
            offset += n
        sequence += count
    return out


def place_udf(rows: list[tuple[int, int, int, int, int]], capacity: int):
    """(length, rank) -> (sequence_id, offset) by the plan."""
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    stride = int(t[:, 2].max(initial=0)) + 1
    first = t[:, 0] * stride + t[:, 1]
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.arrow_udf(kind)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(first, n * stride + r, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(t[i, 3] + r - t[i, 1]), pa.array(t[i, 4])], kind.names)

    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every text."""
    spark = docs.sparkSession
    salts = parts(spark)
    rows = narrow(docs, id_col, text_col)
    found = rows.select(F.col(id_col).alias("id"), F.explode(pieces_udf(path or tokenizer_path(), capacity, end_id)(F.col(text_col).cast("binary"))).alias("p"))
    pieces = cut(found.select("id", "p.*").withColumn("salt", F.floor(F.rand(7) * salts).cast("int")))
    counts = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r.length] = r.n
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = (pieces.withColumn("r", F.row_number().over(within) - 1).join(before, ["length", "salt"])
              .withColumn("rank", F.col("r") + F.col("before")))
    at = place_udf(slots(plan(histogram, capacity)), capacity)
    return ranked.withColumn("at", at("length", "rank")).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

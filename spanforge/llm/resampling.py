"""Resampling towards a target distribution by importance weights of hashed word runs (operator 13).

1. *Words.*  ``tokenizers`` splits the text, lowered in A-Z, by one fixed pattern; nothing is
   trained.  Bytes are handed over as Latin-1, so that the offsets that come back are byte offsets.
2. *Buckets.*  Windows of 1 to ``most`` neighbouring offset pairs are the features.  The CRC-32 of
   a window follows from those of its words, which are computed once for each distinct word of a
   batch, by the shift of a checksum over the bytes that follow it.  The bucket is the CRC modulo ``buckets``.
3. *Gains.*  The buckets of every document are stored once; their histogram (``buckets`` rows, whatever
   the input is) and that of the target give a gain for each bucket, and a document's weight is the
   floored mean of its features' gains.
4. *Draw.*  Gumbel noise keyed by seed and id is added, and the highest scores are drawn.  Scores are
   integers within bounds (gains below 1000 * ln of the product of both feature totals), so counts by
   score are a small table; ranks are its running sums and a window within each score.  No row
   meets more rows than those with its own score.

Defined results: a null or empty text has no features and weight 0; a null id counts as an empty
one in the noise; repeated rows are rows of their own, ties of score and id are drawn in any order
(equal ids have equal noise); an empty table gives an empty one, an empty target has counts of
zero; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from ._bytes import LOWER
from ._frame import narrow, table
from ._scratch import stored

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Neighbouring scores whose running sums are formed together.
_SPAN = 512
#: Words up to this length use shift tables; the few longer ones are joined byte by byte.
_LONGEST = 63


def _shifts(longest: int) -> np.ndarray:
    """(length, byte place, byte value) -> what that byte of a CRC becomes after so many zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = one[out[n] & 255] ^ (out[n] >> 8)
    return out


_TABLES = _shifts(_LONGEST + 1)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksums as if n zero bytes followed, without the conditioning of these bytes."""
    return _TABLES[n, 0, crc & 255] ^ _TABLES[n, 1, (crc >> 8) & 255] ^ _TABLES[n, 2, (crc >> 16) & 255] ^ _TABLES[n, 3, crc >> 24]


class Features:
    """Words and buckets of texts."""

    def __init__(self, most: int, buckets: int) -> None:
        self.most, self.buckets = most, buckets
        self.split = Split(Regex(PATTERN), "removed", invert=True)

    def offsets(self, text: bytes) -> list[tuple[int, int]]:
        return [at for _, at in self.split.pre_tokenize_str(text.decode("latin-1"))]

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(number of words, buckets of all features) of each text."""
        known: dict[bytes, int] = {}
        ids, ends = [], [0]
        for t in texts:
            low = (t or b"").translate(LOWER)
            ids += [known.setdefault(low[a:b], len(known)) for a, b in self.offsets(low)]
            ends.append(len(ids))
        word, end = np.array(ids, np.int64), np.array(ends)
        crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
        spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))
        size = np.fromiter(map(len, known), np.int64, len(known)) + 1
        words = list(known)
        doc = np.repeat(np.arange(len(texts)), np.diff(end))
        level = crc[word]
        parts, owner = [level % np.uint32(self.buckets)], [doc]
        for n in range(2, self.most + 1):  # runs of n words from those of n - 1
            last = word[n - 1 :]
            whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
            level, last = level[: len(last)], last
            long = size[last] > _LONGEST
            joined = shifted(level, np.where(long, 0, size[last])) ^ spaced[last]
            for i in np.flatnonzero(long).tolist():
                joined[i] = zlib.crc32(b" " + words[last[i]], int(level[i]))
            level = joined
            parts.append(level[whole] % np.uint32(self.buckets))
            owner.append(doc[: len(last)][whole])
        own = np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        flat = np.concatenate(parts)[order].astype(np.int32)
        return np.diff(end), np.split(flat, np.searchsorted(own[order], np.arange(1, len(texts)))) if texts else []


def _batches(texts: pa.Array, limit: int = 1 << 21) -> Iterator[list[bytes | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or b"") + 1
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


FEATURES = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("b", T.ArrayType(T.IntegerType()))])


def features_udf(most: int = 2, buckets: int = BUCKETS):
    """binary text -> (number of words, buckets of its features)."""

    @F.arrow_udf(FEATURES)
    def features(texts: pa.Array) -> pa.Array:
        made, counts, lists = Features(most, buckets), [np.zeros(0, np.int64)], []
        for part in _batches(texts):
            n, b = made.of(part)
            counts.append(n)
            lists += b
        ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *lists]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.ListArray.from_arrays(ends, flat)], FEATURES.names)

    return features


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in the arrays b of rows; a task gives one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("b").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket, target over source."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weight_udf(gain: np.ndarray):
    @F.arrow_udf(T.LongType())
    def weight(rows: pa.Array) -> pa.Array:
        n = np.diff(rows.offsets.to_numpy())
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(gain[rows.flatten().to_numpy()])))
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        return pa.array((sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1))

    return weight


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """rows (id, eligible, score, ...) with ``rank``: the place of those drawn, the highest scores first."""
    of = stored(rows.where("eligible").groupBy("score").agg(F.count("*").alias("n")), "scores")
    spans = of.groupBy(F.floor(F.col("score") / _SPAN).alias("span")).agg(F.sum("n").alias("n"))
    down = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = (of.agg(F.sum("n").alias("n")).first().n or 0) * percent // 100
    # the spans are a few hundred rows, for they divide the range of the scores
    above = spans.select("span", down(Window.partitionBy(F.lit(0)).orderBy(F.desc("span"))).alias("over"))
    own = of.select("score", F.floor(F.col("score") / _SPAN).alias("span"), down(Window.partitionBy(F.floor(F.col("score") / _SPAN)).orderBy(F.desc("score"))).alias("within"))
    before = own.join(above, "span").select("score", (F.col("over") + F.col("within")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("score", "eligible").orderBy(F.col("id").asc_nulls_last()))
    return (rows.join(before, "score", "left").withColumn("_place", place)
            .withColumn("rank", F.when(F.col("eligible") & (F.col("_place") <= quota), F.col("_place"))).drop("before", "_place"))


def resampled(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20,
              seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank is null where a row is not drawn.

    ``percent`` of the rows with ``least_words`` words or more are drawn, those with the highest
    scores, without replacement.
    """
    found = features_udf(most, buckets)
    rows = narrow(docs, id_col, text_col).select(F.col(id_col).alias("id"), found(F.col(text_col).cast("binary")).alias("f"))
    rows = stored(rows.select("id", "f.n_words", "f.b"), "features")
    wanted = narrow(target, target_text).select(found(F.col(target_text).cast("binary")).alias("f")).select("f.b")
    weight = _weight_udf(gains(histogram(rows, buckets), histogram(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(rows.select("id", F.size("b").cast("long").alias("n_features"), weight("b").alias("weight"), (F.col("n_words") >= least_words).alias("eligible"))
                    .withColumn("score", F.col("weight") + noise), "scored")
    return ranked(scored, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the benchmark is the target."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same for DuckDB: the checksum's table comes from its polynomial, bytes are folded one by one.
OP13_SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT v, v, 0 FROM (SELECT CAST(range AS UBIGINT) AS v FROM range(256))
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (SELECT row_number() OVER () AS r, kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT r, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
per AS (SELECT r, kind, f, count(*) AS n FROM f GROUP BY ALL),
crc AS (SELECT f, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS UBIGINT))),
               lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS INTEGER) AS b
        FROM (SELECT DISTINCT f FROM per), tab),
pb AS (SELECT r, kind, b, sum(n) AS n FROM per JOIN crc USING (f) GROUP BY ALL),
h AS (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM pb GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM h),
g AS (SELECT b, CAST(floor(1000 * ln((h.t + 1)::DOUBLE * (tot.s + 10000) / ((h.s + 1)::DOUBLE * (tot.t + 10000)))) AS BIGINT) AS g FROM h, tot),
weight AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM pb JOIN g USING (b) WHERE kind = 0 GROUP BY r),
scored AS (SELECT w.r, id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS UBIGINT)::DOUBLE AS h FROM w LEFT JOIN weight USING (r) WHERE kind = 0),
s2 AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
place AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) AS p, count(*) FILTER (n_words >= 20) OVER () AS n FROM s2)
SELECT id AS doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN n_words >= 20 AND p <= 25 * n // 100 THEN p END AS BIGINT) AS rank FROM place
"""

"""Quality of documents by supervised subword embeddings (operator 9).

Each white-space token, each run of three to five bytes inside a token (with one blank on either
side) and the mark of a token that repeats the one before have learned vectors in a hashed table.  A document is the average of its
features' vectors; a linear layer and a softmax give the classes' chances.  Vectors and layer
are trained by stochastic gradient descent in numpy on at most ``bound`` labelled texts that
aren't held out.  For scoring, each bucket's vector is folded with the layer into one number,
so a document's logit is the mean of its features' numbers plus the bias.

Defined results: a null or empty text has no features and gets the chance of the bias alone;
repeated rows score each; without labelled rows of both classes every score is the share of
label 1 (1 without any); an empty table gives an empty result; further columns are ignored.
Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import WHITE, chunks, span_hash, words
from ._frame import narrow, table
from ._grams import grams
from ._labelled import held_out, sample

BUCKET_BITS = 17
SIZES = (3, 4, 5)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, which of them count, first place of each text) of each kind of feature."""
    flat = data.copy()
    blank = WHITE[data]
    flat[blank] = 0x20
    s, e = words(flat, WHITE)
    word, first = span_hash(flat, s, e), np.searchsorted(s, offsets[:-1])
    yield (word >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.ones(len(s), bool), first
    again = np.zeros(len(s), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[first < len(s)]] = False
    yield np.zeros(len(s), np.int32), again, first  # bucket 0: a token that repeats the one before
    # a blank before the first text, so that each text begins with the blank before it
    for bucket, ok in grams(np.append(np.uint8(0x20), flat), np.append(True, blank), SIZES, BUCKET_BITS):
        yield bucket, ok, offsets[:-1]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values from each first place up to the next."""
    total = np.concatenate((np.zeros(1), np.cumsum(values, dtype=np.float64)))
    return np.diff(total[np.append(first, len(values))])


class Model:
    def __init__(self, folded: np.ndarray, bias: float) -> None:
        self.folded, self.bias = folded.astype(np.float32), bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, last, data, offsets in chunks(texts):
            total, n = np.zeros(last - first), np.zeros(last - first)
            for bucket, ok, begin in features(data, offsets):
                total += sums(self.folded[bucket] * ok, begin)
                n += sums(ok, begin)
            out[first:last] += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-out))


def train(rows: list[tuple[bytes, int]], dim: int = 12, epochs: int = 12, rate: float = 1.0, seed: int = 1) -> Model:
    """Softmax regression on averaged vectors, one text a step, with a falling rate."""
    y = np.array([v for _, v in rows])
    size = 1 << BUCKET_BITS
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 1.0
        return Model(np.zeros(size), float(40 * (2 * share - 1)))
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for t, _ in rows:
        found = features(np.frombuffer(t + b"\n", np.uint8), np.array([0, len(t) + 1]))
        ids, n = np.unique(np.concatenate([bucket[ok] for bucket, ok, _ in found]), return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = bags[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            v = share @ table_[ids]
            z = v @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the loss by the logits
            g = layer @ p
            layer -= step * np.outer(v, p)
            bias -= np.float32(0.1) * step * p
            table_[ids] -= (step * len(ids) ** 0.5) * np.outer(share, g)
    return Model(table_ @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = 4000, **names: str) -> Model:
    return train(sample(docs, labels, "quality", bound, **names))


def score_udf(model: Model):
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()))

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = narrow(docs, id_col, text_col)
    return rows.withColumn("score", score_udf(model)(F.col(text_col).cast("binary"))).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))

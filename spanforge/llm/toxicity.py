"""Toxic documents by multiple-instance learning (operator 6).

A document is a bag of sentences and only the bag has a label.  A sentence's chance of being
toxic is a logistic function of its features' weights; the document's is their noisy-or,
``1 - prod(1 - p)``.  The weights are trained from document labels alone, by the likelihood
of the bags; afterwards the sentences with a high chance are the offending ones.

Words are runs of ASCII letters, digits and bytes beyond ASCII, in lower case.  Features are
whole words and runs of four to six bytes inside a word (with one blank on either side), hashed
into a table.  Only features that are clearly more frequent in toxic than in clean training
texts get a weight.  Sentences end at ``.``, ``!``, ``?`` and line feeds, and at latest after
``longest`` words.  Training takes at most ``bound`` labelled texts that aren't held out.

Defined results: a null or empty text has no sentences and scores 0; repeated rows score each;
without labelled rows of both classes every score is next to 0; an empty table gives an empty
result; further columns are ignored or, in the filter, returned.  Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import NON_ALNUM, chunks, lowered, span_hash, words
from ._frame import Framed, narrow, table
from ._grams import grams
from ._labelled import held_out, sample

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


BUCKET_BITS = 20
SIZES = (4, 5, 6)


class Bags:
    """Sentences of a run of texts: their texts, first words and features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int = 40) -> None:
        low = lowered(data)
        self.blank = NON_ALNUM[low]
        self.s, self.e = words(low, NON_ALNUM)
        part = np.cumsum(_STOP[low], dtype=np.int32)[self.s]
        here = np.arange(len(self.s))
        new = np.concatenate(([True], part[1:] != part[:-1])) if len(part) else np.zeros(0, bool)
        run = here - np.maximum.accumulate(np.where(new, here, 0)) if len(part) else here
        self.begin = np.flatnonzero(new | (run % longest == 0))
        self.doc = np.searchsorted(offsets, self.s[self.begin], side="right") - 1
        self.low = low

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(buckets, which of them count, first place of each sentence) of each kind of feature."""
        word = (span_hash(self.low, self.s, self.e) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        yield word, np.ones(len(word), bool), self.begin
        # with a blank before the first text; runs that begin with the blank before a word are the word's
        flat = np.append(np.uint8(0x20), np.where(self.blank, np.uint8(0x20), self.low))
        for bucket, ok in grams(flat, np.append(True, self.blank), SIZES, BUCKET_BITS):
            yield bucket, ok, self.s[self.begin]


class Model:
    """Weights of buckets, and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def logits(self, bags: Bags) -> np.ndarray:
        z = np.full(len(bags.begin), self.bias)
        for bucket, ok, start in bags.features():
            w = self.weights[bucket]
            at = np.flatnonzero((w != 0) & ok)
            of = np.searchsorted(start, at, side="right") - 1
            z += np.bincount(of[of >= 0], weights=w[at[of >= 0]], minlength=len(z))
        return z

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, last, data, offsets in chunks(texts):
            bags = Bags(data, offsets)
            stay = np.bincount(bags.doc, weights=-np.logaddexp(0, self.logits(bags)), minlength=last - first)
            out[first:last] = -np.expm1(stay)
        return out


def _lift(rows: list[tuple[bytes, int]], y: np.ndarray, least_docs: int, least_lift: float) -> np.ndarray:
    """Which buckets are in at least ``least_docs`` toxic texts and that much more frequent there."""
    count = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for t, v in rows:
        bags = Bags(np.frombuffer(t + b"\n", np.uint8), np.array([0, len(t) + 1]))
        count[v, np.unique(np.concatenate([b[ok] for b, ok, _ in bags.features()]))] += 1
    toxic, clean = count[1] / y.sum(), (count[0] + 0.5) / (len(y) - y.sum())
    return (count[1] >= least_docs) & (toxic > least_lift * clean)


def train(rows: list[tuple[bytes, int]], least_docs: int = 5, least_lift: float = 3.0, rounds: int = 200, l1: float = 0.5, rate: float = 0.2) -> Model:
    """Full-gradient Adagrad on the bags' likelihood with soft thresholding of the weights."""
    y = np.array([v for _, v in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BUCKET_BITS), -40.0)
    kept = _lift(rows, y, least_docs, least_lift)
    number = np.cumsum(kept) - 1
    feature, sent, doc_of, n_sent = [], [], [], 0
    for first, _, data, offsets in chunks([t for t, _ in rows]):
        bags = Bags(data, offsets)
        for bucket, ok, start in bags.features():
            at = np.flatnonzero(kept[bucket] & ok)
            of = np.searchsorted(start, at, side="right") - 1
            feature.append(number[bucket[at[of >= 0]]])
            sent.append(of[of >= 0] + n_sent)
        doc_of.append(bags.doc + first)
        n_sent += len(bags.begin)
    feature, sent, doc_of = (np.concatenate(x) for x in (feature, sent, doc_of))
    w, b = np.zeros(int(kept.sum())), -6.0
    g2, gb2 = np.full(len(w), 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(sent, weights=w[feature], minlength=n_sent)
        p = 1 / (1 + np.exp(-z))
        stay = np.bincount(doc_of, weights=-np.logaddexp(0, z), minlength=len(y))
        bag = np.maximum(-np.expm1(stay), 1e-9)
        # the loss by z: p for clean bags, -p (1 - P) / P for toxic ones
        g = np.where(y[doc_of] > 0, -p * np.exp(stay[doc_of]) / bag[doc_of], p)
        gw, gb = np.bincount(feature, weights=g[sent], minlength=len(w)), g.sum()
        g2 += gw * gw
        gb2 += gb * gb
        step = rate / np.sqrt(g2)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * gb / np.sqrt(gb2)
    weights = np.zeros(1 << BUCKET_BITS)
    weights[kept] = w
    return Model(weights, float(b))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = 8000, **names: str) -> Model:
    return train(sample(docs, labels, "toxic", bound, **names))


def score_udf(model: Model):
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()))

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = narrow(docs, id_col, text_col)
    return rows.withColumn("score", score_udf(model)(F.col(text_col).cast("binary"))).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, chance, sentence): byte spans, from first to last word, of toxic sentences."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("chance", T.DoubleType()), T.StructField("sentence", T.StringType())]))

    @F.arrow_udf(kind)
    def spans(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        out: list[list[dict]] = [[] for _ in rows]
        for first, _, data, offsets in chunks(rows):
            bags = Bags(data, offsets)
            s, e, begin, doc, z = bags.s, bags.e, bags.begin, bags.doc, model.logits(bags)
            last = np.append(begin[1:], len(s)) - 1
            for k in np.flatnonzero(z >= np.log(threshold / (1 - threshold))).tolist():
                a, b = int(s[begin[k]] - offsets[doc[k]]), int(e[last[k]] - offsets[doc[k]])
                i = first + int(doc[k])
                out[i].append({"start": a, "end": b, "chance": float(1 / (1 + np.exp(-z[k]))), "sentence": rows[i][a:b].decode("utf-8", "replace")})
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64()), ("sentence", pa.string())])))

    rows = narrow(docs, id_col, text_col)
    return rows.select(id_col, F.explode(spans(F.col(text_col).cast("binary"))).alias("s")).select(id_col, "s.*")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold."""
    f = Framed(docs, text_col)
    return f.keep(lambda d: d.where(score_udf(model)(F.col(f.columns[0]).cast("binary")) < threshold))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))

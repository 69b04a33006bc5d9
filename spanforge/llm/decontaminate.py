"""Benchmark decontamination through a positional inverted index (operator 7).

1. *Counts.*  One pass over the corpus counts, for each benchmark term, the documents that
   hold it.  A window (an item's run of consecutive words) with a term that no document holds
   cannot occur and is left out; the others are anchored on their rarest term.
2. *Postings.*  A second pass stores, for each document that holds the anchor term of some
   window, the sorted positions of every term that a window needs: the postings of a document
   are one row (terms, ends, positions) of a Parquet table in the shared folder.
3. *Intersection.*  From the rarest term on, the lists of a window's terms, each moved back by
   the term's place in the window, are intersected; what is left are the exact starts.
   Proximity search takes the same lists and finds the least spans that hold all terms.

The benchmark is worked through in blocks of at most ``block_words`` words, one after the other,
each with its own passes and its own table of postings; so the driver and each task hold one
block.  The corpus is never grouped or collected: documents stay where they are read, so frequent
words, passages that many documents share and large groups of copies put no more than their own
share on any task.  Only the hits of a text, keyed by its md5, are joined to its documents.

Defined results: a null or empty text has no words and is not contaminated; repeated rows and
repeated ids are judged row by row; items without words never occur; items with the same id
are one item; an item with a null id makes hits but is not counted among the items; further
columns are ignored or, in the filter, returned.  Words are compared by 64-bit hashes, all words
of a window one by one, so a wrong hit needs as many collisions as the window has words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import NON_ALNUM, chunks, lowered, span_hash, words
from ._frame import Framed, narrow, table
from ._scratch import stored

WINDOW = 10


class Vocabulary:
    """Numbers of benchmark terms by their hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.keys = np.unique(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's term, -1 for words of no benchmark item."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            ok = self.keys[at] == h[maybe]
            out[maybe[ok]] = at[ok]
        return out


def _terms(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes of the words, first word of each text and the end) by runs of texts."""
    for first, last, data, offsets in chunks(texts):
        low = lowered(data)
        s, e = words(low, NON_ALNUM)
        yield first, last, span_hash(low, s, e), np.searchsorted(s, offsets)


class Block:
    """Windows of some benchmark items: term numbers, their items, and lengths."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int) -> None:
        hashes: list[np.ndarray] = []
        for _, _, h, edge in _terms([t for _, t in items]):
            hashes += [h[edge[i] : edge[i + 1]] for i in range(len(edge) - 1)]
        self.vocabulary = Vocabulary(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))
        self.items: list[tuple[object, np.ndarray]] = []
        found: dict[bytes, list[int]] = {}
        for (ident, _), h in zip(items, hashes, strict=True):
            ident = None if ident is None else str(ident)
            n = self.vocabulary.numbers(h)
            if not len(n):
                continue
            self.items.append((ident, n))
            for a in range(max(1, len(n) - window + 1)):
                found.setdefault(n[a : a + window].tobytes(), []).append(len(self.items) - 1)
        self.windows = [(np.frombuffer(k, np.int32), v) for k, v in found.items()]
        self.anchored: dict[int, list[int]] = {}
        self.needed = np.zeros(len(self.vocabulary.keys), bool)
        self.anchor = self.needed.copy()

    def weigh(self, df: np.ndarray) -> None:
        """Anchor each window that can occur on its rarest term."""
        self.df = df
        for i, (terms, _) in enumerate(self.windows):
            if (n := df[terms]).min() > 0:
                self.anchored.setdefault(int(terms[np.argmin(n)]), []).append(i)
                self.needed[terms] = True
        self.anchor[list(self.anchored)] = True


def _df_udf(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.keys), np.int64)
        for batch in batches:
            for _, _, h, edge in _terms(batch.column(0).to_pylist()):
                n = vocabulary.numbers(h)
                doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
                ok = n >= 0
                pair = np.unique(doc[ok] * len(total) + n[ok])
                total += np.bincount(pair % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    return run


POSTINGS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("positions", T.ArrayType(T.IntegerType())),
])


def _postings_udf(block: Block):
    vocabulary, needed, anchor = block.vocabulary, block.needed, block.anchor

    @F.arrow_udf(POSTINGS)
    def postings(texts: pa.Array) -> pa.Array:
        n_words, terms, ends, positions = [], [], [], []
        for _, _, h, edge in _terms(texts.to_pylist()):
            n = vocabulary.numbers(h)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                n_words.append(b - a)
                own = n[a:b]
                at = np.flatnonzero(own >= 0)
                if len(at) and anchor[own[at]].any():
                    at = at[needed[own[at]]]
                    order = np.argsort(own[at], kind="stable")
                    t, first = np.unique(own[at][order], return_index=True)
                    terms.append(t)
                    ends.append(np.append(first[1:], len(at)).astype(np.int32))
                    positions.append(at[order].astype(np.int32))
                else:
                    terms.append(np.zeros(0, np.int32))
                    ends.append(np.zeros(0, np.int32))
                    positions.append(np.zeros(0, np.int32))

        def lists(x: list[np.ndarray]) -> pa.Array:
            flat = np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(flat))

        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), lists(terms), lists(ends), lists(positions)], POSTINGS.names)

    return postings


class Lists:
    """The postings of one document."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray) -> None:
        self.terms, self.at = terms, {t: i for i, t in enumerate(terms.tolist())}
        self.ends, self.positions = [0, *ends.tolist()], positions.astype(np.int64)

    @classmethod
    def each(cls, rows: pa.Array) -> Iterator[tuple[int, Lists]]:
        """(row number, postings) of the rows that have any, straight from the Arrow buffers."""
        found = []
        for name in ("terms", "ends", "positions"):
            x = rows.field(name)
            found.append((x.offsets.to_numpy(), x.values.to_numpy()))
        (at, terms), (_, ends), (where, positions) = found
        for i in np.flatnonzero(np.diff(at)).tolist():
            a, b = at[i], at[i + 1]
            yield i, cls(terms[a:b], ends[a:b], positions[where[i] : where[i + 1]])

    def of(self, term: int) -> np.ndarray | None:
        i = self.at.get(term)
        return None if i is None else self.positions[self.ends[i] : self.ends[i + 1]]

    def phrase(self, terms: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase: lists moved by their offset, intersected from the rarest on."""
        starts: np.ndarray | None = None
        for o in np.argsort(df[terms], kind="stable").tolist():
            if (p := self.of(int(terms[o]))) is None:
                return np.zeros(0, np.int64)
            starts = p - o if starts is None else np.intersect1d(starts, p - o, assume_unique=True)
            if not len(starts):
                break
        return starts

    def near(self, terms: np.ndarray, slack: int) -> list[tuple[int, int]]:
        """Least spans of at most len(terms) + slack words that hold all terms, in any order."""
        need, lists = np.unique(terms, return_counts=True), []
        for t, c in zip(*need, strict=True):
            if (p := self.of(int(t))) is None or len(p) < c:
                return []
            lists.append((p, int(c)))
        out: list[tuple[int, int]] = []
        for start in np.unique(np.concatenate([p for p, _ in lists])).tolist():
            last = start
            for p, c in lists:
                i = int(np.searchsorted(p, start)) + c - 1
                if i >= len(p):
                    return out
                last = max(last, int(p[i]))
            if last - start < len(terms) + slack:
                if out and out[-1][1] == last + 1:
                    out.pop()  # the shorter span with the same end
                out.append((start, last + 1))
        return out


MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _as_matches(rows: list[list[tuple[str | None, int, int]]]) -> pa.Array:
    return pa.array([[{"item": i, "start": a, "end": b} for i, a, b in r] for r in rows],
                    pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def _phrases_udf(block: Block):
    anchored, windows, df, ids = block.anchored, block.windows, block.df, [ident for ident, _ in block.items]

    @F.arrow_udf(MATCHES)
    def phrases(rows: pa.Array) -> pa.Array:
        out: list[list[tuple[str | None, int, int]]] = [[] for _ in range(len(rows))]
        for i, lists in Lists.each(rows):
            for term in lists.terms.tolist():
                for w in anchored.get(term, ()):
                    terms, items = windows[w]
                    for a in lists.phrase(terms, df).tolist():
                        out[i] += [(ids[k], a, a + len(terms)) for k in items]
        return _as_matches(out)

    return phrases


def _near_udf(block: Block, slack: int):
    items, df = block.items, block.df

    @F.arrow_udf(MATCHES)
    def near(rows: pa.Array) -> pa.Array:
        by: dict[int, list[int]] = {}
        for i, (_, terms) in enumerate(items):
            if df[terms].min() > 0:
                by.setdefault(int(terms[np.argmin(df[terms])]), []).append(i)
        out: list[list[tuple[str | None, int, int]]] = [[] for _ in range(len(rows))]
        for i, lists in Lists.each(rows):
            out[i] = [(items[k][0], a, b) for t in lists.terms.tolist() for k in by.get(t, ()) for a, b in lists.near(items[k][1], slack)]
        return _as_matches(out)

    return near


def _blocks(benchmark: DataFrame, text: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark's items in blocks of at most block_words words (or one item), weighed by the corpus (t)."""
    rows = narrow(benchmark, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    held: list[tuple[object, bytes]] = []
    size = 0

    def made() -> Block:
        block = Block(held, window)
        df = np.zeros(len(block.vocabulary.keys), np.int64)
        for r in text.mapInArrow(_df_udf(block.vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r.term] = r.n
        block.weigh(df)
        return block

    for r in rows.orderBy("id", "t").toLocalIterator():
        n = len(r.t) // 2 + 1  # words are a byte and a separator at least
        if held and size + n > block_words:
            yield made()
            held, size = [], 0
        held.append((r.id, bytes(r.t)))
        size += n
    yield made()


class Index:
    """Stored postings of a corpus for the terms of a benchmark, a table for each block of it."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000,
                 doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> None:
        f = Framed(docs, doc_id, text_col)
        text = F.col(f.columns[1]).cast("binary")
        rows = f.df.select(F.col(f.columns[0]).alias("doc_id"), F.md5(text).alias("m"), text.alias("t"))
        self.docs: DataFrame | None = None
        self.tables: list[tuple[DataFrame, Block]] = []
        for block in _blocks(benchmark, rows.select("t"), window, block_words, item_id, item_text):
            found = rows.select("doc_id", "m", _postings_udf(block)("t").alias("p"))
            if self.docs is None:  # the first block's table has every document, the others only those with an anchor
                table_ = stored(found, "postings")
                self.docs = table_.select("doc_id", "m", F.col("p.n_words").alias("n_words"))
            else:
                table_ = stored(found.where(F.size("p.terms") > 0), "postings")
            self.tables.append((table_.where(F.size("p.terms") > 0), block))

    def _found(self, udf_of) -> DataFrame:
        """(m, item, start, end): matches of all blocks by the text's md5, stored block by block."""
        out = None
        for table_, block in self.tables:
            own = stored(table_.select("m", F.explode(udf_of(block)("p")).alias("x")).select("m", "x.item", F.col("x.start").alias("start"), F.col("x.end").alias("end")).distinct(), "matches")
            out = own if out is None else out.union(own)
        return out.distinct()

    def phrases(self) -> DataFrame:
        """(doc_id, item, start, end) of each occurrence of a window, in words; item: the item's id as text."""
        return self._listed(self._found(_phrases_udf))

    def near(self, slack: int = 5) -> DataFrame:
        """(doc_id, item, start, end): spans that hold all of an item's words and at most ``slack`` others.

        Only documents with the anchor term of one of the item's windows have postings; a span
        that holds all of an item's words holds those terms.
        """
        return self._listed(self._found(lambda b: _near_udf(b, slack)))

    def _listed(self, found: DataFrame) -> DataFrame:
        return self.docs.join(found, "m").select("doc_id", "item", "start", "end").distinct()

    def report(self) -> DataFrame:
        """One row for each document; see op7_decontamination."""
        by = self._found(_phrases_udf).groupBy("m").agg(F.collect_list(F.struct("item", "start", "end")).alias("x"))
        digest = stored(by.select("m", _digest_udf()("x").alias("d")), "digests")
        d = self.docs.join(digest, "m", "left")
        n_hit = F.coalesce("d.n_hit", F.lit(0))
        return d.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), n_hit.alias("n_hit"), F.coalesce("d.n_items", F.lit(0)).alias("n_items"),
                        F.coalesce("d.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _digest_udf():
    kind = T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def digest(rows: pa.Array) -> pa.Array:
        hit, count, sha = [], [], []
        for row in rows.to_pylist():
            n, last = 0, 0
            for a, b in sorted({(m["start"], m["end"]) for m in row}):
                n += max(0, b - max(a, last))
                last = max(last, b)
            names = sorted({m["item"] for m in row if m["item"] is not None})
            hit.append(n)
            count.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], kind.names)

    return digest


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000, **names: str) -> DataFrame:
    """The rows of docs, with all columns, that hold no window of the benchmark.

    Postings and verdict are columns of the same rows, so that no row needs a key; what one block
    leaves is stored before the next block is taken up.
    """
    f = Framed(docs, names.get("text_col", "text"))
    text = F.col(f.columns[0]).cast("binary")
    left, held = f.df, None
    for block in _blocks(benchmark, f.df.select(text.alias("t")), window, block_words, names.get("item_id", "item_id"), names.get("item_text", "text")):
        left = left if held is None else stored(held, "clean")
        held = left.where(F.size(_phrases_udf(block)(_postings_udf(block)(text))) == 0)
    return f.keep(lambda _: held)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    return Index(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).report()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, w[i:i + least(len(w), {WINDOW}) - 1] AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Edit-aware token counts (operator 4).

A text is split into pre-tokens, which merges never cross, and every ``leaf`` of them are one
leaf of a segment tree that holds the characters and tokens below each node.  An edit (start,
deleted, inserted) in characters descends the tree to the leaves it touches; the splitting
starts again at the last leaf's edge that is at least two characters before the edit, because
no pre-token looks further ahead, and stops at the first old leaf's edge behind the edit at
which the new splitting stands too; from there on it can't differ.  Only that region is encoded
again, and only the sums above its leaves are updated.

``trees`` encodes each text once and stores it with its leaves as a table in the shared folder;
``recounted`` applies edits to rows of that table and encodes nothing but the touched regions.
Its result holds the new text and leaves, and may be stored as the next state of the table.

Defined results: a null or empty text has 0 tokens; an edit is clipped to the text that it finds;
edits apply in their order; repeated rows are counted each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frame import narrow, table
from ._scratch import stored

LEAF = 64


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PieceCounter:
    """Pre-tokens of a text and token counts by a rank file; one for each worker process."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(k) for k in ranks]

    def count(self, pieces: list[str]) -> int:
        """Tokens of consecutive pre-tokens.  Their text alone splits as it does in its place, but for
        white space at its end, which would join; that is encoded piece by piece."""
        n = len(pieces)
        while n and pieces[n - 1].isspace():
            n -= 1
        return sum(len(self.encoding.encode_ordinary(x)) for x in ("".join(pieces[:n]), *pieces[n:]))

    def leaves(self, text: str, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of every ``leaf`` pre-tokens of a text, which is encoded once."""
        split = self.pattern.findall(text)
        at = np.arange(0, len(split), leaf)
        if not len(at):
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        chars = np.add.reduceat(np.fromiter(map(len, split), np.int64, len(split)), at)
        size = chars
        if not text.isascii():
            size = np.add.reduceat(np.fromiter(map(len, map(str.encode, split)), np.int64, len(split)), at)
        ends = np.cumsum(self.width[np.array(self.encoding.encode_ordinary(text), np.int64)])
        return chars, np.diff(np.searchsorted(ends, np.cumsum(size), side="right"), prepend=0)


_made: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _made:
        _made[path] = PieceCounter(path)
    return _made[path]


class SegmentTree:
    """Characters and tokens of a text's leaves, with their sums in a complete binary tree."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = 1 << max(0, len(chars) - 1).bit_length()
        self.leaves = len(chars)
        self.sums = np.zeros((2 * self.n, 2), np.int64)
        self.sums[self.n : self.n + len(chars), 0] = chars
        self.sums[self.n : self.n + len(chars), 1] = tokens
        level = self.n
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def of(cls, text: str, pieces: PieceCounter, leaf: int = LEAF) -> SegmentTree:
        return cls(*pieces.leaves(text, leaf))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def kept(self) -> np.ndarray:
        """(characters, tokens) of the leaves, to be stored; empty ones are left out."""
        own = self.sums[self.n : self.n + self.leaves]
        own = own[own[:, 0] > 0]
        return own if len(own) else np.zeros((1, 2), np.int64)

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The last leaf that starts at or before the character, and where it starts."""
        node, start = 1, 0
        while node < self.n:
            left = int(self.sums[2 * node, 0])
            go_right = char >= start + left and self.sums[2 * node + 1, 0] > 0
            start += left if go_right else 0
            node = 2 * node + int(go_right)
        return node - self.n, start

    def size(self, leaf: int) -> int:
        return int(self.sums[self.n + leaf, 0])

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Change one leaf and the sums above it."""
        node = self.n + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, start: int, deleted: int, inserted: str, pieces: PieceCounter) -> tuple[str, int, int]:
        """(new text, leaves encoded again, their characters); the tree then belongs to the new text."""
        start = min(max(0, start), len(text))
        stop = min(len(text), start + max(0, deleted))
        new = text[:start] + inserted + text[stop:]
        moved = len(new) - len(text)
        first, begin = self.leaf_at(max(0, start - 2))
        last, edge, at, found = first + 1, begin + self.size(first), begin, []
        for m in pieces.pattern.finditer(new, begin):
            # the old edge that the splitting may have reached
            while last < self.leaves and (edge < stop or edge + moved < m.start()):
                edge += self.size(last)
                last += 1
            if m.start() == edge + moved and edge >= stop:
                break
            found.append(m.group())
            at = m.end()
        else:
            last, edge = self.leaves, len(text)
        self.put(first, at - begin, pieces.count(found))
        for leaf in range(first + 1, last):
            if self.size(leaf):
                self.put(leaf, 0, 0)
        return new, last - first, at - begin


EDIT = "array<struct<start:bigint,deleted:bigint,inserted:string>>"
TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _tree_udf(path: str, leaf: int):
    @F.arrow_udf(TREE)
    def build(texts: pa.Array) -> pa.Array:
        pieces = counter(path)
        got = [pieces.leaves(t.as_py() or "", leaf) for t in texts]
        return pa.StructArray.from_arrays([_lists([g[0] for g in got]), _lists([g[1] for g in got])], TREE.names)

    return build


def trees(docs: DataFrame, path: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (id, text, tree): the characters and tokens of every ``leaf`` pre-tokens of each text."""
    rows = narrow(docs, id_col, text_col)
    return stored(rows.withColumn("tree", _tree_udf(path or ranks_path(), leaf)(F.col(text_col))), "trees")


_RESULT = T.StructType([*[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_leaves", "n_tokens_after", "n_chars_after", "leaves_encoded", "chars_encoded")],
                        T.StructField("text", T.StringType()), T.StructField("tree", TREE)])


def _recount_udf(path: str):
    @F.arrow_udf(_RESULT)
    def recount(texts: pa.Array, own: pa.Array, edits: pa.Array) -> pa.Array:
        pieces, rows, new, after = counter(path), [], [], []
        for t, kept, todo in zip(texts, own, edits, strict=True):
            text, kept = t.as_py() or "", kept.as_py()
            tree = SegmentTree(np.array(kept["chars"], np.int64), np.array(kept["tokens"], np.int64))
            before, leaves, encoded, chars = tree.tokens, tree.leaves if text else 0, 0, 0
            for e in todo.as_py() or ():
                text, a, b = tree.edit(text, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "", pieces)
                encoded, chars = encoded + a, chars + b
            rows.append((before, leaves, tree.tokens, tree.chars, encoded, chars))
            new.append(text)
            after.append(tree.kept())
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        tree = pa.StructArray.from_arrays([_lists([x[:, 0] for x in after]), _lists([x[:, 1] for x in after])], TREE.names)
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(new, pa.string()), tree], _RESULT.names)

    return recount


def recounted(kept: DataFrame, edits: Column, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_leaves, n_tokens_after, n_chars_after, leaves_encoded, chars_encoded, text, tree).

    kept: rows of ``trees`` (or an earlier result of this), perhaps with a column of the type
    ``EDIT`` joined to them; edits: that column or another over kept's columns.
    """
    rows = kept.select(id_col, text_col, "tree", edits.cast(EDIT).alias("_edits"))
    found = rows.select(id_col, _recount_udf(path or ranks_path())(F.col(text_col), F.col("tree"), F.col("_edits")).alias("r"))
    return found.select(id_col, *[F.col("r")[n].alias(n if n != "text" else text_col) for n in _RESULT.names])


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``trees`` with the edits (id, seq, start, deleted, inserted) of each id, in order, as column edits."""
    own = (edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "deleted", "inserted"))).alias("e"))
           .select(F.col(id_col).alias("_id"), F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["deleted"].alias("deleted"), x["inserted"].alias("inserted"))).alias("edits")))
    return docs.join(own, docs[id_col] == own["_id"], "left").drop("_id")


def revision(id_col: str, text_col: str) -> Column:
    """Three edits of a text that follow from its id and length: a word put in, a passage cut out,
    and a passage replaced by the text's own beginning."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    at = [F.pmod(F.crc32(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(k)))), n + 1).cast("long") for k in range(3)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = [F.struct(at[0].alias("start"), F.lit(0).cast("long").alias("deleted"), F.lit(" revised, ").alias("inserted")),
           F.struct(at[1].alias("start"), F.lit(25).cast("long").alias("deleted"), F.lit("").alias("inserted")),
           F.struct(at[2].alias("start"), F.lit(40).cast("long").alias("deleted"), F.substring(text, 1, 60).alias("inserted"))]
    return F.array(*one)


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trees(table(spark, sf_dir, "documents"))
    return recounted(kept, revision("doc_id", "text")).drop("text", "tree")

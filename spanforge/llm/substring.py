"""Exact substring deduplication with a run-length index (operator 2).

Every byte covered by a string of ``length`` bytes that starts anywhere else too is removed.

1. *Distinct texts* go to a bucketed table; all bytes of a text with copies are repeats.
2. *Anchors.*  Each window of ``length`` bytes selects the least hash of its runs of ``core``
   bytes (by its upper half), the last one of equal ones.  The windows of one anchor are consecutive, so they are a
   context; each window is in one context, and equal windows have contexts of equal key and lie
   at the same distance from their anchors.  Contexts whose key occurs once can't repeat.
3. *Hot keys.*  A key with more than ``most`` different contexts is split by the distance of
   window and anchor, in halves, and keyed by the bytes that all windows of a half share, until
   few contexts are left; with one distance left the bytes are the window itself.  Only one of
   equal contexts is split: all windows of the copies are repeats already.
4. *Index.*  Contexts are collapsed, dealt out by key and indexed about a megabyte at a time
   (``rindex``): a run-compressed Burrows-Wheeler transform with sampled run ends, over which
   matching statistics are streamed.  Windows with a match of ``length`` bytes, and all windows
   of contexts that occur more than once, are repeats.
5. Spans are merged for each text, removed, and the rest is hashed.

Defined results: a null text is empty; repeated rows count as copies of each other; texts shorter
than ``length`` lose nothing; null and repeated ids are kept as they are; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mix, powers, prefix, sliding_min
from ._frame import table
from ._scratch import cut, parts, stored
from ._texts import distinct_texts, keyed
from .rindex import repeated_starts

LENGTH = 400
CORE = 128


def anchors(text: bytes, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first window, last window) of a text's anchors."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < length:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    h = prefix(b)
    n = len(b) - core + 1
    x = mix((h[core:] - h[:-core]) * powers(n)[1])
    w = length - core + 1
    # half of the hash and the place in one number, so that the least of a window is its anchor, the last of equal ones
    last = np.uint64(0xFFFFFFFF)
    least = sliding_min((x & ~last) | (last - np.arange(n, dtype=np.uint64)), w)
    out = (last - (least & last)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], out[1:] != out[:-1])))
    place = out[new]
    return x[place], place, new, np.append(new[1:], len(out)) - 1


def _anchor_udf(length: int, core: int):
    kind = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        found = [anchors(t, length, core) for t in texts.to_pylist()]
        flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
        values = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), *[pa.array(x.astype(np.int32)) for x in flat[1:]]], ["key", "place", "lo", "hi"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(f[0]) for f in found]]), pa.int32()), values)

    return find


def _halves(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts split by the distance of window and anchor into cells of ``width`` distances."""
    n = F.length("ctx") - length  # the last window's place in the context
    cells = rows.withColumn("cell", F.explode(F.sequence(F.floor((F.col("lead") - n) / width), F.floor(F.col("lead") / width))))
    far = F.least(F.col("lead"), (F.col("cell") + 1) * width - 1)  # the greatest distance: the first window
    near = F.greatest(F.col("lead") - n, F.col("cell") * width)
    first = (F.col("lead") - far).cast("int")
    shared = F.col("ctx").substr((F.col("lead") - F.col("cell") * width).cast("int") + 1, F.lit(length - width + 1))
    return cells.select(
        "u", (F.col("lo") + first).cast("int").alias("lo"), far.cast("int").alias("lead"),
        F.xxhash64("key", "cell", shared).alias("key"), F.col("ctx").substr(first + 1, (far - near + length).cast("int")).alias("ctx"))


def _index_run(length: int, limit: int):
    """Arrow batches of (key, ctx, m) sorted by key -> (key, ctx_key, from, to) of repeated windows."""
    names = ["key", "ctx_key", "first", "last"]

    def solve(held: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], []]
        for (key, ctx, m), starts in zip(held, repeated_starts([c for _, c, _ in held], length), strict=True):
            if m > 1:
                starts = np.arange(len(ctx) - length + 1)
            if not len(starts):
                continue
            gap = np.flatnonzero(np.diff(starts) > 1)
            for a, b in zip(starts[np.append(0, gap + 1)].tolist(), starts[np.append(gap, len(starts) - 1)].tolist(), strict=True):
                for col, v in zip(cols, (key, hashlib.md5(ctx).hexdigest(), a, b), strict=True):
                    col.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        size = 0
        for batch in batches:
            for key, ctx, m in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= limit and key != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append((key, ctx, m))
                size += len(ctx)
        if held:
            yield from solve(held)

    return run


def _kept_udf(length: int):
    kind = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    @F.arrow_udf(kind)
    def kept(texts: pa.Array, marks: pa.Array) -> pa.Array:
        removed, spans, sha, where = [], [], [], []
        for t, own in zip(texts.to_pylist(), marks.to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((x["first"], x["last"] + length) for x in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(t[at:a])
                at = b
            digest.update(t[at:])
            removed.append(sum(b - a for a, b in merged))
            spans.append(len(merged))
            sha.append(digest.hexdigest())
            where.append(merged)
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(where, pa.list_(pa.list_(pa.int64())))], kind.names)

    return kept


def repeats(texts: DataFrame, length: int = LENGTH, core: int = CORE, most: int = 256, limit: int = 1 << 20) -> DataFrame:
    """(u, first, last): runs of windows of the distinct texts (u, t) that also start elsewhere."""
    spark = texts.sparkSession
    found = stored(texts.select("u", F.explode(_anchor_udf(length, core)("t")).alias("a")).select("u", "a.*"), "anchors")
    shared = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    own = found.join(shared, "key").groupBy("u").agg(F.collect_list(F.struct("key", "place", "lo", "hi")).alias("a"))
    cuts = texts.join(own, "u").select("u", "t", F.explode("a").alias("a"))
    rows = stored(cuts.select(
        "u", "a.lo", (F.col("a.place") - F.col("a.lo")).alias("lead"), "a.key",
        F.col("t").substr(F.col("a.lo") + 1, F.col("a.hi") - F.col("a.lo") + length).alias("ctx")), "contexts")
    width, cold, marks = length - core + 1, [], []
    while True:
        several = rows.groupBy("key", "ctx").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("n"))
        hot = cut(several.where(F.col("n") > most).select("key"))
        if width == 1 or hot.isEmpty():
            cold.append(rows)
            break
        cold.append(rows.join(hot, "key", "left_anti"))
        # copies of a context are repeats as a whole; one of them goes on, for the others to match
        copied = rows.join(hot, "key").withColumn("ctx_key", F.md5("ctx"))
        alike = stored(copied.groupBy("key", "ctx").agg(
            F.count("*").alias("m"), F.min(F.struct("u", "lo", "lead")).alias("one")), "alike")
        marks.append(copied.join(alike.where("m > 1").select("key", F.md5("ctx").alias("ctx_key")), ["key", "ctx_key"])
                     .select("u", F.col("lo").alias("first"), (F.col("lo") + F.length("ctx") - length).alias("last")))
        width = -(-width // 2)
        split = stored(_halves(alike.select("one.*", "key", "ctx"), width, length), "contexts")
        live = split.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        rows = split.join(live, "key").select(split.columns)
    n = parts(spark)
    for part in cold:
        once = part.groupBy("key", "ctx").agg(F.count("*").alias("m"))
        hits = (once.repartition(n, "key").sortWithinPartitions("key").select("key", "ctx", "m")
                .mapInArrow(_index_run(length, limit), "key long, ctx_key string, first int, last int"))
        marks.append(part.select("u", "lo", "key", F.md5("ctx").alias("ctx_key")).join(hits, ["key", "ctx_key"])
                     .select("u", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last")))
    out = marks[0]
    for m in marks[1:]:
        out = out.union(m)
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, core: int = CORE, most: int = 256, id_col: str = "doc_id", text_col: str = "text",
                 with_spans: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats[, spans]) of every row."""
    rows = keyed(docs, id_col, text_col)
    texts = distinct_texts(rows, length)
    marks = repeats(texts, length, core, most).groupBy("u").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    result = cut(texts.join(marks, "u").select("h", "m", _kept_udf(length)("t", "marks").alias("k")).select("h", "m", "k.*"))
    copies = rows.groupBy("h", "m").agg(F.count("*").alias("c")).where("c > 1").select("h", "m", F.lit(True).alias("copied"))
    known = rows.select("id", "h", "m", F.length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    out = known.join(result, ["h", "m"], "left").join(copies, ["h", "m"], "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)  # all bytes of a text with copies are repeats
    n_removed = F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    cols: list[Column] = [F.col("id").alias(id_col), F.col("n_bytes"), n_removed.alias("n_removed"),
                          F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                          F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                          (n_removed > 0).alias("has_repeats")]
    spans = F.when(gone, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", F.array()))
    return out.select(*cols, *([spans.alias("spans")] if with_spans else []))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates through shards of BK-trees (operator 1).

A text's fingerprint takes the majority of every bit over the XXH64 hashes of its word
shingles.  Fingerprints within a Hamming radius are linked; equal fingerprints are one node.

*Shards.*  With ``radius + 2`` blocks of bits, two fingerprints within the radius agree on at
least two whole blocks, so each fingerprint goes to one shard for every pair of blocks and no
link is lost; from about a billion fingerprints on, more blocks keep the shards small
(``blocks_for``).  *Trees.*  Each shard holds BK-trees of a bounded number of fingerprints, whose
children are keyed by their integer Hamming distance to the parent; a search follows only the
edges within the radius.  A tree is sent to the task that holds its shard's queries by the
shuffle on the shard's key; trees of all shards together grow with the data, so they are not
broadcast as a whole.

*Hot shards.*  A shard with more fingerprints than a tree may hold is dealt to several trees
by hash.  After the first components are known, it is dealt anew by component: blocks that
lie wholly in one component need no search against each other, all other pairs of blocks are
searched.  That keeps every connection, and a group of near copies that holds a third of all
rows costs no more than its share.

Defined results: a null text counts as empty, a text without words has fingerprint zero and
is linked like any other, rows with a null id get their fingerprint and the component of the
other rows (null if none of them has an id), repeated rows are repeated in the result, an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash
from ._bytes import LOWER, mix
from ._frame import Framed, narrow, table
from ._graph import connected_components
from ._scratch import clear, cut, gathered, parts, release, small_batches, stored
from ._texts import distinct_texts
from ._texts import keyed as hashed

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; fewer words: of all of them."""
    w = (text or b"").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    norm, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(norm, SEED)], np.uint64)
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)))
    starts, ends = edge[: len(w) - words + 1].tolist(), (edge[words:] - 1).tolist()
    return np.array([h(norm[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: list[np.ndarray], n_words: int = 1) -> np.ndarray:
    """(texts, n_words) fingerprints; word 0 is of the hashes, later ones of their further mixes."""
    n = np.array([len(x) for x in hashes], np.int64)
    all_h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.repeat(np.arange(len(hashes)), n) * 256
    out = np.zeros((len(hashes), n_words), np.uint64)
    for s in range(n_words):
        x = (all_h if s == 0 else mix(all_h + np.uint64(s * 0x9E3779B97F4A7C15 % 2**64))).view(np.uint8).reshape(-1, 8)
        ones = np.stack([np.bincount(at + x[:, j], minlength=256 * len(hashes)).reshape(-1, 256) @ _BITS for j in range(8)], axis=1)
        out[:, s] = np.packbits(ones * 2 > n[:, None, None], axis=2, bitorder="little").reshape(len(hashes), 8).view("<u8")[:, 0]
    return out


def fingerprint_udf(words: int, n_words: int = 1):
    """binary text -> array of n_words fingerprints (long)."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def fingerprints(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        rows = texts.to_pylist()
        for i, t in enumerate(rows):
            held.append(shingle_hashes(t, words))
            size += len(held[-1])
            if size > 100_000 or len(held) >= 256 or i == len(rows) - 1:
                out.append(majority(held, n_words))
                held, size = [], 0
        flat = np.concatenate(out).ravel().view(np.int64) if out else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n_words), pa.array(flat))

    return fingerprints


class BKTree:
    """Fingerprints; a node's children are keyed by their Hamming distance to it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = [int(k) for k in keys]
        self.children: list[dict[int, int]] = [{} for _ in self.keys]
        for i in range(1, len(self.keys)):
            at = 0
            while (nxt := self.children[at].setdefault((self.keys[at] ^ self.keys[i]).bit_count(), i)) != i:
                at = nxt

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of all matches; only edges within the radius are followed."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(0, np.arange(len(queries)))] if self.keys else []
        while stack:
            node, who = stack.pop()
            d = np.bitwise_count(queries[who] ^ np.uint64(self.keys[node])).astype(np.int64)
            if (hit := d <= radius).any():
                found.append((who[hit], np.full(int(hit.sum()), node), d[hit]))
            for edge, child in self.children[node].items():
                if len(go := who[np.abs(d - edge) <= radius]):
                    stack.append((child, go))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that connect what (a, b) connects: the least forest by distance (Boruvka)."""
    label, kept = np.arange(n), []
    order = np.argsort(d, kind="stable")
    a, b = a[order], b[order]
    while True:
        la, lb = label[a], label[b]
        open_ = np.flatnonzero(la != lb)
        if not len(open_):
            return order[np.unique(np.concatenate(kept))] if kept else np.zeros(0, np.int64)
        best = np.full(n, len(a))
        np.minimum.at(best, la[open_], open_)
        np.minimum.at(best, lb[open_], open_)
        take = np.unique(best[best < len(a)])
        kept.append(take)
        while True:
            low = np.minimum(label[a[take]], label[b[take]])
            new = label.copy()
            np.minimum.at(new, label[a[take]], low)
            np.minimum.at(new, label[b[take]], low)
            new = new[label]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new


def _links(group: np.ndarray, fps: np.ndarray, radius: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A BK-tree for each run of equal group, and a spanning forest of the links that it gives.

    With labels, only links between different ones count, and the forest is one of labels.
    """
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for k in np.flatnonzero(np.diff(edge) > 1):
        own, first = np.unique(fps[edge[k] : edge[k + 1]], return_index=True)
        if label is None:
            node, n = np.arange(len(own)), len(own)
        else:
            names, node = np.unique(label[edge[k] + first], return_inverse=True)
            n = len(names)
        if n < 2:
            continue
        a, b, d = BKTree(own).within(own, radius)
        a, b, d = (x[(a < b) & (node[a] != node[b])] for x in (a, b, d))
        if len(a) > 1:
            keep = spanning(node[a], node[b], d, n)
            a, b = a[keep], b[keep]
        if len(a):
            yield own[a], own[b]


def _search(radius: int):
    """Arrow batches of (g, f[, label]) sorted by g -> links (u, v) of fingerprints of equal g."""
    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = list(_links(cols[0], cols[1].view(np.uint64), radius, *cols[2:]))
        if found:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            if held[0][0][0] == held[-1][0][-1]:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1  # the last run may go on
            yield from solve([x[:last] for x in cols])
            held = [[x[last:] for x in cols]]
        if held:
            yield from solve([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _searched(rows: DataFrame, group: Column, radius: int, *also: str) -> DataFrame:
    """Links of fingerprints f that share a tree; group: the tree's number; also: the label."""
    n = parts(rows.sparkSession)
    return (rows.select(group.alias("g"), "f", *also).repartition(n, "g").sortWithinPartitions("g")
            .mapInArrow(_search(radius), "u long, v long"))


def linked(keyed: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """Links (u, v) between the fingerprints f of equal shard; see the module's text.

    They connect whatever the links within the radius connect, and each of them is such a link.
    """
    keyed = stored(keyed, "shards")  # Parquet, as rows of a checkpoint lose columns in later joins with themselves
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, "shard")
    trees = F.ceil(F.col("n") / tree_size)
    first = cut(_searched(rows, F.xxhash64("shard", F.pmod(F.xxhash64("f"), trees)), radius).distinct())
    hot = sizes.where(F.col("n") > tree_size)
    if hot.isEmpty():
        return first
    hot_rows = keyed.join(hot.select("shard"), "shard")
    labels = connected_components(first).select(F.col("node").alias("f"), "label")
    own = stored(hot_rows.join(labels, "f", "left").select("shard", "f", F.coalesce("label", "f").alias("label")), "own")
    of_label = own.groupBy("shard", "label").agg(F.count("*").alias("m"))
    mixed = of_label.where(F.col("m") <= tree_size // 2).groupBy("shard").agg(F.sum("m").alias("mixed"))
    pure = F.col("m") > tree_size // 2
    dealt = stored(own.join(of_label, ["shard", "label"]).join(mixed, "shard", "left").select(
        "shard", "f", F.when(pure, F.col("label")).alias("pure"),
        F.when(pure, F.xxhash64("label", F.pmod(F.xxhash64("f"), F.ceil(F.col("m") / tree_size))))
        .otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("mixed") / tree_size))).alias("block")), "dealt")
    blocks = dealt.groupBy("shard", "block").agg(F.first("pure").alias("pure"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = stored(a.join(b, F.expr("a.shard = b.shard and a.block <= b.block and not (a.pure <=> b.pure and a.pure is not null)"))
                .select(F.col("a.shard").alias("shard"), F.col("a.block").alias("block"), F.col("b.block").alias("other")), "pairs")
    way = pairs.union(pairs.where("block <> other").select("shard", F.col("other").alias("block"), F.col("block").alias("other")))
    again = dealt.join(way, ["shard", "block"])
    second = _searched(again, F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other")), radius)
    return cut(first.union(second).distinct())


def block_shards(f: Column, radius: int, blocks: int) -> Column:
    """One shard for every choice of ``blocks - radius`` blocks of a fingerprint's 64 bits."""
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    at = [sum(width[:i]) for i in range(blocks)]
    part = [F.shiftrightunsigned(f, at[i]).bitwiseAND(F.lit((1 << width[i]) - 1)) for i in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def blocks_for(n: int, radius: int, tree_size: int) -> int:
    """So many blocks that ``n`` evenly spread fingerprints leave a shard no fuller than a tree."""
    blocks = radius + 2
    while blocks < radius + 4 and n > tree_size << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tree_size: int = 512,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, n_copies) of every row: the fingerprint as 16 hexadecimal
    digits, the smallest id reachable by links of at most ``radius`` bits, and the number of
    rows with this fingerprint."""
    rows = narrow(docs, id_col, text_col)
    fps = cut(rows.select(F.col(id_col).alias("id"), fingerprint_udf(words)(F.col(text_col).cast("binary"))[0].alias("f")))
    nodes = cut(fps.groupBy("f").agg(F.min("id").alias("least"), F.count("*").alias("n_copies")))
    blocks = blocks_for(nodes.count(), radius, tree_size)
    keyed = nodes.select(F.explode(block_shards(F.col("f"), radius, blocks)).alias("shard"), "f")
    labels = connected_components(linked(keyed, radius, tree_size)).select(F.col("node").alias("f"), "label")
    known = nodes.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    by = known.join(least, "label").select("f", "component_id", "n_copies")
    return fps.join(by, "f").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def near_reference(docs: DataFrame, reference: DataFrame, words: int = 4, radius: int = 4, most: int = 50_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, reference, distance): texts of docs within the radius of a fingerprint of a small table.

    Here the shards' trees are broadcast: the reference has at most ``most`` distinct fingerprints,
    or it is refused.  Null and empty texts have fingerprint zero on both sides.
    """
    one = fingerprint_udf(words)
    refs = narrow(reference, text_col).select(one(F.col(text_col).cast("binary"))[0].alias("f")).distinct()
    found = refs.limit(most + 1).select("f", block_shards(F.col("f"), radius, radius + 2).alias("s")).collect()
    if len(found) > most:
        raise ValueError(f"trees are broadcast for at most {most} fingerprints")
    by: dict[int, list[int]] = {}
    for r in found:
        for shard in r.s:
            by.setdefault(shard, []).append(r.f % 2**64)
    trees = docs.sparkSession.sparkContext.broadcast({k: BKTree(np.array(v, np.uint64)) for k, v in by.items()})
    kind = T.ArrayType(T.StructType([T.StructField("f", T.LongType()), T.StructField("d", T.IntegerType())]))

    @F.arrow_udf(kind)
    def search(f: pa.Array, shards: pa.Array) -> pa.Array:
        out = []
        for q, own in zip(f.to_pylist(), shards.to_pylist(), strict=True):
            hit = {}
            for s in own:
                if (tree := trees.value.get(s)) is not None:
                    _, node, d = tree.within(np.array([q], np.int64).view(np.uint64), radius)
                    hit |= {tree.keys[i]: int(x) for i, x in zip(node.tolist(), d.tolist(), strict=True)}
            out.append([{"f": k - 2**64 if k >= 2**63 else k, "d": d} for k, d in sorted(hit.items())])
        return pa.array(out, pa.list_(pa.struct([("f", pa.int64()), ("d", pa.int32())])))

    rows = narrow(docs, id_col, text_col).select(F.col(id_col), one(F.col(text_col).cast("binary"))[0].alias("_f"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return (rows.select(id_col, "_f", F.explode(search("_f", block_shards(F.col("_f"), radius, radius + 2))).alias("m"))
            .select(id_col, text(F.col("_f")).alias("fingerprint"), text(F.col("m.f")).alias("reference"), F.col("m.d").alias("distance")))


# --- documents of 0.8 similarity or more -------------------------------------------------

#: Bands, rows and places of the signatures that complete the trees' search.
_ROWS = (64, 6, 389)


def _shingle_set_udf(words: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def shingle_set(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))

    return shingle_set


SIGNATURE = T.StructType([T.StructField("key", T.StringType()), T.StructField("fp", T.ArrayType(T.LongType()))])


def _signature_udf(words: int, n_words: int):
    """binary text -> (key of its words, fingerprint words)."""

    @F.arrow_udf(SIGNATURE)
    def signature(texts: pa.Array) -> pa.Array:
        keys, fps, held, size = [], [], [], 0
        for i, t in enumerate(texts):
            t = t.as_py() or b""
            keys.append(xxhash.xxh3_128_hexdigest(b" ".join(t.translate(LOWER).split())))
            held.append(np.unique(shingle_hashes(t, words)))
            size += len(held[-1])
            if size > 100_000 or len(held) >= 256 or i == len(texts) - 1:
                fps.append(majority(held, n_words))
                held, size = [], 0
        fp = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n_words), pa.array(np.concatenate(fps).ravel().view(np.int64) if fps else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(keys, pa.string()), fp], SIGNATURE.names)

    return signature


def _similar(texts: DataFrame, todo: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the links (a, b) of texts whose whole shingle sets are similar, as (u, v)."""
    involved = todo.select(F.col("a").alias("u")).union(todo.select("b")).distinct()
    sets = stored(texts.join(involved, "u").select("u", _shingle_set_udf(words)("t").alias("set")), "sets")
    both = (todo.join(sets.select(F.col("u").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("u").alias("b"), F.col("set").alias("sb")), "b")
            .withColumn("common", F.size(F.array_intersect("sa", "sb"))))
    good = both.where(F.col("common") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("common")))
    return cut(good.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _labelled(sig: DataFrame, labels: DataFrame | None) -> DataFrame:
    """sig with the component of each text; without labels each is its own."""
    if labels is None:
        return sig.withColumn("label", F.col("u"))
    return sig.join(labels.select(F.col("node").alias("u"), "label"), "u", "left").withColumn("label", F.coalesce("label", "u"))


def _tree_links(sig: DataFrame, labels: DataFrame | None, bands: range, band_bits: int, radius: int, tree_size: int) -> DataFrame:
    """Links (a, b) of texts of different label that share a band and whose fingerprints lie within the radius.

    A shard that is too full is dealt to several trees by hash, and the shard's least fingerprint
    is in each of them; what these trees don't connect is left to the exact search.
    """
    def band(i: int) -> Column:
        lo, off = divmod(i * band_bits, 64)
        x = F.shiftrightunsigned(F.col("r.fp")[1 + lo], off)
        if off + band_bits > 64:
            x = x.bitwiseOR(F.shiftleft(F.col("r.fp")[2 + lo], 64 - off))
        return F.xxhash64(F.lit(i), x.bitwiseAND(F.lit((1 << band_bits) - 1)))

    named = _labelled(sig, labels).select("u", "label", "fp", F.col("fp")[0].alias("f"))
    # texts of one fingerprint are one node, that of the least of them; the others are linked to it
    node = stored(named.groupBy("f").agg(F.min(F.struct("u", "label", "fp")).alias("r"), F.count("*").alias("n")), "nodes")
    keyed = node.select(F.explode(F.array(*[band(i) for i in bands])).alias("shard"), "f", F.col("r.label").alias("label"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min(F.struct("f", "label")).alias("least")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_size)
    rows = keyed.join(sizes.select("shard", "n"), "shard").select(F.xxhash64("shard", F.pmod(F.xxhash64("f"), trees)).alias("g"), "f", "label")
    led = sizes.where(F.col("n") > tree_size).select("shard", "least", F.explode(F.sequence(F.lit(0).cast("long"), trees - 1)).alias("tree"))
    rows = rows.union(led.select(F.xxhash64("shard", "tree"), "least.f", "least.label"))
    pairs = _searched(rows, F.col("g"), radius, "label").distinct()
    of = node.select("f", F.col("r.u").alias("text"))
    across = (pairs.join(of.select(F.col("f").alias("u"), F.col("text").alias("a")), "u")
              .join(of.select(F.col("f").alias("v"), F.col("text").alias("b")), "v").select("a", "b"))
    if labels is not None:
        return cut(across)
    same = named.select("f", F.col("u").alias("a")).join(node.where("n > 1").select("f", F.col("r.u").alias("b")), "f").where("a <> b")
    return cut(across.union(same.select("a", "b")))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 14, bands: int = 32,
                   band_bits: int = 24, tree_size: int = 512, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, m, group) of every text; h and m: its 64-bit hash and md5.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; texts with the same words are one node.  First candidates come from the trees:
    texts that share one of ``bands`` bands of ``band_bits`` further SimHash bits are in one
    shard, and its BK-trees give a forest of those whose fingerprints differ in at most ``radius``
    bits.  A few bands come first; the others look only for links between the components that
    these left.  Every candidate link is checked on the whole shingle sets, and only checked
    links make components.

    The trees miss some pairs (one at exactly 0.8 shares a band with a chance of about two in five).
    So texts of different components that share a band of SuperMinHash rows are compared on whole sets in
    the band's task (see ``minhash.crossing``), which misses a pair at 0.8 with a chance of 4e-9
    and returns a forest, not the pairs of a group.
    """
    with small_batches(docs.sparkSession):
        return _similar_groups(docs, words, similarity, radius, bands, band_bits, tree_size, most, id_col, text_col)


def _similar_groups(docs: DataFrame, words: int, similarity: float, radius: int, bands: int, band_bits: int, tree_size: int, most: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = distinct_texts(hashed(docs, id_col, text_col), 0)
    release(spark)
    n_words = 1 + -(-bands * band_bits // 64)
    seen = stored(texts.select("u", "h", "m", _signature_udf(words, n_words)("t").alias("s"), minhash.signature_udf(words, *_ROWS)("t").alias("x")), "signatures")
    one = seen.groupBy("s.key").agg(F.min("u").alias("node"))
    sig = seen.select("u", "s.fp", "x.n", "x.bands").join(one.select(F.col("node").alias("u")), "u", "left_semi")
    sig = stored(sig, "nodes")
    good, labels = None, None
    few = min(bands, 4)
    for some in (range(few), range(few, bands)):
        if len(some):
            found = _similar(texts, _tree_links(sig, labels, some, band_bits, radius, tree_size), words, similarity)
            good = found if good is None else good.union(found)
            labels = connected_components(good)
            release(spark)
    met = stored(minhash.buckets(sig.where("n > 0")), "met")
    labels = connected_components(good.union(minhash.crossing(texts, met, labels, words, similarity, *_ROWS, most)))
    release(spark)
    of = seen.select("h", "m", "s.key").join(one, "key")
    return of.join(labels, "node", "left").select("h", "m", F.coalesce("label", "node").alias("group"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, one of each group of near copies: that with the
    smallest id (rows without an id come last, then by md5 of the text; of repeated rows one)."""
    f = Framed(docs, id_col, text_col)
    ident, text = f.columns
    with gathered() as own:
        groups = similar_groups(docs, words, similarity, id_col=id_col, text_col=text_col)
    groups = stored(groups, "groups")
    clear(docs.sparkSession, own)  # texts, signatures and sets: nothing reads them any more
    release(docs.sparkSession)
    rank = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col("_m").alias("m"))
    key = F.concat_ws(":", F.coalesce(F.col(ident).cast("string"), F.lit("-")), F.col("_m"))
    t = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = f.df.select(ident, F.xxhash64(t).alias("_h"), F.md5(t).alias("_m"))
    first = (slim.join(groups, (slim["_h"] == groups["h"]) & (slim["_m"] == groups["m"])).groupBy("group").agg(F.min(rank).alias("w"))
             .select(F.concat_ws(":", F.coalesce(F.col("w.id").cast("string"), F.lit("-")), F.col("w.m")).alias("_key")))
    return f.keep(lambda d: d.withColumn("_m", F.md5(t)).withColumn("_key", key).join(first, "_key", "left_semi").dropDuplicates(["_key"]))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

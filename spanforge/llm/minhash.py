"""Near-duplicates by SuperMinHash signatures (operator 12).

*Signature.*  Every shingle of a text ranks all ``size`` places of the signature by a permutation
of its own, and adds to each rank a fraction drawn anew; a place keeps the least sum over the
shingles.  A shingle's ranks are all different, so places are correlated, and estimates vary
less than with independent hashes.  The permutation is ``(a + b * j) mod size`` for a prime size
and a, b from the shingle's hash: each place and each pair of places has every rank, and every pair
of ranks, alike, which is all that the mean and the variance depend on.  Ranks are worked
through from 0 on for all shingles of many texts at once; a text stops at the rank at which its
last place is filled, for no later rank can be less than what is there.

*Banding.*  Texts whose signatures agree in all rows of a band are candidates.  With 64 bands of
6 rows a pair of similarity 0.8 is missed with a chance of 4e-9.  *Verification.*  No bucket is turned
into pairs.  First every text is compared with one other: of the fullest texts of its buckets (the fullness of a text
is the sum of its buckets' sizes) the fullest, which is the text that a group was made from, if there is
one.  Links are confirmed on whole shingle sets.  What they connect needs no more comparing; in a
second step only texts of different components meet, in their bucket's task: in the first bucket that
they share, and if sketches of two bits a place leave the similarity possible (6.5 deviations), on
whole sets.  Sketches go to the buckets first, and whole sets only where they leave such a pair.  The likeliest come first, and a task goes on with what it has joined as one component, so it returns a
forest and not the pairs of a group.  *Grouping.*  Union-find in each task, and joins of the
forests to components.

*Skew.*  Texts with the same bytes, and texts with the same set, are one node.  A bucket holds a
node once, and a large group's rows go to as many buckets as there are bands.  Centres are
sent along once for every 256 of their pairs; large buckets of the second step are dealt to blocks, and
only texts outside the bucket's largest component visit other blocks.  A large group whose texts
are all just below the similarity to each other costs the square of its size in comparisons in
its tasks, but no rows.

Defined results: a null text or one without words has an empty set and is linked with
nothing; rows with a null id get the component of the rows they are linked with (null if none of
them has an id); repeated rows are repeated in the result; an empty table gives an empty
one; further columns are ignored.  Sets are of 64-bit hashes of the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._bytes import WHITE, chunks, lowered, mix, span_hash, words
from ._frame import table
from ._graph import connected_components
from ._scratch import cut, parts, release, stored
from ._skew import lookup
from ._texts import distinct_texts, keyed

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, hashes, edges) by runs of texts: the sorted distinct shingles of each text, one after the other."""
    for first, last, data, offsets in chunks(texts, 1 << 21):
        low = lowered(data)
        s, e = words(low, WHITE)
        one = span_hash(low, s, e)
        edge = np.searchsorted(s, offsets)
        doc = np.repeat(np.arange(last - first), np.diff(edge))
        h = one
        for n in range(1, size):  # runs of n + 1 words; what goes beyond the text ends with it
            nxt = np.zeros(len(one), np.uint64)
            nxt[: len(one) - n] = one[n:]
            inside = np.zeros(len(one), bool)
            inside[: len(one) - n] = doc[n:] == doc[: len(one) - n]
            h = np.where(inside, mix(h * _ODD + nxt), h)
        start = np.zeros(len(one), bool)
        start[edge[:-1][np.diff(edge) > 0]] = True
        full = np.zeros(len(one), bool)
        if size <= len(one):
            full[: len(one) - size + 1] = doc[size - 1 :] == doc[: len(one) - size + 1]
        take = full | (start & (np.repeat(np.diff(edge), np.diff(edge)) < size))
        h, doc = h[take], doc[take]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield last - first, h, np.searchsorted(doc, np.arange(last - first + 1))


def signatures(h: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """(sets, size) SuperMinHash values of sets of hashes; size: a prime.  Rows of empty sets are all ones."""
    n = len(edges) - 1
    out = np.full((n, size), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(edges))
    at = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)
    by = 1 + (mix(h ^ np.uint64(0x14057B7EF767814F)) % np.uint64(size - 1)).astype(np.int64)
    for j in range(size):
        place = doc * size + at
        open_ = flat[place] == _EMPTY
        value = (mix(h[open_] + np.uint64(((j + 1) * int(_ODD)) % 2**64)) >> np.uint64(12)) | np.uint64(j << 52)
        np.minimum.at(flat, place[open_], value)
        at += by
        at[at >= size] -= size
        if j < 16 or j % 8 == 0:
            going = (out == _EMPTY).any(axis=1)
            if not going[doc].all():
                keep = going[doc]
                h, doc, at, by = h[keep], doc[keep], at[keep], by[keep]
            if not len(h):
                break
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places of two signatures."""
    return float(np.mean(a == b))


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each place, 32 places in a 64-bit word."""
    n, size = sig.shape
    two = np.zeros((n, -(-size // 32) * 32), np.uint64)
    two[:, :size] = sig & np.uint64(3)
    return np.bitwise_or.reduce(two.reshape(n, -1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places of sketches a and each of b differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1)


def most_differing(similarity: float, size: int) -> int:
    """As many places of the sketches of similar sets differ but with a chance of about 1e-10."""
    same = similarity + (1 - similarity) / 4
    return int(np.ceil(size * (1 - same) + 6.5 * np.sqrt(size * same * (1 - same))))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) hashes of the bands of signatures."""
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, part.shape[:2])
    for i in range(rows):
        key = mix(key * _ODD + part[:, :, i])
    return key


SIGNATURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def signature_udf(words_: int, bands: int, rows: int, size: int):
    """binary text -> (size of its set, two hashes of the set, hashes of the bands)."""
    sums = lambda x, edges: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[edges])

    @F.arrow_udf(SIGNATURE)
    def signature(texts: pa.Array) -> pa.Array:
        n, a, b, keys = ([np.zeros(0, np.int64)] for _ in range(4))
        for _, h, edges in shingle_sets(texts.to_pylist(), words_):
            n.append(np.diff(edges))
            a.append(sums(mix(h), edges).view(np.int64))
            b.append(sums(mix(h ^ _ODD), edges).view(np.int64))
            keys.append(band_keys(signatures(h, edges, size), bands, rows).reshape(-1).view(np.int64))
        of = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(np.concatenate(keys)))
        return pa.StructArray.from_arrays([*(pa.array(np.concatenate(x)) for x in (n, a, b)), of], SIGNATURE.names)

    return signature


WHOLE = T.StructType([T.StructField("head", T.BinaryType()), T.StructField("set", T.BinaryType())])


def whole_udf(words_: int, bands: int, rows: int, size: int):
    """binary text -> (its sketch and 32 bits of each band's hash, its whole set), as 64-bit words."""

    @F.arrow_udf(WHOLE)
    def whole(texts: pa.Array) -> pa.Array:
        heads, sets = [], []
        for count, h, edges in shingle_sets(texts.to_pylist(), words_):
            sig = signatures(h, edges, size)
            sketch, keys = sketches(sig), band_keys(sig, bands, rows).astype(np.uint32)
            heads += [sketch[i].tobytes() + keys[i].tobytes() for i in range(count)]
            sets += [h[edges[i] : edges[i + 1]].tobytes() for i in range(count)]
        return pa.StructArray.from_arrays([pa.array(heads, pa.binary()), pa.array(sets, pa.binary())], WHOLE.names)

    return whole


# --- confirming -------------------------------------------------------------------------

def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity (whole percents)."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= round(100 * similarity) * (len(a) + len(b) - common)


def _confirming(words_: int, similarity: float):
    """Arrow batches (g, role, id, t) sorted by g and role -> links (u, v) of each group's centre (role 0) and its members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre, ident = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            gs, roles, ids = (batch.column(i).to_numpy() for i in range(3))
            at, us, vs = 0, [], []
            for n, h, edges in shingle_sets(batch.column(3).to_pylist(), words_):
                for k in range(n):
                    own = h[edges[k] : edges[k + 1]]
                    if roles[at + k] == 0:
                        group, centre, ident = gs[at + k], own, ids[at + k]
                    elif gs[at + k] == group and similar(own, centre, similarity):
                        us.append(ident)
                        vs.append(ids[at + k])
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, words_: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (c, u) whose whole sets are similar, as (u, v).

    A text u goes with each of its pairs; a centre c once for every 256 of its own.
    """
    pairs = stored(pairs, "pairs")
    of = pairs.groupBy("c").agg(F.ceil(F.count("*") / 256).alias("k"))
    dealt = lookup_chunks(pairs, of)
    members = dealt.join(texts.select("u", "t"), "u").select("g", F.lit(1).alias("role"), F.col("u").alias("id"), "t")
    centres = of.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("chunk")).select(F.xxhash64("c", "chunk").alias("g"), F.col("c").alias("u"))
    centres = centres.join(texts.select("u", "t"), "u").select("g", F.lit(0).alias("role"), F.col("u").alias("id"), "t")
    both = members.union(centres).repartition(parts(texts.sparkSession), "g").sortWithinPartitions("g", "role")
    return both.mapInArrow(_confirming(words_, similarity), "u long, v long")


def lookup_chunks(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """(g, u) of the pairs (c, u): g is the chunk of c's pairs that u falls into."""
    met = lookup(pairs, of.withColumn("n", F.col("k") * 256), ["c"])
    return met.select(F.xxhash64("c", F.pmod(F.xxhash64("u"), F.col("k"))).alias("g"), "u")


class Joined:
    """Union-find over numbers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            up = self.parent.get(p, p)
            self.parent[x] = up
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect what links connect: each task drops those within what it has joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Joined()
        for batch in batches:
            new = [(u, v) for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) if known.join(u, v)]
            yield _pairs(new)

    return links.mapInArrow(run, "u long, v long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


# --- buckets ----------------------------------------------------------------------------

def buckets(nodes: DataFrame) -> DataFrame:
    """(k, band, u, n, c): the buckets k of nodes (u, n, bands) that have two nodes or more, and their sizes c."""
    b = nodes.select(F.posexplode("bands").alias("band", "k"), "u", "n")
    return b.withColumn("c", F.count("*").over(Window.partitionBy("k"))).where("c > 1")


def _stars(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, pairs): the nodes' buckets, and each node with the fullest of its buckets' fullest nodes."""
    met = stored(buckets(nodes).withColumn("w", F.sum("c").over(Window.partitionBy("u"))), "met")
    centre = met.groupBy("k").agg(F.max(F.struct("w", "u")).alias("m"))
    best = met.select("k", "u").join(centre, "k").groupBy("u").agg(F.max("m").alias("m"))
    return met, best.select(F.col("m.u").alias("c"), "u").where("c <> u")


def _possible(similarity: float, worst: int, words_of_sketch: int, label, n, band, guest, heads) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others behind it, places of the sketches that differ): the pairs of a bucket's texts, sorted by n, that may be similar and meet first here."""
    sketch, keys = heads[:, :words_of_sketch], heads[:, words_of_sketch:].view(np.uint32)[:, : band[0]]
    last = np.searchsorted(n, n / similarity + 1e-9, "right")
    for i in range(len(n) - 1):
        to = np.arange(i + 1, last[i])
        to = to[(label[to] != label[i]) & ~(guest[to] & guest[i])]
        far = differing(sketch[i], sketch[to])
        to, far = to[far <= worst], far[far <= worst]
        to, far = (x[~(keys[to] == keys[i]).any(axis=1)] for x in (to, far))  # pairs that met in an earlier band
        if len(to):
            yield i, to, far


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[bytes], list[tuple[int, int]]]]:
    """(columns, data, groups) of Arrow batches (g, ..., data) sorted by g: groups of equal g, each whole, that have several labels (column 2)."""
    held: list[tuple[list[np.ndarray], list[bytes]]] = []

    def made() -> tuple[list[np.ndarray], list[bytes], list[tuple[int, int]]]:
        cols, data = [np.concatenate(x) for x in zip(*(c for c, _ in held), strict=True)], sum((d for _, d in held), [])
        edge = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1], [True]))).tolist()
        return cols, data, [(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if not (cols[2][a:b] == cols[2][a]).all()]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols, data = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], batch.column(batch.num_columns - 1).to_pylist()
        other = np.flatnonzero(cols[0] != cols[0][-1])
        last = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
        if last or (held and held[-1][0][0][-1] != cols[0][0]):
            held.append(([c[:last] for c in cols], data[:last]))
            yield made()
            held = []
        held.append(([c[last:] for c in cols], data[last:]))
    if held:
        yield made()


def _screened(similarity: float, worst: int, words_of_sketch: int):
    """Arrow batches (g, id, label, n, band, guest, head) sorted by g -> the rows, without heads, that have a possible pair in their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, data, groups in _whole_groups(batches):
            keep = np.zeros(len(data), bool)
            for a, b in groups:
                order = a + np.argsort(cols[3][a:b], kind="stable")
                heads = np.stack([np.frombuffer(data[i], np.uint64) for i in order.tolist()])
                for i, to, _ in _possible(similarity, worst, words_of_sketch, *(c[order] for c in cols[2:]), heads):
                    keep[order[i]] = True
                    keep[order[to]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["g", "id", "label", "n", "band", "guest"])

    return run


def _across(similarity: float, worst: int, words_of_sketch: int, bands: int):
    """Arrow batches (g, id, label, n, band, guest, data) sorted by g -> links (u, v) of equal g and different label, a forest of labels in each task."""
    head = words_of_sketch + bands // 2

    def solve(known: Joined, ids, label, n, band, guest, data) -> Iterator[tuple[int, int]]:
        order = np.argsort(n, kind="stable")
        ids, label, n, band, guest = (x[order] for x in (ids, label, n, band, guest))
        data = [np.frombuffer(data[i], np.uint64) for i in order.tolist()]
        for i, to, far in _possible(similarity, worst, words_of_sketch, label, n, band, guest, np.stack([x[:head] for x in data])):
            own = int(label[i])
            for j in to[np.argsort(far, kind="stable")].tolist():
                if known.root(own) != known.root(int(label[j])) and similar(data[i][head:], data[j][head:], similarity):
                    known.join(own, int(label[j]))
                    yield int(ids[i]), int(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Joined()
        for cols, data, groups in _whole_groups(batches):
            yield _pairs([link for a, b in groups for link in solve(known, *(c[a:b] for c in cols[1:]), data[a:b])])

    return run


def crossing(texts: DataFrame, met: DataFrame, labels: DataFrame, words_: int, similarity: float, bands: int, rows: int, size: int, most: int) -> DataFrame:
    """Links (u, v) that join the components of the similar texts that share a bucket and are in different ones."""
    own = met.select("k", "band", "u", "n").join(labels.select(F.col("node").alias("u"), "label"), "u", "left").withColumn("label", F.coalesce("label", "u"))
    own = stored(own, "named")
    by = own.groupBy("k", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    by = by.groupBy("k").agg(F.count("*").alias("labels"), F.sum("c").alias("m"), F.sum("n").alias("s"), F.max(F.struct("c", "label")).alias("top"))
    blocks = F.ceil(F.greatest(F.col("m") / most, F.col("s") / (most * 512)))
    open_ = own.join(by.where("labels > 1").select("k", blocks.alias("blocks"), F.col("top.label").alias("top")), "k")
    open_ = stored(open_, "open").withColumn("home", F.pmod(F.xxhash64("u"), F.col("blocks")))
    homes = open_.select(F.xxhash64("k", "home").alias("g"), "u", "label", "n", "band", F.lit(False).alias("guest"))
    tours = (open_.where("blocks > 1 and label <> top").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .where("at <> home").select(F.xxhash64("k", "at").alias("g"), "u", "label", "n", "band", F.lit(True).alias("guest")))
    data = texts.join(open_.select("u").distinct(), "u").select(F.col("u").alias("id"), whole_udf(words_, bands, rows, size)("t").alias("w"))
    data = stored(data.select("id", "w.*"), "wholes")
    release(texts.sparkSession)
    limits = similarity, most_differing(similarity, size), -(-size // 32)

    def dealt(met: DataFrame) -> DataFrame:
        return met.repartition(parts(texts.sparkSession), "g").sortWithinPartitions("g")

    # most texts of a bucket are ruled out by their sketches, and only the others' sets go there
    each = homes.union(tours).withColumnRenamed("u", "id").join(data.select("id", "head"), "id").select("g", "id", "label", "n", "band", "guest", "head")
    left = stored(dealt(each).mapInArrow(_screened(*limits), "g long, id long, label long, n long, band int, guest boolean"), "left")
    release(texts.sparkSession)
    whole = left.join(data, "id").select("g", "id", "label", "n", "band", "guest", F.concat("head", "set").alias("data"))
    return dealt(whole).mapInArrow(_across(*limits, bands), "u long, v long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after links (u, v) join components: only the labels that are linked go through the rounds again."""
    def name(node: str) -> DataFrame:
        return labels.select(F.col("node").alias(node), F.col("label").alias(f"_{node}"))

    named = links.join(name("u"), "u", "left").join(name("v"), "v", "left")
    both = named.select("u", "v", F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b"))
    both = cut(both)
    up = connected_components(both.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = both.select(F.col("u").alias("node"), F.col("a").alias("was")).union(both.select("v", "b"))
    every = labels.select("node", F.col("label").alias("was")).union(ends).distinct()
    return every.join(up.select(F.col("node").alias("was"), "label"), "was", "left").select("node", F.coalesce("label", "was").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 2, similarity: float = 0.8, bands: int = 64, rows: int = 6, size: int = 389,
                    most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity`` (whole percents); component_id is the smallest id reachable.
    """
    if bands * rows > size or bands % 2:
        raise ValueError("the signature is shorter than its bands, or their number is odd")
    spark = docs.sparkSession
    hashed = keyed(docs, id_col, text_col)
    texts = distinct_texts(hashed, 0)
    release(spark)
    seen = stored(texts.select("u", "h", "m", signature_udf(words, bands, rows, size)("t").alias("s")).select("u", "h", "m", "s.*"), "signatures")
    sets = stored(seen.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("u", "n", "bands")).alias("one"), F.count("*").alias("n_texts")), "sets")
    nodes = sets.select("one.*")
    met, stars = _stars(nodes)
    links = cut(forest(confirmed(texts, stars, words, similarity)))
    labels = connected_components(links)
    release(spark)
    more = crossing(texts, met, labels, words, similarity, bands, rows, size, most)
    labels = _joined(labels, more)
    release(spark)
    # a look-up reads its keys four times, so they are written before: else plans nest, and the driver holds their product
    of_set = sets.select("a", "b", F.col("one.u").alias("node"), F.col("n_texts").alias("n")).join(labels, "node", "left")
    of_set = stored(of_set.select("a", "b", "n", F.coalesce("label", "node").alias("label")), "labelled")
    named = lookup(seen.where("n > 0").select("h", "m", "a", "b", F.col("n").alias("n_shingles")), of_set, ["a", "b"])
    slim = stored(hashed.select("id", "h", "m"), "ids")
    copies = slim.groupBy("h", "m").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    of_text = stored(copies.join(named.drop("n", "a", "b"), ["h", "m"], "left"), "named_texts")
    least = stored(of_text.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    known = stored(lookup(of_text.where("label is not null"), least, ["label"]).select("h", "m", F.col("copies").alias("n"), "n_shingles", "component_id")
                   .union(of_text.where("label is null").select("h", "m", F.col("copies").alias("n"), F.lit(0).cast("long"), F.lit(None).cast("long"))), "classes")
    out = lookup(slim, known, ["h", "m"])
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op12_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
reach(r, o) AS (SELECT r, r FROM w UNION SELECT reach.r, links.v FROM reach JOIN links ON reach.o = links.u),
c AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON reach.o = w.r GROUP BY reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, coalesce(s.doc_id = c.component_id, false) AS kept FROM s JOIN c USING (r)
"""

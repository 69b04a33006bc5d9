"""Operators on small tables with nulls, repeats, clashing columns and hot groups."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import chaining, decontaminate, knn, packing, pii, simhash, substring


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    shared = " ".join(vocabulary[:70])
    out += [f"{chr(97 + i)}{i} {shared} {chr(97 + i) * 3}" for i in range(20)] + [out[3]] * 3 + ["x" * 300, "", "   "]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "h", 1) for i, t in enumerate(texts)] + [(None, None, None, None), (7, texts[7], "h", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, component_id int")


def test_simhash(docs, texts):
    for tree in (512, 4):
        got = simhash.near_duplicates(docs, tree_size=tree).collect()
        fps = [simhash.majority([simhash.shingle_hashes((t or "").encode(), 4)])[0, 0] for t in [*texts, None, texts[7]]]
        ids = [*range(len(texts)), None, 7]
        label = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if int(fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
        least = {x: min(k for k, y in zip(ids, label, strict=True) if y == x and k is not None) for x in set(label)}
        want = Counter((i, f"{int(f):016x}", least[x]) for i, f, x in zip(ids, fps, label, strict=True))
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def _brute_groups(sets, similarity):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}


def _groups(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.m: r.group for r in simhash.similar_groups(df, **options).collect()}
    group = [of[hashlib.md5(t.encode()).hexdigest()] for t in texts]
    return {frozenset(k for k, x in enumerate(group) if x == y) for y in group}


def test_near_copies_are_all_of_that_jaccard_similarity(spark):
    rng, texts = random.Random(3), ["", "a b", "A  b", "a b c"]
    for _ in range(60):
        base = [str(rng.randrange(10**6)) for _ in range(rng.randint(20, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 3)):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 45))):
                own[rng.randrange(len(own))] = str(rng.randrange(10**6))
            texts.append(" ".join(own[rng.randint(0, len(own) // 9) :]))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    want = _brute_groups(sets, 0.8)
    assert _groups(spark, texts) == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {min(g) for g in want}


def _brute_substring(rows, length):
    seen = Counter(t.encode()[i : i + length] for _, t in rows if t for i in range(len(t.encode()) - length + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = True
        starts = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(i, len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    return want


def test_substring(docs, texts):
    want = _brute_substring([*enumerate(texts), (None, None), (7, texts[7])], 60)
    got = substring.deduplicated(docs, length=60, core=20, most=6).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_substring_of_many_near_copies(spark, texts):
    rng = random.Random(9)
    words, rows = texts[41].split(), []
    for i in range(60):
        own = list(words)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = rng.choice("uvwxyz") * rng.randint(1, 3)
        rows.append((i, " ".join(own)))
    rows += [(60, "é" * 90), (61, "ab" * 200), (62, None)]
    got = substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), length=60, core=20, most=4).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _brute_substring(rows, 60)


def test_decontamination(spark, docs, texts):
    bench = spark.createDataFrame([(1, texts[41]), (2, "never seen words"), (None, texts[0]), (3, None), (4, "")], "item_id long, text string")
    for size in (10**6, 20):
        ix = decontaminate.Index(docs, bench, block_words=size)
        got = {r.doc_id: r for r in ix.report().collect()}
        assert got[41].n_hit == got[41].n_words and got[41].contaminated and got[42].n_items == 1
        assert not got[60 + 5].contaminated and got[None].n_words == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None}
    assert ix.near(3).where("item = '1'").count() >= 1


def test_knn(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 450)]
    odd = [(450, None), (None, [1.0] * 8), (451, [1.0, None] * 4), (452, [float("nan")] * 8), (453, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = set()
    for q in range(0, 450, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(450) if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in knn.top_k(df, pivots=8, piece=32, block=4).collect()} == want


def test_packing(docs):
    got = packing.pack(docs).toPandas()
    assert len(got) == docs.count() and got.groupby("sequence_id").length.sum().max() <= 4096
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()


def test_surrogates_keep_columns_and_order_of_rows(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org", "x"), (2, None, "y"), (3, "", None)], "doc_id long, Text string, _r string")
    for most in (100, -1):
        got = {r.doc_id: r for r in pii.replaced(df, broadcast_rows=max(most, 0)).collect()}
        assert got[2].Text is None and got[3].Text == "" and got[1].Text != "mail a.b@c.org" and got[1]["_r"] == "x"


def test_shared_passages(docs):
    got = {r.doc_id: r for r in chaining.shared_passages(docs, min_words=20).collect()}
    assert len({got[i].class_id for i in range(40, 60)}) == 1 and got[45].n_passages == 1 and got[None].n_passages == 0


def test_passages_that_occur_again_in_one_text(spark):
    word = random.Random(8).sample(range(10**6), 700)
    own = [" ".join(map(str, word[i : i + 60])) for i in range(0, 660, 60)]
    rows = [(1, " ".join([own[1], own[0], own[2], own[0], own[3], own[0], own[4]])), (2, " ".join([own[5], own[0], own[6], own[0], own[7], own[0]]))]
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_passages, r.n_shared_words, r.class_id) for r in sorted(got)] == [(3, 180, 1)] * 2


def test_links_that_only_unlike_texts_connect_are_found(spark):
    # u-w and w-v are near in bits and less than 0.8 alike, u-v is 0.8 or more alike
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        base = [str(rng.randrange(10**6)) for _ in range(200)]
        for at in ((), (30,), (60, 120, 150, 90), (45, 75, 105, 135)):
            own = list(base)
            for i in at:
                own[i] = str(rng.randrange(10**6))
            texts.append(" ".join(own))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    assert _groups(spark, texts, bands=1, band_bits=1, tree_size=16) == _brute_groups(sets, 0.8)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert simhash.near_duplicates(none).count() == 0 and packing.pack(none).count() == 0 and substring.deduplicated(none).count() == 0
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

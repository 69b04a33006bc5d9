"""Periodic runs, SuperMinHash groups and importance draws against brute force and their SQL."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from spanforge.llm import minhash, periodic, resampling

SCHEMA = "doc_id long, text string, runs string, label int, n long, u string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def words(rng, n, of=26):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:of]) for _ in range(6)) for _ in range(n)]


# --- periodic runs ----------------------------------------------------------------------

def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_text(rng, n, alphabet):
    w = [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 30:
            a, size = rng.randrange(n), rng.randint(0, n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(min(size, n - a)):
                w[a + i] = w[a + i % p]
            if rng.random() < 0.4:
                w[rng.randrange(n)] = rng.randrange(alphabet)
    return [str(x) for x in w]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [periodic_text(rng, rng.randint(0, 350), rng.choice([1, 2, 3, 5, 50, 1000])) for _ in range(60)]
    assert periodic.find_runs(texts) == [brute_runs(t) for t in texts]
    assert periodic.find_runs(texts, 10, 4) == [brute_runs(t, 10, 4) for t in texts]


def test_long_periods_and_long_texts():
    rng = random.Random(9)
    block = [str(rng.randrange(50)) for _ in range(7001)]
    text = ["a"] * 9000 + block * 4 + ["b", "c"] * 5000 + [str(i) for i in range(20000)]
    got = periodic.find_runs([text, [], ["x"], text])
    assert got[0] == got[3] and got[1:3] == [[], []]
    assert [(n, q) for s, n, q in got[0] if n > 5000] == [(9000, 1), (7001 * 4, 7001), (10000, 2)]
    # every word of a very long constant text is a minimum of its windows
    assert periodic.find_runs([["z"] * 300_000]) == [[(0, 300_000, 1)]]


def test_runs_of_unusual_rows(spark):
    rng = random.Random(2)
    loop = " ".join(words(rng, 13) * 4)
    rows = [(1, f"one  two\t{loop}\nend"), (2, None), (3, ""), (4, " \n "), (1, f"one  two\t{loop}\nend"), (None, loop), (5, "é " * 30 + " x")]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in periodic.periodic_runs(frame(spark, rows)).collect()]
    first = loop.split()[:13]
    one = (1, 55, [(2, 52, 13)], " ".join(["one", "two", *first, "end"]))
    assert sorted(got, key=str) == sorted([one, one, (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (None, 52, [(0, 52, 13)], " ".join(first)), (5, 31, [(0, 30, 1)], "é  x")], key=str)
    kept = periodic.collapsed(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text, r.runs) for r in kept.collect())[(1, " ".join(["one", "two", *first, "end"]), "x")] == 2
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id in (2, 3, 4)} == {2: None, 3: "", 4: " \n "}
    assert periodic.periodic_runs(frame(spark, rows[:0])).collect() == []


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(periodic_text(rng, rng.randint(0, 300), rng.choice([2, 4, 500])))) for i in range(80)] + [(80, None), (81, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for i, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = None
        for x in runs:
            if best is None or x[1] * best[2] > best[1] * x[2]:
                best = x
        left = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in runs)]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(left))]
        assert got[i] == (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


# --- SuperMinHash -----------------------------------------------------------------------

def test_estimates_are_unbiased_and_vary_less():
    rng, found = np.random.default_rng(0), []
    for _ in range(300):
        x = rng.integers(0, 2**63, 120, dtype=np.uint64)
        a, b = np.unique(x[:110]), np.unique(x[10:])
        found.append(minhash.estimate(*minhash.signatures(np.concatenate((a, b)), np.array([0, 110, 220]), 389)))
    assert abs(np.mean(found) - 100 / 120) < 0.003
    assert np.std(found) < 0.85 * np.sqrt(5 / 36 / 389)


def test_signature_keeps_least_values_of_all_ranks():
    h = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    sig = minhash.signatures(np.concatenate((h, h[:1], h[:7])), np.array([0, 50, 51, 51, 58]), 31)
    whole = np.stack([minhash.signatures(h[i : i + 1], np.array([0, 1]), 31)[0] for i in range(50)])
    assert (np.sort(whole >> np.uint64(52), axis=1) == np.arange(31)).all()  # a permutation of the ranks
    assert (sig[0] == whole.min(axis=0)).all() and (sig[1] == whole[0]).all() and (sig[3] == whole[:7].min(axis=0)).all()
    assert (sig[2] == np.uint64(2**64 - 1)).all()


def sets_of(text):
    w = (text or "").encode().translate(minhash.lowered.__globals__["LOWER"]).split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def brute_groups(rows):
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if label[x] == label[k] and rows[x][0] is not None]
        c = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), c, i is not None and i == c))
    return Counter(out)


def near_rows(seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([1, 2, 6, 20, 60, 120]))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = "changed" + str(rng.randrange(3))
            rows.append((at, rng.choice([" ", "  ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
            at += 1
    return rows + [(at, None), (at + 1, ""), (at + 2, " \t"), (3, rows[3][1]), (None, rows[5][1]), (None, None), (None, "alone " * 3)]


@pytest.mark.parametrize(("seed", "most"), [(0, 4096), (1, 3)])
def test_groups_equal_brute_force(spark, seed, most):
    rows = near_rows(seed)
    got = minhash.near_duplicates(frame(spark, rows), most=most).collect()
    assert Counter(tuple(r) for r in got) == brute_groups(rows)


def test_a_chain_and_a_large_group_without_a_centre(spark):
    # neighbours of the chain are similar, others are not; the group's members are all made from a text that is missing
    rng = random.Random(5)
    chain = words(rng, 200)
    rows = [(i, " ".join(chain[5 * i : 5 * i + 100])) for i in range(20)]
    base = words(rng, 100)
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(100), 3):
            w[k] = f"own{i}"
        rows.append((100 + i, " ".join(w)))
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, rows), most=16).collect())
    assert got == brute_groups(rows)
    assert minhash.near_duplicates(frame(spark, rows[:0])).collect() == []


def test_group_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in near_rows(3) if r[0] is not None]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = minhash.op12_superminhash_near_dedup(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == Counter(con.sql(minhash.OP12_SQL).fetchall())


# --- importance draws -------------------------------------------------------------------

def test_checksums_of_windows():
    rng = random.Random(6)
    w = ["".join(rng.choice("abcé日") for _ in range(rng.choice([1, 3, 8, 63, 64, 200]))) for _ in range(300)]
    text = " ,".join(w).encode()
    n, (got,) = resampling.Features(3, 10_000).of([text])
    want = [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    assert n.tolist() == [300] and got.tolist() == want


def test_draws_equal_their_sql(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = words(rng, 60) + ["Éa", "don't", "x1", "1,5", "A" * 90]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 19, 20, 60])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "-- --"), (303, "word " * 3000)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", " ".join(vocabulary[:20])), ("b", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in resampling.op13_importance_resampling(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(con.sql(resampling.OP13_SQL).fetchall())
    eligible = sum(len((t or "").replace("'", " ").replace(",", " ").split()) >= 20 for _, t in rows)
    assert sorted(r[4] for r in got if r[4] is not None) == list(range(1, eligible * 25 // 100 + 1))


def test_draws_of_unusual_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    target = spark.createDataFrame([], "text string")
    rows = [(1, long), (1, long), (None, long), (None, long), (2, None), (3, "few")]
    got = [(r.doc_id, r.n_features, r.weight, r["rank"]) for r in resampling.resampled(frame(spark, rows), target, percent=100).collect()]
    assert sorted(r[3] for r in got if r[3]) == [1, 2, 3, 4]
    assert {r[:2] for r in got} == {(1, 59), (None, 59), (2, 0), (3, 1)}
    assert all(r[2] == 0 for r in got if r[0] == 2) and all(r[2] < 0 for r in got if r[1] == 59)
    assert resampling.resampled(frame(spark, rows[:0]), target).collect() == []


# --- near copies of the pipeline ----------------------------------------------------------

def test_one_of_each_of_unusual_tables(spark):
    from spanforge.llm import simhash

    rng = random.Random(11)
    base = words(rng, 80)
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 60, 10)]
    long = " ".join(words(rng, 30_000))
    rows = [(5, " ".join(base)), *[(10 + i, t) for i, t in enumerate(near)], (7, " ".join(base)), (7, " ".join(base)), (None, " ".join(base)), (20, None), (21, ""), (None, None), (30, long), (31, long + " end")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 20, 30]
    assert simhash.one_of_each(frame(spark, rows[:0])).collect() == []


def test_later_links_join_whole_components(spark):
    from spanforge.llm._graph import connected_components

    first, more = [(1, 2), (2, 3), (5, 6), (9, 8)], [(3, 6), (9, 20), (30, 31), (6, 40)]
    pairs = lambda x: spark.createDataFrame(x, "u long, v long")
    got = {tuple(r) for r in minhash._joined(connected_components(pairs(first)), pairs(more)).collect()}
    assert got == {tuple(r) for r in connected_components(pairs(first + more)).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 5, 6, 40)} | {(8, 8), (9, 8), (20, 8), (30, 30), (31, 30)}


def test_components_in_one_task_equal_those_by_joins_with_few_exchanges(spark):
    from spanforge.llm._graph import connected_components

    rng = np.random.default_rng(12)
    ends = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(ends, "u long, v long").repartition(4)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "one task")
    one = sorted(map(tuple, connected_components(edges).collect()))
    few = len(jobs.getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("many", "by joins")
    assert one == sorted(map(tuple, connected_components(edges, few=0).collect()))
    spark.sparkContext.setJobGroup("", "")
    assert few <= 12 < len(jobs.getJobIdsForGroup("many"))  # the driver plans and runs the same few jobs, however long a path is
    assert connected_components(edges.where("false")).collect() == []


def test_sets_go_only_where_sketches_leave_a_pair():
    # in one bucket: a text, one of similarity 0.8 to it, one of 0.3 to both, and a copy under the same label
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base, other = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.sort(x) for x in (base, np.concatenate((base[:800], other[:100])), np.concatenate((base[100:515], other[400:885])), base[:895])]
    sig = minhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 389)
    heads = [a.tobytes() + b.tobytes() for a, b in zip(minhash.sketches(sig), np.zeros((4, 64), np.uint32), strict=True)]
    kept = lambda label, guest: [
        i for b in minhash._screened(0.8, minhash.most_differing(0.8, 389), 13)(iter(batches(label, guest))) for i in b.column("id").to_pylist()]

    def batches(label, guest):
        cols = [np.array([7] * 4), np.arange(4), np.array(label), np.array([len(x) for x in sets]), np.zeros(4, np.int32), np.array(guest)]
        for a, b in ((0, 1), (1, 3), (3, 4)):  # a group may lie in several batches
            yield pa.RecordBatch.from_arrays([*(pa.array(c[a:b]) for c in cols), pa.array(heads[a:b], pa.binary())], ["g", "id", "label", "n", "band", "guest", "head"])

    none = [False] * 4
    assert kept([0, 1, 2, 0], none) == [0, 1, 3]
    assert kept([0, 0, 2, 0], none) == []
    assert kept([0, 1, 2, 1], [True, False, False, True]) == [0, 1]
    assert kept([0, 1, 2, 1], [True, True, True, True]) == []


def test_what_the_groups_were_made_from_is_deleted_before_the_documents_are_dealt(spark):
    from pathlib import Path

    from spanforge.llm import _scratch, simhash

    rng = random.Random(21)
    base = words(rng, 60)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), (3, " ".join(words(rng, 60)))]
    before = list(_scratch._made)
    kept = simhash.one_of_each(frame(spark, rows))
    left = [Path(path).name.split("-")[0].split("_")[0] for _, path in _scratch._made if (_, path) not in before]
    assert left == ["groups"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]

"""Kernels against brute force, without Spark."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import chaining, counting, packing, pii, quality, simhash, toxicity
from spanforge.llm._tokens import WordTokenizer
from spanforge.llm.rindex import repeated_starts


@pytest.mark.parametrize("seed", range(40))
def test_run_length_index_finds_repeats(seed):
    rng = random.Random(seed)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
    n = rng.randint(2, 6)
    seen = Counter(c[i : i + n] for c in contexts for i in range(len(c) - n + 1))
    assert [g.tolist() for g in repeated_starts(contexts, n)] == [[i for i in range(len(c) - n + 1) if seen[c[i : i + n]] > 1] for c in contexts]


def test_bk_tree_and_forest():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    keys = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(s)) for s in range(6)]))
    a, b, d = simhash.BKTree(keys).within(keys, 3)
    dist = np.bitwise_count(keys[:, None] ^ keys[None, :])
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(dist <= 3)], strict=True))
    keep = simhash.spanning(a, b, d, len(keys))
    assert len(keep) == len(keys) - 20


def test_tokens_are_the_tokenizers():
    t = WordTokenizer(packing.tokenizer_path())
    odd = ["", "  ", "a\x1cb c", "x y z", "<|endoftext|> hi", "don't I'll we'VE 'S it's_a __b 12a3 ½ ² Ⅷ", "İstanbul ΣΑΣ straße ﬁ 你好 мир naïve é", "a\x01b", "A" * 300]
    got = dict(t.encode([x.encode() for x in odd] + [None]))
    assert [got[i].tolist() for i in range(len(odd))] == [t.slow(x) for x in odd] and not len(got[len(odd)])


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(1)
    h = np.bincount(np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 4096), minlength=4097)
    plan = packing.plan(h)
    used = np.zeros_like(h)
    for count, lengths in plan:
        assert sum(lengths) <= 4096
        np.add.at(used, list(lengths), count)
    assert (used == h).all()
    least = -(-int((h * np.arange(4097)).sum()) // 4096)
    assert sum(c for c, _ in plan) <= least * 1.01 + 1


def test_edits_keep_counts():
    pieces, rng = counting.counter(counting.ranks_path()), random.Random(0)
    parts = ["hello", "world", " ", "  ", "\n", "   ", "'s", "'", "don't", "123", "!!", "é", "  \n "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        tree = counting.SegmentTree.of(text, pieces, rng.choice([1, 2, 3]))
        for _ in range(3):
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            text, _, _ = tree.edit(text, rng.randint(0, len(text) + 2), rng.randint(0, 8), new, pieces)
            assert tree.tokens == len(pieces.encoding.encode_ordinary(text)) and tree.chars == len(text)


def test_surrogates_are_distinct_and_consistent():
    key = b"k"
    assert len({pii.surrogate(key, "card", f"{i:016d}") for i in range(3000)}) == 3000
    new, kinds = pii._replace("Mrs. Anna Kowalski, a.b@C1.org, +1 (377) 555-0271, 4111 1111 1111 1111. KOWALSKI again, a.b@c1.org", key, {}, {})
    assert kinds.count("name") == 3 and kinds.count("email") == 2 and "4111" not in new and "owalski" not in new
    card = [int(c) for c in re.search(r"\d{4} \d{4} \d{4} \d{4}", new).group() if c.isdigit()]
    assert pii._luhn(card[:-1]) == card[-1]
    assert pii._replace("no data here", key, {}, {}) == ("no data here", []) and pii._replace(None, key, {}, {}) == (None, [])


@pytest.mark.parametrize("text", ["[Mr. Smith]", "„Herr Müller“", "‘Dr. Lee’", "<b>Mrs. Jones</b>", "From:Mr. Smith", "/Dr. Xavier", "(mr. Smith)", "MRS. Jones"])
def test_titles_announce_names_wherever_they_stand(text):
    assert [k for _, _, k, _ in pii.entities(text)] == ["name"]


def test_no_form_of_a_cue_is_passed_over():
    for c in sorted(set("".join(pii.TITLES) + pii._INTRO[3:-1]) - set("|")):
        alike = re.findall(re.escape(c), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)])), re.IGNORECASE)
        assert {pii._folded(x) for x in alike} == {pii._folded(c)}


@pytest.mark.parametrize(("number", "kind"), [
    ("+15551234567", "phone"), ("01 23 45 67 89", "phone"), ("01.23.45.67.89", "phone"), ("+33 1 23 45 67 89", "phone"), ("0033 1 23 45 67 89", "phone"), ("+49 (0)30 1234567", "phone"),
    ("0171/1234567", "phone"), ("030 1234567", "phone"), ("(555) 123-4567", "phone"), ("+1 (377) 555-0271", "phone"), ("123-45-6789", "ssn"), ("123 45 6789", "ssn"),
    ("01.02.2024", None), ("2024-01-02", None), ("12345", None), ("1 234 567", None)])
def test_numbers_are_found_in_each_form(number, kind):
    text = f"call {number}, please"
    want = [(5, 5 + len(number), kind)] if kind else []
    assert [x[:3] for x in pii.entities(text)] == want
    new, _ = pii._replace(text, b"k", {}, {})
    assert (new != text) == bool(kind) and len(new) == len(text)


def test_chains_follow_both_orders():
    own = [(i, i + 100) for i in range(0, 40, 8)] + [(20, 3)]
    best = chaining.chains(own, 6, 0.1, 60, 12.0)[0]
    assert best == [(i, i + 100) for i in range(0, 40, 8)]
    assert chaining.edit_distance(np.array([1, 2, 3]), np.array([1, 3, 4])) == 2


def test_pairs_without_a_live_seed_are_not_made():
    key, at = np.arange(6, dtype=np.uint64), np.arange(0, 120, 20)
    none, one = np.zeros(6, bool), np.arange(6) == 4
    assert len(chaining.seed_pairs(key, at, none, 14, 86, none)[0]) == 0
    every = chaining.seed_pairs(key, at, one, 14, 86)
    got = chaining.seed_pairs(key, at, one, 14, 86, one)
    has = (every[1] == 80) | (every[2] == 80)
    assert len(got[0]) == 5 and all((a == b[has]).all() for a, b in zip(got, every, strict=True))


def test_words_alike_at_both_ends_are_not_aligned():
    x = np.arange(20_000)
    y = np.delete(x, 10_000)
    y[10_050] = -1
    assert chaining.edit_distance(x, y) == 2 and chaining._extended(x[:9_000], y[:9_000]) == (9_000, 9_000, 0)
    rising = [(9 * i, 9 * i + 4) for i in range(50)] + [(600, 610), (609, 620)]
    assert chaining.chains(rising, 6, 0.1, 60, 6.0) == [rising[:50], rising[50:]]


def test_classifiers_hold_out():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(600):
        w = [word() for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "zqxw"
        rows.append((" ".join(w).encode(), int(i % 4 == 0)))
    tox = toxicity.train(rows[:450])
    got = tox.scores([t for t, _ in rows[450:]] + [b"", None])
    assert ((got[:-2] >= 0.5) == np.array([y for _, y in rows[450:]])).mean() > 0.97 and got[-1] == got[-2] == 0
    good = [(b" ".join([t] * 2), 1) if y == 0 else (b"!! " + t.upper(), 0) for t, y in rows]
    q = quality.train(good[:300], epochs=4)
    assert ((q.scores([t for t, _ in good[300:]]) >= 0.3) == np.array([y for _, y in good[300:]])).mean() > 0.95
    assert zlib.crc32(b"") == 0


def test_matches_that_no_chain_can_span_are_left_out_before_chaining():
    rng = np.random.default_rng(5)
    for _ in range(300):
        own = [(int(a), int(b)) for a, b in rng.integers(0, rng.integers(10, 80), (rng.integers(2, 9), 2))]
        spans = [min(p[-1][0] - p[0][0], p[-1][1] - p[0][1]) for p in chaining.chains(own, 6, 0.1, 60, 6.0)]
        for words in (5, 14, 30):
            assert chaining._reaches(own, words) or all(s < words for s in spans)
    assert not chaining._reaches([(0, 0), (3, 50)], 14) and chaining._reaches([(0, 9), (14, 30)], 14)

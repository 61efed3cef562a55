import math
import random

import numpy as np
import pytest

from tidemark.llm import leakage

D, I = "doc_id long, text string, item_id long, series string", "item_id long, text string, doc_id long"  # noqa: E741


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], D)
    e = spark.createDataFrame([(i, t, 1) for i, t in items], I)
    rows = [(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(docs, items, run=12):
    grams = lambda t: {tuple(w[k : k + run]) for w in [leakage.words(t)] for k in range(len(w) - run + 1)}
    g = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs for i, x in g if x & grams(t)}


@pytest.mark.parametrize("keys, rows", [(0, 0), (1 << 23, 500_000)])
def test_against_brute_force(spark, keys, rows, monkeypatch):
    """With the filter and a broadcast, and without either."""
    monkeypatch.setattr(leakage, "FILTER_KEYS", keys)
    monkeypatch.setattr(leakage, "INDEX_ROWS", rows)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 30)))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        src = leakage.words(items[r.randrange(12)][1])
        k = r.choice([0, 11, 12, 13])
        docs.append((i, " ".join(w[:20] + src[2 : 2 + k] + w[20:])))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, "word " * 200_000 + items[0][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_markup_entities_case_and_invisible_characters(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, item.upper()), (2, "one <b>two</b> three [i]four[/i] five, six... sev&#101;n ei­ght n​ine&nbsp;ten\neleven - twelve"), (3, item.replace("six", "6")), (4, item[:-7]), (5, "o<i>ne two three four five six seven eight nine ten eleven twelve")]
    assert run(spark, docs, [(7, item)]) == {(1, 7), (2, 7)}


def test_hash_functions_follow_the_size_of_the_window():
    n = [leakage.bands(u, 8) for u in (8, 9, 10, 11, 12)]
    assert n[0] == leakage.AGREE and n == sorted(n) and n[4] < 30
    r = np.random.default_rng(0)
    for u, k in zip((9, 12), (n[1], n[4]), strict=True):  # the same chance at fewer functions, by simulation
        m = k // 3
        short = (r.binomial(m, 8 / u, 200_000) < leakage.AGREE).mean()
        want = sum(math.comb(m, i) * (8 / u) ** i * (1 - 8 / u) ** (m - i) for i in range(leakage.AGREE))
        assert abs(short - want) < 0.01


def test_recall_on_planted_passages():
    """Passages of 12 words at every place of windows of every size, 20,000 of them: none is missed, others do not agree."""
    r = np.random.default_rng(1)
    missed = false = 0
    for k in range(20_000):
        size = 12 + k % 5
        h = r.integers(0, 2**63, size).astype("uint64")
        at = int(r.integers(0, size - 11))
        s = leakage.shingle_hashes(h)
        n = leakage.bands(len(s), 8)
        whole = leakage.window_minima(s, len(s), n)
        part = leakage.window_minima(leakage.shingle_hashes(h[at : at + 12]), 8, n)
        other = leakage.window_minima(leakage.shingle_hashes(r.integers(0, 2**63, 12).astype("uint64")), 8, n)
        missed += (whole == part).sum() < leakage.AGREE
        false += (whole == other).any()
    assert missed == 0 and false == 0


def test_every_passage_lies_in_a_window():
    for n in range(12, 80):
        w = leakage._windows(n, 16, 12)
        assert all(any(s <= i and i + 12 <= min(n, s + 16) for s in w) for i in range(n - 11)) and w[-1] + min(n, 16) == n


def test_the_filter_lets_all_keys_pass(spark):
    sig = np.random.default_rng(2).integers(-(2**63), 2**63, 3000)
    f = leakage.make_filter(spark.createDataFrame([(int(x),) for x in sig], "sig long"), 3000)
    other = np.random.default_rng(3).integers(0, 2**63, 100_000).astype("uint64")
    assert leakage._hit(f, sig.view("uint64")).all() and leakage._hit(f, other).mean() < 0.01
    assert leakage.make_filter(None, leakage.FILTER_KEYS + 1) is None


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == set() == run(spark, [(1, "a b c d e f g h i j k l m")], [])

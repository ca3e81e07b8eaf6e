import itertools
import random

import numpy as np

from finquarry.llm.ngram_join import Threshold, ngram_join, one_of_each_group, part_keys, shingles, t_occurrence_links


def plain_set(text, n):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def corpus(seed, groups=25, frequent=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    common = " ".join(rnd.choice(vocab) for _ in range(60))
    texts = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 12, 60, 150, 300]))]
        for _ in range(rnd.randint(1, 6)):
            t = list(base)
            for _ in range(rnd.randint(0, 1 + len(t) // 40)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(t) + rnd.choice(["", " ", "\n"]))
    texts += [common + " " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 25))) for _ in range(frequent)]
    return texts + [None, "", "  \t", "one", "ONE", "one two", "a b c d", "É é x y"]


def test_join_equals_brute_force(spark):
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        texts = corpus(n)
        rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
        got = {r.doc_id: r for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, num, den, block_rows=7).collect()}
        sets = {i: plain_set(t, n) for i, t in rows}
        want = components(sets, num, den)
        assert {i: got[i].component_id for i in sets} == want
        assert {i: got[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
        assert sum(v != k for k, v in want.items()) > 20


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(5)
    for num, den, least in ((9, 10, 3), (8, 10, 2)):
        t = Threshold(num, den)
        for _ in range(400):
            n = int(rnd.integers(1, 700))
            a = rnd.integers(0, 1 << 63, n).astype(np.uint64)
            cut = int(rnd.integers(0, 1 + n * (den - num) // den))
            b = np.concatenate([a[cut:], rnd.integers(0, 1 << 63, max(0, int(rnd.integers(0, n // 8 + 1)))).astype(np.uint64)])
            a, b = np.unique(a * np.uint64(2)), np.unique(b * np.uint64(2))
            if not len(b) or den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
                continue
            rare = lambda s: s % np.uint64(5) != 0
            keys = [np.concatenate([part_keys(s, p, spare, rare(s), least if p > 2 else 0) for p, spare in t.rungs(len(s))]) for s in (a, b)]
            assert len(np.intersect1d(*keys)), (n, len(a), len(b))


def test_divide_skip_equals_brute_force():
    rnd, t = random.Random(1), Threshold(8, 10)
    for _ in range(60):
        base = rnd.sample(range(400), 40)
        sets = {i: set(base) ^ set(rnd.sample(range(400), rnd.randint(0, 9))) for i in range(12)}
        arrays = [np.sort(np.array(sorted(s), dtype=np.uint64)) for s in sets.values()]
        links = t_occurrence_links(list(sets), arrays, t)
        for a, b in links:
            assert 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
        root = {i: i for i in sets}
        for a, b in links:
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
        assert root == components(sets, 8, 10)


def test_shingles_keep_non_ascii_capitals():
    assert len(shingles("É a b".encode(), 3)) == 1 and (shingles("A b C".encode(), 3) == shingles(b"a B c", 3)).all() and (shingles("É".encode(), 3) != shingles("é".encode(), 3)).all()


def test_odd_tables(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3), (4, "A b c d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell long")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join(df).collect()) == [(0, None), (4, 4), (5, 4), (5, 4)]
    assert sorted((r.doc_id or 0, r.cell) for r in one_of_each_group(df).collect()) == [(0, 1), (4, 4)]


def test_unrelated_sets_share_no_key():
    rnd, t = np.random.default_rng(7), Threshold(8, 10)
    seen = {}
    for i in range(400):
        s = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(30, 200))).astype(np.uint64) * np.uint64(2))
        for p, spare in t.rungs(len(s)):
            for k in part_keys(s, p, spare, np.ones(len(s), bool), 2).tolist():
                seen.setdefault(k, set()).add(i)
    assert max(map(len, seen.values())) == 1

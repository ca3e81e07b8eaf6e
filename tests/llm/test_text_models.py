import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from finquarry.llm.hmm_lm import Hmm, lm_scores
from finquarry.llm.quality import FEATURES, fit_trees, quality_rules, text_statistics
from finquarry.llm.toxicity import clean_documents, maximal_segments, toxicity_query

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    ws = WORD.findall(text)
    seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


def test_statistics_equal_plain_ones():
    rnd = random.Random(1)
    for text in ["", " ", "a", "a a a a", "x y z x y z", "é b c #*", "l1\nl1\n\n \nl2\r\nl2"] + ["".join(rnd.choice(["a ", "b ", "é ", "#", "\n", "\t", "ab\n", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(500)]:
        assert text_statistics(text.encode())[0] == plain_statistics(text), text


def test_trees_learn_and_stay_monotone():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7) ^ (rnd.random(3000) < 0.05)).astype(float)
    trees = fit_trees(x, y, np.array([1, -1, 0]))
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.93
    grid = np.linspace(0, 1, 101)
    for _ in range(20):
        row = np.tile(rnd.random(3), (101, 1))
        up, down = row.copy(), row.copy()
        up[:, 0], down[:, 1] = grid, grid
        assert (np.diff(trees.margin(up)) >= -1e-9).all() and (np.diff(trees.margin(down)) <= 1e-9).all()
    assert fit_trees(x[:0], y[:0], np.zeros(3)).probability(x[:2]).tolist() == [0.5, 0.5]


def quality_tables(spark):
    rnd, docs, labels = random.Random(3), [], []
    for i in range(400):
        good = i % 3 > 0
        ws = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) + ("" if good or rnd.random() < 0.3 else "###") for _ in range(rnd.randint(60, 120))]
        docs.append((i, " ".join(ws), "src", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    docs += [(1000, None, "s", 0), (1001, "", None, 0), (1002, "a b c " * 40, "s", 0), (None, "x " * 60, "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, label int"), spark.createDataFrame([*labels, (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy(spark):
    docs, labels = quality_tables(spark)
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert len(FEATURES) == len(text_statistics(b"a b")[1])
    held = [i for i in range(400) if i % 2 == 0]
    assert sum(got[i].kept == (i % 3 > 0) for i in held) / len(held) > 0.95
    assert got[1000].base_failed and got[1001].n_words == 0 and got[1002].base_failed and not got[1002].kept
    assert quality_rules(docs.limit(0), labels).count() == 0 and quality_rules(docs, labels.limit(0)).count() == docs.count()


def test_segments_equal_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        s = rnd.integers(-3, 4, rnd.integers(0, 14)).astype(float)

        def largest(a, b, s=s):
            best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            *_, i, j = best
            return [*largest(a, i), (i, j, float(s[i:j].sum())), *largest(j, b)]

        got = maximal_segments(s)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in largest(0, len(s)))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_toxicity_held_out(spark):
    rnd, rows, labels = random.Random(6), [], []
    bad = ["vileling", "vilelest", "grumbad", "nastor"]
    for i in range(700):
        toxic = i % 6 == 0
        ws = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(40, 200))]
        for _ in range(rnd.randint(3, 8) if toxic else 0):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(bad))
        rows.append((i, " ".join(ws), "x", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "x", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity_query(docs, lab).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i in held)
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and got[1000].predicted == 0
    kept = clean_documents(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    odd = docs.limit(30).unionAll(docs.limit(30)).unionAll(spark.createDataFrame([(None, "plain words", None, None, 3)] * 2, docs.schema)).withColumn("label", docs["n_chars"])
    assert sorted(r.doc_id is None for r in toxicity_query(odd, lab).collect()) == [False] * 60 + [True] * 2
    assert toxicity_query(docs, lab.limit(0)).count() == len(rows) and toxicity_query(docs.limit(0), lab).count() == 0


def test_forward_equals_sum_over_paths():
    rnd = np.random.default_rng(7)
    k, m = 3, 5
    model = Hmm(rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.ones(k), k), rnd.dirichlet(np.ones(m), k).T)
    texts = [rnd.integers(0, m, n).astype(np.uint16) for n in (1, 4, 2, 6)]

    def paths(t):
        p = model.start * model.emit[t[0]]
        for s in t[1:]:
            p = (p @ model.move) * model.emit[s]
        return math.log10(p.sum())

    assert np.allclose(model.log10(texts), [paths(t) for t in texts])
    texts += [rnd.integers(0, m, n).astype(np.uint16) for n in (23, 23, 9)]
    start, move, emit, fit = model.expect(texts)
    want = plain_expect(model, texts)
    for options in ({}, {"span": 4}, {"most": 10}, {"most": 1, "span": 1}):
        for a, b in zip(model.expect(texts, **options), want, strict=True):
            assert np.allclose(a, b), options
    assert np.isclose(fit, model.log10(texts).sum())
    assert np.isclose(start.sum(), len(texts)) and np.isclose(emit.sum(), sum(map(len, texts))) and np.isclose(move.sum(), sum(len(t) - 1 for t in texts))


def plain_expect(model, texts):
    """Expected counts by forward and backward sums over each whole text."""
    k = len(model.start)
    start, move, emit, fit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    for t in texts:
        fwd, bwd = [model.start * model.emit[t[0]]], [np.ones(k)]
        for s in t[1:]:
            fwd.append((fwd[-1] @ model.move) * model.emit[s])
        for s in t[:0:-1]:
            bwd.insert(0, model.move @ (model.emit[s] * bwd[0]))
        z = fwd[-1].sum()
        fit += math.log10(z)
        start += fwd[0] * bwd[0] / z
        for i, s in enumerate(t):
            emit[s] += fwd[i] * bwd[i] / z
            if i:
                move += fwd[i - 1][:, None] * model.move * (model.emit[s] * bwd[i])[None, :] / z
    return start, move, emit, fit


def test_a_word_is_hashed_once_a_stretch(monkeypatch):
    """A million words of few kinds cost as many hashes as kinds; before, one a word."""
    from finquarry.llm import hmm_lm

    calls, real = [], hmm_lm._hash
    monkeypatch.setattr(hmm_lm, "_hash", lambda w: calls.append(w) or real(w))
    texts = [" A b\x0bc\x1cd É\u00a0é " * 50, None, "", " \n", "b a"] * 3
    (got,) = hmm_lm._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    want = Counter(w for t in texts for w in (t or "").encode().lower().split())
    assert sorted(calls) == sorted(want) and {real(w) for w in want} == {h % 2**64 for h in got["h"].to_pylist()} and sorted(got["n"].to_pylist()) == sorted(want.values())
    known = np.sort(hmm_lm.hashes([b"a", b"b"]))
    lexicon = hmm_lm.Lexicon(known, np.array([3, 5]), np.array([1, 0]), 99, 9, 4, np.linspace(1, 2, hmm_lm.CLASSES), 2)
    calls.clear()
    n, base, beside, n_known, symbols, rare = lexicon.encode(hmm_lm.Tokens(pa.array(texts)))
    assert sorted(calls) == sorted(want)
    for i, t in enumerate(texts):
        h = hmm_lm.hashes(ws := (t or "").encode().lower().split())
        at = {int(x): k for k, x in enumerate(known)}
        counts = [(3, 5)[at[x]] if x in at else 0 for x in h.tolist()]
        own = [at.get(x) == 0 for x in h.tolist()]
        kinds = [hmm_lm.word_class(w) for w in ws]
        assert n[i] == len(ws) + 1 and n_known[i] == sum(c > 0 for c in counts) + 1
        assert np.frombuffer(symbols[i].as_py(), np.uint16).tolist() == [1 if o else 2 + k for o, k in zip(own, kinds, strict=True)] + [hmm_lm.END]
        assert np.frombuffer(rare[i].as_py(), np.int64).tolist() == [x for x in h.tolist() if x not in at]
        assert math.isclose(base[i], sum(math.log10(c + 1) for c in counts) + math.log10(5))
        assert math.isclose(beside[i], sum(math.log10(c + 1) - lexicon.class_log[k] for c, o, k in zip(counts, own, kinds, strict=True) if not o), abs_tol=1e-9)


def test_messages_scaled_seldom_equal_those_scaled_always(monkeypatch):
    from finquarry.llm import hmm_lm

    rnd = np.random.default_rng(11)
    k, m = 4, 60
    model = Hmm(rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.full(k, 0.05), k) + 1e-12, rnd.dirichlet(np.full(m, 0.1), k).T + 1e-17)
    texts = [rnd.integers(0, m, n).astype(np.uint16) for n in (0, 900, 900, 333, 17, 16, 1, 0)]
    seldom = [*model.expect(texts), *model.expect(texts, most=500, span=100), model.log10(texts)]
    monkeypatch.setattr(hmm_lm._Together, "EVERY", 1)
    for a, b in zip(seldom, [*model.expect(texts), *model.expect(texts), model.log10(texts)], strict=True):
        assert np.isfinite(a).all() and np.allclose(a, b)
    assert model.expect([])[3] == 0 and model.log10(texts)[0] == 0 and len(model.log10([])) == 0


def test_scores_do_not_depend_on_partitioning(spark):
    rnd = random.Random(9)
    rows = [(i % 90, " ".join(rnd.choice(["a", "bb", "c,", "dé"]) for _ in range(rnd.randint(0, 400)))) for i in range(120)] + [(None, "x y"), (None, None), (5, "é " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id or -1, r.n_tokens, r.base_score)
    a, b = (sorted(lm_scores(d).collect(), key=key) for d in (docs.coalesce(1), docs.repartition(7)))
    assert len(a) == len(rows) and all(math.isclose(x.score, y.score, rel_tol=1e-9) and key(x)[:2] == key(y)[:2] for x, y in zip(a, b, strict=True))


def test_language_model(spark):
    rnd = random.Random(8)
    langs = [[f"{p}{i}" for i in range(200)] for p in "ab"]
    rows = [(i, " ".join(rnd.choice(langs[i % 2]) for _ in range(rnd.randint(1, 60)))) for i in range(300)] + [(1000, None), (1001, "Never seen É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scores(docs, known=100, symbols=40).collect()}
    counts, texts = Counter(), {}
    for i, t in rows:
        texts[i] = [*(t or "").encode().lower().split(), "END"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(texts[i])
    n, v = sum(counts.values()), len(counts)
    for i, ws in texts.items():
        r = got[i]
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(docs.limit(0)).count() == 0


def test_a_repeated_id_is_one_labelled_row(spark):
    from finquarry.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k % 5}") for k in range(300)] + [(k, f"other {k}") for k in range(2, 30)] + [(2, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)] + [(1, 0, 0), (99, 1, 1)], "doc_id long, toxic int, quality int")
    got = labelled_sample(docs, labels, "toxic", 100).collect()
    assert len(got) == 29 and {(r.text, r.label) for r in got if r.doc_id == 1} == {("text 0", 1)} and {r.text for r in got if r.doc_id == 2} == {"other 2"}
    assert 6 <= len(labelled_sample(docs, labels, "toxic", 7).collect()) <= 7  # one label has no document

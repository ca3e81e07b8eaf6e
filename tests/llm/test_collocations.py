import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from finquarry.llm import collocations as M
from finquarry.llm import common

DOCS = "doc_id long, lang string, text string, n long, w1 string"


def plain(rows, least, longest, share, top):
    """Counts by loops over all phrases."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, left, right) in enumerate(sorted(ps)[:top]))


def made(seed, docs):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "e", "zé", "eta", "x\x1cy", " ", "Ünd"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(rng.randint(0, 60)))
    return [(i, rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text(), text(), None, "", "Hot pair of words. "]), 0, "w") for i in range(docs)]


@pytest.mark.parametrize("bits, top, known", [(20, 2000, 1 << 22), (7, 5, 1 << 22), (7, 2000, 0)])
def test_phrases_against_plain_counts(spark, monkeypatch, bits, top, known):
    """With small filters and many quotients too, which tasks then write and merge many times, and without a dictionary."""
    monkeypatch.setattr(M, "QUOTIENT", 1 << bits)
    monkeypatch.setattr(M, "DICTIONARY", known)
    if bits == 7:
        monkeypatch.setattr(M, "GRAMS", 50)
        monkeypatch.setattr(M, "WORDS", 4)
        monkeypatch.setattr(M, "CHUNK", 100)
    rows = made(4, 250) + [(None, "fr", "de la de la de la. " * 3000, 1, None)]
    got = M.collocations(spark.createDataFrame(rows, DOCS).repartition(5), least=12, top=top)
    assert sorted(map(tuple, got.collect())) == plain([r[1:3] for r in rows], 12, 4, 80, top)


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter_phrases_only(spark, longest):
    rows = made(9, 120)
    got = M.collocations(spark.createDataFrame(rows, DOCS), least=10, longest=longest)
    assert sorted(map(tuple, got.collect())) == plain([r[1:3] for r in rows], 10, longest, 80, 2000)


def test_empty_tables_and_texts(spark):
    assert M.collocation_query(spark.createDataFrame([], DOCS)).collect() == []
    assert M.collocation_query(spark.createDataFrame([(1, None, None, 0, None)] * 40, DOCS)).collect() == []


@pytest.mark.parametrize("width", [7, 16, 21, 22, 33, 64])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_are_lossless(width, n):
    rng = np.random.default_rng(width + n)
    ids = [rng.integers(0, 40, 5000).astype(np.uint64) * np.uint64(((1 << width) - 1) // 41) for _ in range(n)]
    want = Counter(zip(*(c.tolist() for c in ids)))
    for bits in (0, 3, 8, 13):
        f = M.Filter(M.Packing(n, width, bits))
        for a in range(0, 5000, 700):
            f.add(f.packing.pack([c[a : a + 700] for c in ids]), np.full(len(ids[0][a : a + 700]), 300, np.int64))
        got = {}
        for q, entries, rest, counters in f.flush():
            cols, counts = f.packing.from_block(rest, counters, entries, q)
            assert (np.diff(cols[0].astype(np.float64)) >= 0).all() and (f.packing.quotients(cols[0]) == q).all()
            got |= dict(zip(zip(*(c.tolist() for c in f.packing.unpack(cols))), counts.tolist()))
        assert got == {k: 300 * v for k, v in want.items()}


def test_entries_that_share_their_first_column_stay_apart():
    first = np.array([5, 5, 5, 5], np.uint64)
    cols, counts = M.collapse([first, np.array([2, 1, 2, 1], np.uint64)], np.ones(4, np.int64))
    assert cols[1].tolist() == [1, 2] and counts.tolist() == [2, 2]


def test_chunks_keep_pieces_whole(monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 10)
    texts = [b"Ab cd, ef gh ij kl mn op qr. st", b"", b"x" * 35, b"a.b.c"]
    got = [p.split() for c in M.chunks(texts) for p in c.split(b"\n")]
    want = [p.split() for t in texts for p in re.split(rb"[.,;:!?\n-\r]", t.lower())]
    assert [p for p in got if p] == [p for p in want if p]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_exploded_side_counted_large_is_never_broadcast(spark, monkeypatch):
    """Spark takes the sixteen rows that each row becomes for one, and files as they are compressed."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    small = common.stage(spark.range(50).select("id", (F.col("id") * 2).alias("twice")), "small")
    for how in ("inner", "left"):
        got = common.salted(spark.range(200).selectExpr("id", "id % 7 as by"), small, ["id"], ["by"], 64, how)
        assert "BroadcastHashJoin" not in plan_of(got) and "SortMergeJoin" in plan_of(got)
        assert sorted(map(tuple, got.select("id", "twice").collect())) == [(i, 2 * i if i < 50 else None) for i in range(50 if how == "inner" else 200)]


@pytest.mark.parametrize("limit", [-1, 32 << 20])
def test_counted_sizes_decide_what_is_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    plans = {}
    monkeypatch.setattr(M, "stage", lambda df, name: (plans.setdefault(name, plan_of(df)), common.stage(df, name))[1])
    rows = made(4, 250)
    got = M.collocations(spark.createDataFrame(rows, DOCS), least=12)
    joins = [p.count("BroadcastHashJoin") for p in (plans["best"], plans["best-words"], plan_of(got))]
    assert joins == ([0, 0, 0] if limit < 0 else [3, 1, 5])
    assert sorted(map(tuple, got.collect())) == plain([r[1:3] for r in rows], 12, 4, 80, 2000)


def test_only_words_of_the_best_phrases_are_sent_and_their_letters_count(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10_000)
    sent = {}
    monkeypatch.setattr(M, "stage", lambda df, name: sent.setdefault(name, common.stage(df, name)))
    long = [c * 3000 for c in "abcd"]
    rows = [(i, "en", f"{' '.join(long)}. {' '.join(f'w{k}' for k in range(60))}.", 0, "w") for i in range(40)]
    rows += [(i, "en", ". ".join(f"w{k}" for k in range(60)), 0, "w") for i in range(40)]
    got = M.collocations(spark.createDataFrame(rows, DOCS), top=1)
    assert plan_of(got).count("BroadcastHashJoin") == 1
    assert sent["best-words"].count() == 4 and sent["words"].count() == 64
    assert [tuple(r) for r in got.collect()] == plain([r[1:3] for r in rows], 30, 4, 80, 1)

import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from finquarry.llm import packing
from finquarry.llm.common import ARROW_BYTES, table
from finquarry.llm.mixing import mix_query, mixed_documents, pivotal, water_fill
from finquarry.llm.packing import ChunkIds, local_search, pack_documents, pack_pieces, piece_documents

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_water_fill(sizes, weights, cap):
    order = sorted((x for x in sizes if x[0] is not None), key=lambda x: x[0]) + [x for x in sizes if x[0] is None]
    weight = [weights[i % len(weights)] for i in range(len(order))]
    left, free, target = float(sum(n for _, n in order)), set(range(len(order))), [0.0] * len(order)
    while free and left > 0:
        each = left / sum(weight[i] for i in free)
        full = [i for i in free if each * weight[i] >= cap * order[i][1]]
        for i in full or free:
            target[i] = cap * order[i][1] if full else each * weight[i]
        if not full:
            break
        free -= set(full)
        left -= sum(target[i] for i in full)
    return {s: t for (s, _), t in zip(order, target, strict=True)}


def test_water_fill_equals_the_plain_version(spark):
    rnd = random.Random(3)
    cases = [[("b", 10), (None, 5), ("a", 100)], [("a", 0)], [], [(f"s{i}é"[: rnd.randint(1, 4)] + str(i), rnd.choice([0, 1, 7, 50, 9000])) for i in range(200)]]
    for sizes in cases:
        got = {r.source: r.target for r in water_fill(spark.createDataFrame(sizes, "source string, source_size long").repartition(3), (5, 2, 1), 3.0).collect()}
        want = plain_water_fill(sizes, (5, 2, 1), 3.0)
        assert got.keys() == want.keys() and all(abs(got[s] - t) <= 1e-6 * max(1, t) for s, t in want.items())


def test_repeated_rows_are_rounded_one_by_one(spark):
    rows = [(7, "w " * 10, "a", "x")] * 1000 + [(100 + i, "v " * (1 + i), "a", "y") for i in range(48)] + [(300 + i, "u " * 40, "b", "z") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, unit string").repartition(5)
    got = mix_query(df).collect()
    assert len(got) == len(rows)
    for n, t in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if r.source_size == n) - t) <= 48
    mixture = mixed_documents(df).collect()
    assert sum(len(r.text.split()) for r in mixture) == sum(r.taken for r in got) and mixture[0].asDict().keys() == {"doc_id", "text", "source", "unit"}
    assert sum(r.doc_id == 7 for r in mixture) * 10 == sum(r.taken for r in got if r.doc_id == 7)


def test_pivotal_keeps_words_and_expectation():
    rnd = np.random.default_rng(0)
    size = rnd.integers(1, 900, 40)
    total = np.zeros(40)
    for _ in range(600):
        p = pivotal(size, np.full(40, 0.3), rnd.random(40))
        still = (p > 0) & (p < 1)
        assert still.sum() <= 1 and abs(size @ p - 0.3 * size.sum()) < 1e-6 * size.sum()
        total += p
    assert np.abs(total / 600 - 0.3).max() < 0.12


def test_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "b", "b", "b", None]), i) for i in range(900)] + [(5000, None, "a", 1), (5001, "x", "zz", 2), (7, "dup dup", "a", 3), (7, "dup dup", "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words long").repartition(3)
    got = mix_query(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_query(df).collect()))
    for n, t in {(r.source_size, r.target) for r in got}:
        mine = [r for r in got if (r.source_size, r.target) == (n, t)]
        assert abs(sum(r.taken for r in mine) - t) <= 42 and all(r.taken in [k * r.size for k in range(4)] for r in mine)
    taken = sum(r.taken for r in got)
    assert sum(len((r.text or "").split()) for r in mixed_documents(df).collect()) == taken
    assert mixed_documents(df).columns == df.columns
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_query(none).count() == 0 and mixed_documents(none).count() == 0


def test_chunked_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    rnd, parts = random.Random(1), list(" \n\t'aé.,!1²　Ωx") + ["  ", " the", "'s", "\x1c", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    got = [np.frombuffer(i, "<u4").tolist() for i in ChunkIds(PATH).encode(texts)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_are_ids_of_their_own():
    t, texts = Tokenizer.from_file(PATH), ["end <|endoftext|> of", "<|endoftext|>", "a  <|endoftext|>b c", "plain text here", "a<|endoftext|> "]
    got = [np.frombuffer(i, "<u4").tolist() for i in ChunkIds(PATH).encode(texts)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] and len(got[0]) == 4


def test_chunks_are_looked_up_once_for_many_texts():
    """Before, every occurrence of a chunk was."""
    asked = []

    class Seen(ChunkIds):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    t, texts = Tokenizer.from_file(PATH), ["head to toe, to  a b  c", " to", "", "toe", "  x to", "to<|endoftext|> to"] + ["a to toe, é " * 100] * 30
    chunks = Seen(PATH)
    for _ in range(2):
        asked.clear()
        got = [np.frombuffer(i, "<u4").tolist() for i in chunks.encode(texts)]
        assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert len(asked) == len(set(asked)) < 20
    assert chunks.encode([]) == [] and chunks.encode(["", ""]) == [b"", b""]


BIG = 2**53 + 1


def test_large_ids_stay_exact_beside_null_ones(spark):
    rows = [(None, "a b c", "s", 0), (BIG, "d e", "s", 1), (BIG + 2, "f g h i", "s", 2), (-BIG, "x", None, 3), (None, None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, known int").coalesce(1)
    ids = sorted([r[0] for r in rows], key=str)
    assert sorted([r.doc_id for r in pack_documents(df, PATH).collect()], key=str) == ids
    assert sorted([r.doc_id for r in mix_query(df).collect()], key=str) == ids
    assert {r.doc_id for r in mixed_documents(df).collect()} <= set(ids)


def test_one_very_long_text_among_short_ones(spark):
    text = "lorem ipsum, " * 60_000
    df = spark.createDataFrame([(1, text, "s"), (2, "short", "s"), (None, "", None)], "doc_id long, text string, bin string")
    got = pack_documents(df, PATH).toPandas()
    n = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids) + 1
    mine = got[got["doc_id"] == 1].sort_values("piece")
    assert mine["length"].sum() == n and mine["start"].tolist() == [0, *mine["length"].cumsum().tolist()[:-1]] and got.groupby("sequence_id")["length"].sum().max() <= 2048


def decreasing_fit(sizes, room):
    """Best-fit decreasing, plainly: what the search is measured against."""
    free = []
    for s in sorted(sizes.tolist(), reverse=True):
        k = min((k for k, f in enumerate(free) if f >= s), key=lambda k: free[k], default=None)
        if k is None:
            free.append(room - s)
        else:
            free[k] -= s
    return len(free)


def test_search_empties_bins_of_a_plain_start():
    rnd, room = np.random.default_rng(1), 2048
    for low, high, n in ((1, 700, 300), (1, 2048, 1500), (690, 1000, 400), (300, 1100, 600), (683, 700, 90)):
        sizes = rnd.integers(low, high, n)
        then = local_search(sizes, np.arange(n), room)
        fill = np.bincount(then, weights=sizes)
        assert sorted(np.unique(then)) == list(range(len(fill))) and fill.max() <= room and fill.sum() == sizes.sum()
        assert len(fill) <= decreasing_fit(sizes, room), (low, high, n, len(fill), decreasing_fit(sizes, room))
        if high == 700 and low == 1:
            assert len(fill) == -(-sizes.sum() // room)


def test_exchanges_empty_bins_that_moves_cannot():
    for sizes, bins in (([60, 30, 70, 35], [0, 0, 1, 2]), ([50, 45, 40, 10, 52], [0, 0, 1, 1, 2])):
        sizes = np.array(sizes)
        then = local_search(sizes, np.array(bins), 100)
        before, after = (np.bincount(b, weights=sizes, minlength=3) for b in (bins, then))
        assert (after**2).sum() > (before**2).sum() and after.max() <= 100 and after.sum() == before.sum()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_real_documents_need_no_more_bins_than_their_tokens(spark):
    pieces = piece_documents(spark.read.parquet(f"{SF}/documents.parquet"), PATH).toPandas()
    sizes = pieces["length"].to_numpy()
    then = local_search(sizes, np.arange(len(sizes)), 2048)
    assert then.max() + 1 == -(-sizes.sum() // 2048) == 481 < len(sizes) == 1153  # bins after and before


def test_groups_and_tree(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rnd.integers(1, 2049, 3000))] + [(None, 0, 0, 5, 1)] * 3
    got = pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), group_rows=200, fan_in=4).toPandas()
    assert len(got) == len(rows) and got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= decreasing_fit(np.array([r[3] for r in rows]), 2048) * 1.03


def test_packing_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "bcd", "é", "x1"]) for _ in range(rnd.choice([3, 40, 700, 3000])))) for i in range(60)] + [(100, None), (101, ""), (1, "again"), (1, "again"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack_documents(df, PATH).collect()
    t, seen = Tokenizer.from_file(PATH), {}
    for r in got:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seen.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 2048
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        mine = [r for r in got if r.doc_id == doc and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert {(r.piece, r.start, r.length) for r in mine} >= {(k, s, n) for k, s, n in spans_of(len(ids))}
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def spans_of(n, most=2048):
    first = n % most or most
    return [(0, 0, first)] + [(k + 1, s, most) for k, s in enumerate(range(first, n, most))]


def test_chunks_are_let_go_after_a_rest(monkeypatch):
    monkeypatch.setattr(packing, "REST_SECONDS", 0.2)
    first = packing._loaded(PATH)
    packing._rest()
    assert packing._loaded(PATH) is first  # a task in time keeps them
    time.sleep(0.4)
    assert PATH in packing._LOADED
    packing._rest()
    time.sleep(0.6)
    assert not packing._LOADED


def test_arrow_batches_are_bounded_by_bytes(spark, tmp_path):
    name, own = "spark.sql.execution.arrow.maxBytesPerBatch", "1048576"
    spark.createDataFrame([(k, "x" * 20_000) for k in range(2000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def most(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], ["n"])

    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        assert table(spark, tmp_path, "documents").mapInArrow(most, "n long").first().n < 1.1 * ARROW_BYTES
        spark.conf.set(name, own)
        table(spark, tmp_path, "documents")
        assert spark.conf.get(name) == own
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)

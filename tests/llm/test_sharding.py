import math
import tempfile

import numpy as np
import pytest

from finquarry.llm import sharding
from finquarry.llm.sharding import jump, moved, shard_query, shard_rows, write_shards

DOCS = "doc_id long, text string, shard string, _n int"


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_plain_walk():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        jump(keys, 0)


def test_an_appended_shard_takes_its_part_and_no_more(spark):
    got = shard_rows(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", 16)
    to = moved(got).collect()
    assert {r.grown_shard for r in to} == {16} and abs(len(to) / 20_000 - 1 / 17) < 0.01
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.15 * 20_000 / 16


@pytest.mark.parametrize("slice_rows, copies", [(4096, 4096), (4, 8)])
def test_rows_of_all_kinds_get_gapless_places(spark, monkeypatch, slice_rows, copies):
    monkeypatch.setattr(sharding, "SLICE", slice_rows)
    monkeypatch.setattr(sharding, "COPIES", copies)
    big = 2**53 + 1
    rows = [(None, "a", None, 1)] * 40 + [(None, f"t{i}", "s", None) for i in range(60)] + [(big, "x", None, 1), (big + 2, None, None, 1), (7, "", "q", 2), (7, "é" * 5000, "q", 2)] + [(i, "same", None, 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    out = shard_rows(df)
    assert out.columns == ["doc_id", "text", "shard", "_n", "shard_", "slot", "grown_shard"]
    got = out.collect()
    order = lambda rs: sorted(rs, key=str)
    assert order([tuple(r)[:4] for r in got]) == order(rows)
    for s in {r.shard_ for r in got}:
        assert sorted(r.slot for r in got if r.shard_ == s) == list(range(sum(r.shard_ == s for r in got)))
    assert len({r.shard_ for r in got if r.doc_id is None}) == 1
    assert all(math.isclose(0, 0) and 0 <= r.shard_ < 16 and r.grown_shard in (r.shard_, 16) for r in got)
    assert order(map(tuple, shard_rows(df.repartition(3)).collect())) == order(map(tuple, got))


def test_contract_columns_and_empty_tables(spark):
    got = {r.doc_id: r for r in shard_query(spark.createDataFrame([(1, None, None, 0), (2, "é", None, 0)], DOCS)).collect()}
    assert (got[1].size, got[1].text_crc32, got[2].size, got[2].law) == (1, 0, 3, "key")
    assert shard_query(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_are_written_whole(spark):
    df = spark.createDataFrame([(i, f"text {i}", None, i) for i in range(200)], DOCS).drop("shard")
    with tempfile.TemporaryDirectory() as d:
        write_shards(shard_rows(df), f"{d}/out")
        back = spark.read.parquet(f"{d}/out")
        assert back.count() == 200 and back.filter("shard = 3").select("doc_id").distinct().count() == back.filter("shard = 3").count()

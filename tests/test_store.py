"""The price table's batches: replays, crashes between writes, pruning; and universes with what they drop."""

import datetime as dt
import json
import os

import pytest

from finquarry.sources import payloads, store
from finquarry.streaming.ingest import PRICES, ingest_stream, read_prices, upsert_prices

AT = dt.datetime(2024, 3, 1)


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), None, None, None, c, None, None, AT + dt.timedelta(hours=h)) for s, d, c, h in rows], PRICES)


def table(spark, path, months=None):
    return sorted((r.symbol, str(r.trade_date), r.close) for r in read_prices(spark, path, months).collect())


def test_a_batch_is_merged_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert upsert_prices(bars(spark, [("A", "2024-01-02", 1.0, 0), ("A", "2024-02-02", 2.0, 0)]), path, 0)
    assert upsert_prices(bars(spark, [("A", "2024-02-02", 3.0, 1), ("B", "2024-02-05", 9.0, 1)]), path, 1)
    assert not upsert_prices(bars(spark, [("A", "2024-02-02", 99.0, 5)]), path, 1)  # comes again
    want = [("A", "2024-01-02", 1.0), ("A", "2024-02-02", 3.0), ("B", "2024-02-05", 9.0)]
    assert table(spark, path) == want and store.committed(spark, path) == [0, 1]
    assert upsert_prices(bars(spark, [("A", "2024-02-02", 2.5, 0)]), path)  # an older ingest comes late
    assert table(spark, path) == want and store.committed(spark, path) == [0, 1, 2]


def test_a_batch_that_broke_off_is_not_read_and_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_prices(bars(spark, [("A", "2024-01-02", 1.0, 0)]), path, 0)
    upsert_prices(bars(spark, [("A", "2024-01-02", 7.0, 1), ("A", "2024-01-03", 7.0, 1)]), path, 1)
    os.remove(f"{path}/batch=1/_SUCCESS")  # as if the job had died before its commit
    assert table(spark, path) == [("A", "2024-01-02", 1.0)]
    assert upsert_prices(bars(spark, [("A", "2024-01-02", 2.0, 1)]), path, 1)
    assert table(spark, path) == [("A", "2024-01-02", 2.0)]


def test_only_touched_months_are_read_and_written(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_prices(bars(spark, [("A", f"2024-{m:02}-02", 1.0, 0) for m in range(1, 7)]), path)
    upsert_prices(bars(spark, [("A", "2024-03-02", 5.0, 1)]), path)
    assert sorted(d for d in os.listdir(f"{path}/batch=1") if d.startswith("month")) == ["month=2024-03"]
    files = read_prices(spark, path, ["2024-03", "2024-04"]).inputFiles()
    assert sorted(f.split("/t/")[1].rsplit("/", 1)[0] for f in files) == ["batch=0/month=2024-04", "batch=1/month=2024-03"]
    assert store.drop_superseded(spark, path) == 1 and len(table(spark, path)) == 6
    assert table(spark, path, ["2024-03"]) == [("A", "2024-03-02", 5.0)] and table(spark, path, ["1999-01"]) == []


def test_rows_without_a_day_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not upsert_prices(bars(spark, []), path) and table(spark, path) == []
    odd = bars(spark, [("A", "2024-01-02", 1.0, 0)]).unionByName(bars(spark, [("B", "2024-01-02", 1.0, 0)]).selectExpr(*[("cast(null as date) as trade_date" if c == "trade_date" else c) for c in PRICES.replace(",", "").split()[::2]]))
    assert upsert_prices(odd, path) and table(spark, path) == [("A", "2024-01-02", 1.0)]


def test_a_stream_that_runs_a_batch_again_changes_nothing(spark, tmp_path):
    raw, path, marks = (str(tmp_path / x) for x in ("raw", "t", "marks"))
    os.makedirs(raw)
    row = {"symbol": "A", "trade_date": "2024-01-02", "close": 1, "_ingested_at": "2024-01-03T00:00:00Z"}
    with open(f"{raw}/price__1.jsonl", "w") as f:
        f.write(json.dumps(row) + "\n")
    ingest_stream(spark, raw, path, marks).awaitTermination()
    for name in os.listdir(f"{marks}/commits"):  # the stream died after the merge, before its own commit
        os.remove(f"{marks}/commits/{name}")
    ingest_stream(spark, raw, path, marks).awaitTermination()
    assert table(spark, path) == [("A", "2024-01-02", 1.0)] and store.committed(spark, path) == [0]


def test_universe_names_what_it_drops(spark):
    lists = spark.createDataFrame([(" a ", "sp500"), ("A", "wide"), ("b", "wide"), (None, "sp500"), (" ", "wide"), ("C", "wide"), ("C", "wide")], "symbol string, index_name string")
    known = spark.createDataFrame([("A",), ("A",), ("C",)], "symbol string")
    got = {r.symbol: (r.indexes, r.tier, r.reason) for r in payloads.judge_universe(lists, known).collect()}
    assert got == {"A": (["sp500", "wide"], "deep", None), "B": (["wide"], "wide", "no-price-bar"), "C": (["wide"], "wide", None), None: (["sp500", "wide"], "deep", "no-symbol")}
    assert {r.symbol for r in payloads.build_universe(lists, known).collect()} == {"A", "C"}


def test_shared_paths_differ(spark):
    a, b = store.shared_path(spark, "x"), store.shared_path(spark, "x")
    assert a != b and os.path.dirname(a) == os.path.dirname(b)
    with pytest.raises(Exception, match=".+"):
        spark.read.parquet(a).count()

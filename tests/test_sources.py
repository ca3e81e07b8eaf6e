import gzip
import json

from finquarry.sources import landing, payloads, staging
from finquarry.streaming.ingest import ingest_stream, read_prices, upsert_prices


def write(path, rows, zipped=False):
    with (gzip.open if zipped else open)(path, "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


BARS = [
    {"symbol": " aapl ", "trade_date": "2024-01-02", "close": "10", "adj_close": {"raw": 9.5}, "volume": {}, "_ingested_at": "2024-01-03T00:00:00Z", "_run_id": "1"},
    {"symbol": "AAPL", "trade_date": "2024-01-02", "close": 11, "_ingested_at": "2024-01-04T00:00:00Z"},
    {"symbol": "ZERO", "trade_date": "2024-01-02", "close": 0, "_ingested_at": "2024-01-04T00:00:00Z"},
    {"symbol": "MSFT", "trade_date": "2024-02-02", "close": 5, "_ingested_at": "2024-01-04T00:00:00Z"},
]


def test_landing_staging_and_stream(spark, tmp_path):
    raw = str(tmp_path / "raw")
    (tmp_path / "raw").mkdir()
    write(f"{raw}/price__1.jsonl.gz", BARS[:1], True)
    write(f"{raw}/price__2.jsonl", BARS[1:])
    assert landing.read_landing(spark, raw, "price").count() == 4
    assert landing.read_landing_or_empty(spark, raw, "split").count() == 0
    got = {(r.symbol, str(r.trade_date)): r.close for r in staging.stg_prices(landing.read_landing(spark, raw, "price")).collect()}
    assert got == {("AAPL", "2024-01-02"): 11.0, ("MSFT", "2024-02-02"): 5.0}
    batch, streamed = str(tmp_path / "batch"), str(tmp_path / "streamed")
    upsert_prices(staging.stg_prices(landing.read_landing(spark, raw, "price")), batch)
    ingest_stream(spark, raw, streamed, str(tmp_path / "ck")).awaitTermination()
    write(f"{raw}/price__3.jsonl", [{"symbol": "AAPL", "trade_date": "2024-01-02", "close": 12, "_ingested_at": "2024-01-05T00:00:00Z"}])
    ingest_stream(spark, raw, streamed, str(tmp_path / "ck")).awaitTermination()
    upsert_prices(staging.stg_prices(landing.read_landing(spark, raw, "price")), batch)
    table = lambda p: sorted((r.symbol, str(r.trade_date), r.close) for r in read_prices(spark, p).collect())
    assert table(batch) == table(streamed) == [("AAPL", "2024-01-02", 12.0), ("MSFT", "2024-02-02", 5.0)]


def test_sinks_append_and_replace(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0)], "symbol string, overall_score double")
    path = str(tmp_path / "scores")
    landing.export_score_history(df, path, "2024-01-01")
    landing.export_score_history(df.union(df), path, "2024-01-01")
    landing.export_score_history(df, path, "2024-01-02")
    assert spark.read.json(path).count() == 3
    landing.append_landing(spark.createDataFrame([("A", "2024-01-02", "1")], "symbol string, trade_date string, close string"), str(tmp_path), "price", "r1", "2024-01-03T00:00:00Z")
    assert landing.read_landing(spark, str(tmp_path), "price").first()._run_id == "r1"


def test_payloads(spark):
    chart = {"timestamp": [86400, 172800, 259200], "open": [1, 2, 3], "high": [1, 2, 3], "low": [1, 2, 3], "close": [1.0, None, 3.0], "adjclose": [0.5, None, None], "volume": [1, None, None]}
    bars = payloads.flatten_chart_payload(spark.createDataFrame([("A", json.dumps(chart))], "symbol string, payload string")).collect()
    assert [(r.close, r.adj_close, r.volume) for r in bars] == [(1.0, 0.5, 1), (3.0, 3.0, 0)]
    splits = payloads.flatten_split_events(spark.createDataFrame([("A", json.dumps({"1": {"date": 86400, "numerator": 4, "denominator": 1}, "2": {"date": 0, "numerator": 2, "denominator": 1}}))], "symbol string, payload string"))
    assert [r.ratio for r in splits.collect()] == [4.0]
    series = [("A", "annualTotalRevenue", "2024-12-31", 5.0), ("A", "annualEBITDA", "2024-12-31", 2.0), ("A", "quarterlyEBIT", "2024-12-31", 1.0)]
    rows = payloads.flatten_timeseries_payload(spark.createDataFrame(series, "symbol string, metric string, as_of string, value double")).collect()
    assert {(r.period_type, r.metric) for r in rows} == {("annual", "totalRevenue"), ("annual", "ebitda")}
    lists = spark.createDataFrame([("A", "sp500"), ("A", "nasdaq"), ("B", "nasdaq")], "symbol string, index_name string")
    assert {(r.symbol, r.tier) for r in payloads.build_universe(lists).collect()} == {("A", "deep"), ("B", "wide")}


def test_constituent_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Symbol,Name\nBRK.B,x\nbad symbol,y\nAAPL,z\n")
    assert {r.symbol for r in payloads.load_constituents_csv(spark, str(tmp_path / "a.csv")).collect()} == {"BRK-B", "AAPL"}
    (tmp_path / "b.txt").write_text("Symbol|Name|Test Issue|ETF\nAAPL|x|N|N\nQQQ|x|N|Y\nZTEST|x|Y|N\nFile Creation Time: 1|||\n")
    assert {r.symbol for r in payloads.load_constituents_pipe(spark, str(tmp_path / "b.txt")).collect()} == {"AAPL"}

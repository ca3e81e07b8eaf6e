import datetime as dt

from finquarry.operators import checks, core, history, portfolio, prices


def test_wallet_strings(spark):
    specs = [(1, "AAPL:10:150,MSFT:5::2024-01-02,AAPL:99"), (2, "AAPL:0,AAPL:-5,not a ticker:1"), (3, "AAPL:10:-3:2999-01-01,o:1:x:2024-02-30")]
    got = {(r.wallet_id, r.symbol): (r.shares, r.cost, r.bought_at) for r in portfolio.parse_wallet_strings(spark.createDataFrame(specs, "wallet_id int, spec string"), "2025-01-01").collect()}
    assert got == {(1, "AAPL"): (10.0, 150.0, None), (1, "MSFT"): (5.0, None, dt.date(2024, 1, 2)), (3, "AAPL"): (10.0, None, None), (3, "O"): (1.0, None, None)}


def test_ex_date_is_strict(spark):
    h = spark.createDataFrame([(1, "A", 10.0, dt.date(2024, 1, 15))], "wallet_id int, symbol string, shares double, bought_at date")
    d = spark.createDataFrame([("A", dt.date(2024, 1, 15), 1.0), ("A", dt.date(2024, 4, 15), 10.0), ("A", dt.date(2024, 7, 15), 1.0)], "symbol string, pay_date date, amount double")
    assert [r.income for r in portfolio.dividend_income(h, d, "2024-04-15").collect()] == [100.0]


def test_goal(spark):
    w = spark.createDataFrame([(1, 100_000.0, 3000.0)], "wallet_id int, value double, annual_income double")
    r = portfolio.income_goal(w, 30_000, 3).first()
    assert round(r.required_value) == 1_000_000 and round(r.progress_pct, 6) == 10 and round(r.yield_pct, 6) == 3


def test_reversion_is_kept_in_observations_mode(spark):
    rows = [("A", "annual", dt.date(2023, 12, 31), "m", v, dt.datetime(2024, 1, i + 1)) for i, v in enumerate([1.0, 1.0, 2.0, None, 1.0])]
    obs = spark.createDataFrame(rows, "symbol string, period_type string, period_end date, metric string, value double, ingested_at timestamp")
    assert history.financial_knowledge(obs).count() == 3
    assert [r.value for r in history.financial_knowledge(obs, "observations").orderBy("version_seq").collect()] == [1.0, 2.0, None, 1.0]


def test_missed_split_is_repaired(spark):
    closes = [100.0, 102.0, 51.0, 52.0]
    bars = spark.createDataFrame([("A", dt.date(2024, 1, i + 1), c, c) for i, c in enumerate(closes)], "symbol string, trade_date date, close double, adj_close double")
    splits = spark.createDataFrame([("A", dt.date(2024, 1, 3), 2.0)], "symbol string, split_date date, ratio double")
    corr = prices.split_corrections(bars, splits)
    fixed = prices.fct_prices(bars, corr)
    assert [r.adj_close for r in fixed.orderBy("trade_date").collect()] == [50.0, 51.0, 51.0, 52.0]
    assert checks.missed_splits_are_corrected(fixed, corr).count() == 0


def test_empty_tables(spark):
    bars = spark.createDataFrame([], "symbol string, trade_date date, open double, high double, low double, close double, volume long, adj_close double")
    assert core.month_end_history(bars).count() == 0 and prices.latest_prices(bars).count() == 0 and prices.merge_prices(bars, bars).count() == 0


def test_suite(spark):
    df = spark.createDataFrame([(1, None), (1, "b")], "k int, v string")
    report = checks.run_checks({"v": ("warn", lambda: checks.not_null(df, "v")), "k": ("error", lambda: checks.unique_combination(df, ["k"]))})
    assert {(r.check, r.offending) for r in report.collect()} == {("v", 1), ("k", 1)} and checks.build_fails(report)

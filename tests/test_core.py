from finquarry.operators import core
from finquarry.operators.portfolio import value_series
from finquarry.sources.payloads import resolve_previous_close


def test_previous_close_is_of_the_day_before(spark):
    rows = [
        ("stored wins", 11.0, 10.0, 2.0, 9.0, "max", "1mo", 10.0), ("one day", 11.0, None, 10.0, 9.0, "1d", "5m", 10.0), ("daily bars", 11.0, None, 2.0, 10.0, "6mo", "1d", 10.0),
        ("coarse bars", 11.0, None, 2.0, 9.0, "max", "1wk", None), ("one day, none known", 11.0, None, None, 9.0, "1d", "1d", None), ("zero", 11.0, 0.0, None, None, "1d", "1d", 0.0),
    ]
    df = spark.createDataFrame(rows, "name string, price double, stored_close double, chart_previous double, daily_previous double, range string, interval string, want double")
    for r in resolve_previous_close(df).collect():
        assert r.previous_close == r.want and r.change == (None if r.want is None else r.price - r.want) and r.change_pct == (r.change / r.want * 100 if r.want else None), r.name


def test_ties_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, "b", 7, {"x": 1}), (1, 5, "c", 3, {"x": 2}), (1, 4, "z", 9, {}), (2, None, "q", 1, None)], "k int, t int, _r string, _n int, m map<string,int>")
    for parts in (1, 4):
        got = {r.k: (r.t, r["_r"], r["_n"]) for r in core.latest_wins(df.repartition(parts), ["k"], ["t"]).collect()}
        assert got == {1: (5, "c", 3), 2: (None, "q", 1)}
    assert core.top_k(df.drop("m"), ["k"], ["t", "_r"], 1).columns == ["k", "t", "_r", "_n"] and core.downsample(df.drop("m"), "k", "_r", 2).count() == 3
    left = spark.createDataFrame([(1, 3, "a", "keep", 8)], "k int, at int, _v string, _t string, _side int")
    right = spark.createDataFrame([(1, 2, 20.0), (1, 4, 40.0)], "k int, day int, v double")
    assert [tuple(r) for r in core.asof_join(left, right, "k", "at", "day", ["v"]).collect()] == [(1, 3, "a", "keep", 8, 20.0)]


def test_value_does_not_depend_on_order(spark):
    holdings = spark.createDataFrame([(1, s, 0.1 * (s % 7 + 1), None) for s in range(200)], "wallet_id int, symbol int, shares double, bought_at date")
    prices = spark.sql("SELECT id % 200 AS symbol, DATE '2024-01-01' AS trade_date, id % 200 * 0.37 AS close FROM range(200)").selectExpr("int(symbol) symbol", "trade_date", "double(close) close")
    values = {value_series(holdings.repartition(p), prices.repartition(p)).first().value for p in (1, 3, 7)}
    assert len(values) == 1

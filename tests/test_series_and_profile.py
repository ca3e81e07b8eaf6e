"""Value series as an event sweep, and profiles, against worked figures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finquarry.operators import portfolio as P
from finquarry.operators import prices

HOLD = "wallet_id long, symbol string, shares double, bought_at date, quoted string"
BARS = "symbol string, trade_date date, close double, held int"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def frames(spark, holdings, bars):
    return spark.createDataFrame([(w, s, n, None if b is None else day(b), "x") for w, s, n, b in holdings], HOLD), spark.createDataFrame([(s, day(t), c, 0) for s, t, c in bars], BARS)


def test_each_holding_joins_when_bought_and_the_start_says_why(spark):
    h, b = frames(spark, [(1, "A", 10.0, None), (1, "B", 1.0, 2), (2, "A", 1.0, 1), (3, "B", 2.0, None), (4, "Z", 1.0, None)], [("A", 0, 10.0), ("A", 1, 11.0), ("A", 3, 12.0), ("B", 1, 100.0), ("B", 2, None), ("B", 4, 90.0)])
    got = sorted((r.wallet_id, (r.trade_date - day(0)).days, r.value, r.held) for r in P.value_series(h, b).collect())
    assert got == [(1, 0, 100.0, 1), (1, 1, 110.0, 1), (1, 3, 220.0, 2), (1, 4, 210.0, 2), (2, 1, 11.0, 1), (2, 3, 12.0, 1), (3, 1, 200.0, 1), (3, 4, 180.0, 1)]
    start = {r.wallet_id: (r.started_at, r.start_reason, r.first_purchase, r.points) for r in P.series_start(h, b).collect()}
    assert start == {1: (day(0), "coverage", day(2), 4), 2: (day(1), "purchase", day(1), 2), 3: (day(1), "coverage", None, 2), 4: (None, None, None, 0)}
    assert [(r.wallet_id, r.symbol, r.joined_at) for r in P.series_contributions(h, b).collect()] == [(1, "B", day(2))]
    assert {(r.wallet_id, r.symbol): r.priced for r in P.series_coverage(h, b).collect()} == {(1, "A"): True, (1, "B"): True, (2, "A"): True, (3, "B"): True, (4, "Z"): False}


def test_dates_are_withheld_until_every_held_symbol_has_a_price(spark):
    h, b = frames(spark, [(1, "A", 1.0, 0), (1, "B", 1.0, 1)], [("A", 0, 1.0), ("A", 2, 2.0), ("A", 5, 3.0), ("B", 4, 7.0)])
    assert sorted((r.trade_date, r.value) for r in P.value_series(h, b).collect()) == [(day(0), 1.0), (day(4), 9.0), (day(5), 10.0)]


def test_random_wallets_equal_a_walk_over_all_dates(spark):
    rng = random.Random(2)
    bars = [(s, t, rng.choice([1.25, 2.5, 3.1, 4.07])) for s in "ABCDE" for t in sorted(rng.sample(range(40), 12))]
    holdings = [(w, s, rng.choice([1.0, 2.5, 3.0]), rng.choice([None, *range(-3, 30)])) for w in range(12) for s in rng.sample("ABCDEX", 3)]
    want = []
    for w in range(12):
        mine = [x for x in holdings if x[0] == w and x[1] != "X"]
        for t in sorted({b[1] for b in bars if b[0] in {x[1] for x in mine}}):
            held = [x for x in mine if x[3] is None or x[3] <= t]
            last = [max(((u, c) for s, u, c in bars if s == x[1] and u <= t), default=None) for x in held]
            if held and all(last):
                want.append((w, t, pytest.approx(sum(x[2] * c[1] for x, c in zip(held, last))), len(held)))
    h, b = frames(spark, holdings, bars)
    assert sorted((r.wallet_id, (r.trade_date - day(0)).days, r.value, r.held) for r in P.value_series(h, b).collect()) == want


def test_empty_wallets_and_bars(spark):
    h, b = frames(spark, [(1, "A", 1.0, 0)], [])
    assert P.value_series(h, b).collect() == [] and P.value_series(h.limit(0), b).collect() == []
    assert P.series_start(h, b).first().points == 0


def test_returns_are_cut_at_contributions_and_annualised_over_a_year(spark):
    rows = [(1, 0, 100.0, 1), (1, 100, 110.0, 1), (1, 101, 210.0, 2), (1, 731, 231.0, 2), (2, 0, 50.0, 1), (2, 30, 55.0, 1), (3, 0, 1.0, 1), (4, 0, 0.0, 1), (4, 9, 5.0, 1)]
    got = {r.wallet_id: r for r in P.time_weighted_return(spark.createDataFrame([(w, day(t), v, n) for w, t, v, n in rows], "wallet_id long, trade_date date, value double, held long")).collect()}
    assert set(got) == {1, 2}
    assert got[1].twr_pct == pytest.approx(21.0) and got[1].segments == 2 and got[1].annualised_pct == pytest.approx(((1.21) ** (365.25 / 731) - 1) * 100)
    assert got[2].twr_pct == pytest.approx(10.0) and got[2].annualised_pct is None


def test_profiles_leave_out_what_is_not_known(spark):
    fields = {"symbol": 1, "industry": "REIT - Office", "market_cap": 1000.0, "enterprise_value": 1200.0, "ebitda": 100.0, "trailing_pe": 9.0, "gross_margin": 0.25, "dividend_yield_pct": None, "dividend_rate": None, "payout_ratio": 0.5, "ex_dividend_epoch": 86_400, "five_year_avg_dividend_yield_pct": 3.0, "beta": float("nan"), "return_on_equity_pct": 12.0}
    schema = ", ".join(f"{k} {'long' if k in ('symbol', 'ex_dividend_epoch') else 'string' if k == 'industry' else 'double'}" for k in fields)
    bundle = spark.createDataFrame([tuple(fields.values()), tuple((fields | {"symbol": 2, "industry": None, "ebitda": 0.0, "dividend_rate": 1.5}).values())], schema)
    got = {(r.symbol, r.label): r for r in prices.profile_metrics(bundle).collect()}
    assert (1, "Ex-dividend date") not in got and (1, "Payout ratio") not in got and (1, "Beta (5Y monthly)") not in got
    assert (got[2, "Ex-dividend date"].day, got[2, "Payout ratio"].value, got[2, "Annual dividend"].value) == (dt.date(1970, 1, 2), 50.0, 1.5)
    assert got[1, "EV / EBITDA"].value == 12.0 and (2, "EV / EBITDA") not in got
    assert got[1, "Gross margin"].value == 25.0 and got[1, "Return on equity"].value == 12.0 and got[1, "Gross margin"].kind == "percent"
    assert not got[1, "P/E (TTM)"].comparable and got[2, "P/E (TTM)"].comparable
    assert sum(map(len, prices.PROFILE.values())) == 38 and {r.place for r in got.values()} <= set(range(1, 39))


def test_bundle_of_a_company_without_bars_or_statements(spark):
    dim = spark.createDataFrame([(1, "i", 10.0, 2.0)], "symbol long, industry string, market_cap double, dividend_yield_pct double")
    none = lambda s: spark.createDataFrame([], s)
    lines = "totalrevenue netincome operatingincome ebitda freecashflow totaldebt cashandcashequivalents totalassets stockholdersequity dilutedaverageshares dilutedeps cashdividendspaid".split()
    b = prices.security_bundle(none("symbol long, trade_date date, open double, high double, low double, close double, volume long"), dim, none(f"symbol long, period_type string, period_end date, recency_rank long, {', '.join(f'{c} double' for c in lines)}"), none("symbol long, pays_dividend boolean"), "2024-01-31")
    r = b.first()
    assert r.close is None and r.enterprise_value is None and r.gross_margin is None and r.dividend_rate is None
    assert [x.label for x in prices.profile_metrics(b).select("label", F.col("place")).orderBy("place").collect()] == ["Market cap", "Dividend yield"]

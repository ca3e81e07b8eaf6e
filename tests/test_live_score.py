"""The on-line score against worked figures, and its running states against plain loops over whole histories."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finquarry.functions.columns import cagr_series, pick
from finquarry.operators import live_score as L
from finquarry.operators.statements import METRICS

WIDE = f"symbol long, period_type string, period_end date, {', '.join(f'{m} double' for m in METRICS)}, note string"
DIM = "symbol long, name string, sector string, industry string, market_cap double, trailing_pe double, dividend_yield_pct double, five_year_avg_dividend_yield_pct double, return_on_equity_pct double"
DIV = "symbol long, pay_date date, amount double, t string"


def statement(symbol, kind, end, **values):
    return (symbol, kind, dt.date.fromisoformat(end), *[values.get(m) for m in METRICS], "x")


def plain_totals(payments):
    """Yearly totals of (date, amount), newest first, as a loop over the whole record."""
    gaps = sorted((b[0] - a[0]).days for a, b in zip(payments, payments[1:]))
    if not gaps or not gaps[len(gaps) // 2]:
        return []
    p = max(1, min(12, int(365.25 / gaps[len(gaps) // 2] + 0.5)))
    return [sum(a for _, a in payments[len(payments) - k * p : len(payments) - (k - 1) * p]) for k in range(1, 12) if k * p <= len(payments)]


def test_dividend_states_equal_loops_over_all_payments(spark):
    rng = random.Random(8)
    rows, day = [], {}
    for symbol, gap in enumerate((7, 30, 60, 91, 182, 365, 900)):
        day[symbol], amount = dt.date(1990, 1, 1), 1.0
        for _ in range(rng.randint(100, 160) if gap < 100 else 25):
            rows.append((symbol, day[symbol], round(amount, 3), "clash"))
            day[symbol] += dt.timedelta(days=max(1, int(rng.gauss(gap, gap / 4))))
            amount *= rng.choice([1.0, 1.05, 1.1, 0.97, 1.3])
    rows += [(50, dt.date(2000, 1, 1), 1.0, "one payment only"), (51, dt.date(2000, 1, 1), 1.0, "same day"), (51, dt.date(2000, 1, 1), 2.0, "same day")]
    got = {(r.symbol, r.payments): r for r in L.dividend_states(spark.createDataFrame(rows, DIV)).collect()}
    assert len(got) == len(rows)
    for symbol in {r[0] for r in rows if r[0] < 50}:
        mine = [(d, a) for s, d, a, _ in rows if s == symbol]
        for n in range(1, len(mine) + 1):
            t, r = plain_totals(mine[:n]), got[symbol, n]
            streak = next((k for k in range(len(t) - 1) if not t[k] > t[k + 1] * 1.001), max(0, len(t) - 1))
            assert (r.streak, r.totals_compared) == (streak, max(0, len(t) - 1)), (symbol, n)
            last = min(6, len(t)) - 1
            assert r.dividend_cagr_pct == (pytest.approx(((t[0] / t[last]) ** (1 / last) - 1) * 100) if last > 0 else None)
            assert float(r.paid) == pytest.approx(sum(a for _, a in mine[:n]))
    assert got[51, 2].totals_compared == 0 and got[50, 1].dividend_cagr_pct is None


def test_trailing_quarters_add_up_and_balances_do_not(spark):
    ends = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2025-03-31"]
    wide = spark.createDataFrame([statement(1, "quarterly", e, totalrevenue=100.0 + 10 * k, netincome=10.0 + k, totaldebt=500.0 + 25 * k, ebit=None if k == 2 else 5.0) for k, e in enumerate(ends)], WIDE)
    s = {str(r.period_end): r for r in L.statement_states(wide).collect()}
    r = s["2024-12-31"]
    assert (r.totalrevenue, r.netincome, r.totaldebt, r.ebit, r.quarters_used) == (460.0, 46.0, 575.0, None, 4)
    assert (s["2024-03-31"].totalrevenue, s["2024-06-30"].ebit, s["2024-06-30"].quarters_used) == (400.0, 20.0, 2)
    assert [s[e].statement_periods for e in ends] == [1, 1, 1, 1, 2] and s["2025-03-31"].revenue_values == [400.0, 500.0]
    assert [s[e].newest for e in ends] == [False] * 4 + [True] and str(s["2024-03-31"].window_start) == "2023-12-31"


def test_pillars_of_a_reit_and_of_a_company_without_dividends(spark):
    base = {"totalrevenue": 100.0, "netincome": 10.0, "operatingincome": 30.0, "ebitda": 50.0, "ebit": 20.0, "depreciationandamortization": 30.0, "freecashflow": 5.0, "operatingcashflow": 50.0, "cashdividendspaid": -40.0, "totaldebt": 300.0, "cashandcashequivalents": None, "totalassets": 1000.0, "interestexpense": -5.0, "dilutedaverageshares": 10.0, "dilutedeps": 1.0}
    wide = spark.createDataFrame([statement(k, "annual", e, **base) for k in (1, 2) for e in ("2023-12-31", "2024-12-31")] + [statement(3, "annual", "2024-12-31"), statement(4, "quarterly", "2024-12-31", **base)], WIDE)
    dim = spark.createDataFrame([(1, "a", "s", " reit - Office", 600.0, 9.0, 5.0, None, 12.0), (2, "b", "s", "Reitman Stores", 600.0, None, 0.1, 2.0, 15.0), (3, "c", None, None, None, None, None, None, None), (4, "d", "s", "i", 1.0, 1.0, 1.0, 1.0, 1.0)], DIM)
    scored = L.quality_score_live(dim, wide, spark.createDataFrame([], DIV))
    got = {r.symbol: r for r in scored.collect()}
    assert set(got) == {1, 2, 3}
    reit = {m.label: m for p in got[1].pillars for m in p.metrics}
    assert got[1].scoring_basis == "reit" and reit["Interest coverage"].value == 10.0 and reit["Interest coverage"].score == 100
    assert (reit["Payout / cash flow"].value, reit["Payout / cash flow"].of, reit["P / FFO"].value) == (80.0, 2, 15.0)
    assert reit["FFO yield"].value == pytest.approx(100 / 15) and (reit["Years of consecutive raises"].value, reit["Years of consecutive raises"].of) == (0.0, 0)
    other = {m.label: m for p in got[2].pillars for m in p.metrics}
    assert got[2].scoring_basis == "standard" and other["Payout / free cash flow"].value == 800.0  # paid out, so a dividend however small
    assert other["Net debt / EBITDA"].value == 6.0 and other["P / E (TTM)"].score is None and "Free cash flow yield" in other
    assert [p.title for p in got[2].pillars] == list(L.WEIGHTS) and got[3].overall_score is None and got[3].coverage_pct == 0.0
    details = L.pillar_details(scored, ["symbol"])
    assert details.count() == 36 and details.filter("symbol = 3 and score is not null").count() == 0
    assert {r.figure: r.value for r in L.key_figures(scored, ["symbol"]).filter("symbol = 1").collect()} == {"FFO (last FY)": 40.0, "FFO / share": 4.0, "P / FFO": 15.0, "Cash flow payout": 80.0}


def test_thin_history_counts_statements_and_quarters(spark):
    df = spark.createDataFrame([(2, None), (3, None), (3, 3), (3, 4)], "statement_periods long, quarters_used long")
    assert [r[0] for r in df.select(L.thin_history()).collect()] == [True, False, True, False]


def test_growth_over_known_values_only(spark):
    df = spark.createDataFrame([([100.0, None, 121.0],), ([None, 5.0],), ([-1.0, 5.0],), ([4.0, 0.0],), ([],)], "v array<double>")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(cagr_series("v")).collect()] == [21.0, None, None, None, None]
    assert spark.range(1).select(pick(F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0))).first()[0] == 2.0


def test_empty_tables(spark):
    none = L.score_timeline(spark.createDataFrame([], WIDE), spark.createDataFrame([], DIM), spark.createDataFrame([], DIV), spark.createDataFrame([], "symbol long, t date, close double, adj_close double"))
    assert none.collect() == [] and none.schema["pillars"].dataType.simpleString().startswith("array<struct<title:string,score:double,metrics:array<struct<label:string,value:double")


def test_as_of_equals_loops_over_all_events(spark):
    rng = random.Random(4)
    day = lambda y, n: dt.date(y, 1, 1) + dt.timedelta(days=n)
    ends = [(k, e) for k in ("annual", "quarterly") for e in sorted({day(2000, rng.randrange(1500)) for _ in range(9)})]
    wide = spark.createDataFrame([statement(1, k, str(e), totalrevenue=1.0) for k, e in ends], WIDE)
    paid = [(1, d, float(rng.randint(1, 9)), "") for d in sorted({day(1998, rng.randrange(2200)) for _ in range(40)} | {e - dt.timedelta(days=365) for _, e in ends[:3]})]
    quotes = [(1, d, float(k + 1), float(k + 2)) for k, d in enumerate(sorted({day(1999, rng.randrange(1800)) for _ in range(30)} | {ends[2][1]}))]
    points = L.statement_states(wide)
    got = L._as_of(points, spark.createDataFrame(paid, DIV), spark.createDataFrame(quotes, "symbol long, t date, close double, adj_close double")).collect()
    assert sorted((r.period_type, r.period_end) for r in got) == ends
    for r in got:
        close = lambda t: next((q for q in reversed(quotes) if q[1] <= t), (None,) * 4)
        assert (r.quoted_on, r.price, r.adj_now) == close(r.period_end)[1:] and (r.quoted_before, r.adj_before) == (close(r.window_start)[1], close(r.window_start)[3])
        year = [a for _, d, a, _ in paid if r.period_end - dt.timedelta(days=365) < d <= r.period_end]
        assert (r.paid_1y or 0.0) == sum(year)

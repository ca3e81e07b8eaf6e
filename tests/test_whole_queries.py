"""Queries that do a whole job where an older query of the registry does a part."""

import os

import pytest
from pyspark.sql import functions as F

from finquarry.plans import registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
def test_all_holdings_are_compared_from_one_start(spark):
    out = registry.queries()["compare_rebased_all"](spark, SF)
    t = registry.Tables(spark, SF)
    firsts = t.prices().groupBy("symbol").agg(F.min("trade_date").alias("first"))
    start = firsts.agg(F.max("first")).first()[0]
    want = t.prices().filter(F.col("trade_date") >= start).groupBy("symbol").count().filter("count >= 2")
    got = {r.symbol for r in out.collect()}
    assert got == {r.symbol for r in want.collect()} and any(s % 5 for s in got)


def test_timeline_has_quarters_and_takes_market_values_as_of_then(spark):
    from finquarry.operators import core, live_score
    from finquarry.operators.statements import METRICS

    ends = ["2022-03-31", "2022-06-30", "2022-09-30", "2022-12-31", "2023-03-31"]
    kinds = [("quarterly", e) for e in ends] + [("annual", "2021-12-31"), ("annual", "2022-12-31")]
    amount = dict.fromkeys(METRICS, 10.0) | {"totalrevenue": 100.0, "operatingincome": 20.0, "dilutedaverageshares": 1000.0, "dilutedeps": 2.0, "stockholdersequity": 200.0, "cashdividendspaid": -4.0}
    wide = spark.createDataFrame([(1, k, e, *amount.values()) for k, e in kinds], f"symbol long, period_type string, period_end string, {', '.join(f'{m} double' for m in amount)}").withColumn("period_end", F.to_date("period_end"))
    dim = spark.createDataFrame([(1, "i", 9e9, 1.0)], "symbol long, industry string, market_cap double, trailing_pe double")
    div = spark.createDataFrame([(1, "2022-05-10", 1.0), (1, "2023-02-10", 1.0)], "symbol long, pay_date string, amount double").withColumn("pay_date", F.to_date("pay_date"))
    bars = spark.createDataFrame([(1, d, c, c) for d, c in (("2022-03-30", 20.0), ("2022-06-30", 25.0), ("2022-12-30", 40.0), ("2023-03-31", 50.0))], "symbol long, trade_date string, close double, adj_close double").withColumn("trade_date", F.to_date("trade_date"))
    got = {(r.period_type, str(r.period)): r for r in live_score.score_timeline(wide, dim, div, core.month_end_history(bars)).collect()}
    assert set(got) == set(kinds)
    assert got["annual", "2021-12-31"].unscored == "no price history at this date" and got["annual", "2021-12-31"].overall_score is None
    q = [got["quarterly", e] for e in ends]
    assert [r.quarters_used for r in q] == [1, 2, 3, 4, 4] and [r.statement_periods for r in q] == [1, 1, 1, 1, 2]
    assert [r.price for r in q] == [20.0, 25.0, 25.0, 40.0, 50.0] and all(r.overall_score is not None and r.unscored is None for r in q)
    assert [r.period_return and round(r.period_return, 6) for r in q] == [None, 25.0, None, 60.0, 25.0]
    assert got["annual", "2022-12-31"].statement_periods == 2 and got["annual", "2022-12-31"].quarters_used is None
    points = live_score._as_of(live_score.statement_states(wide.filter("period_type = 'annual'")), div, core.month_end_history(bars))
    then = live_score.summary_as_at(points, dim).filter("period_end = '2022-12-31'").first()
    assert (then.market_cap, then.trailing_pe, then.return_on_equity_pct, then.dividend_yield_pct) == (40_000.0, 20.0, 5.0, 2.5)


def test_bundle_ranges_over_one_year_and_has_ratios(spark):
    from finquarry.operators import prices

    bars = spark.createDataFrame([(1, d, c, c + 1, c - 1, c, 10) for d, c in (("2022-01-03", 900.0), ("2023-06-01", 40.0), ("2024-01-30", 50.0), ("2024-02-01", 700.0))], "symbol long, trade_date string, open double, high double, low double, close double, volume long").withColumn("trade_date", F.to_date("trade_date"))
    dim = spark.createDataFrame([(1, "n", "s", "i", "USD", 1000.0, 9.0, 2.0)], "symbol long, name string, sector string, industry string, currency string, market_cap double, trailing_pe double, dividend_yield_pct double")
    lines = "totalrevenue netincome operatingincome ebitda freecashflow totaldebt cashandcashequivalents totalassets stockholdersequity dilutedaverageshares dilutedeps cashdividendspaid".split()
    fin = spark.createDataFrame([(1, "annual", y, r, *([v] * len(lines))) for y, r, v in (("2022-12-31", 2, 80.0), ("2023-12-31", 1, 100.0))], f"symbol long, period_type string, period_end string, recency_rank long, {', '.join(f'{c} double' for c in lines)}")
    r = prices.security_bundle(bars, dim, fin, spark.createDataFrame([(1, True)], "symbol long, pays_dividend boolean"), "2024-01-31").first()
    assert (r.close, r.high_52w, r.low_52w, r.close_1y_ago, r.change_52w) == (50.0, 51.0, 39.0, 40.0, 0.25)
    assert (r.enterprise_value, r.price_to_sales, r.debt_to_equity, r.dividend_rate, r.revenue_growth) == (1000.0, 10.0, 100.0, 1.0, 0.25)


@needs_tables
def test_timelines_read_month_ends_and_payments_that_they_need(spark):
    from finquarry.operators import core

    t = registry.Tables(spark, SF)
    want, got = core.month_end_history(t.old_bars), t.old_month_ends
    assert got.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = lambda name: registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Interest coverage" not in plan("score_timeline_pillars")  # metrics are not made for pillars alone
    for name in ("score_timeline", "score_timeline_points", "score_timeline_pillars"):
        assert "LeftSemi" in plan(name)


@needs_tables
def test_score_months_lay_out_only_scores_of_what_is_held_and_sort_no_lines(spark):
    plan = registry.queries()["portfolio_score_months"](spark, SF)._jdf.queryExecution()
    assert "LeftSemi" in plan.optimizedPlan().toString()
    closes = registry.Tables(spark, SF).old_month_ends._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in closes and "SortAggregate" not in closes

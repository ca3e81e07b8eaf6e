"""Goals, plans, score series, facets, ranges and shared-scan checks against worked figures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finquarry.operators import checks, dividends, portfolio, prices, scoring, statements, studies


def day(text):
    return dt.date.fromisoformat(text)


def test_a_goal_splits_the_withdrawal(spark):
    w = spark.createDataFrame([(1, 500_000.0, 6_000.0, 250_000.0, day("2020-01-01"), 0), (2, 2_000_000.0, 90_000.0, 1.0, day("2020-01-01"), 3), (3, 0.0, 1.0, None, None, 0), (4, None, None, None, None, None), (5, 10.0, None, None, None, 0)], "wallet_id int, value double, annual_income double, start_value double, started_at date, contributions int")
    got = {r.wallet_id: r for r in portfolio.income_goal(w, 30_000, 3, "2024-01-01").collect()}
    a = got[1]
    assert (a.required_value, a.progress_pct, a.yield_pct, a.shortfall) == pytest.approx((1_000_000, 50, 1.2, 500_000))
    assert (a.withdrawal_today, a.from_dividends_today, a.from_sales_today, a.withdrawal_at_target, a.from_sales_at_target) == pytest.approx((15_000, 6_000, 9_000, 30_000, 18_000))
    assert a.covered_pct == pytest.approx(40) and a.value_for_dividends_alone == pytest.approx(2_500_000) and a.grew_by_pct == pytest.approx(100)
    assert a.annualised_pct == pytest.approx((2 ** (1 / (1461 / 365.25)) - 1) * 100)
    assert got[2].progress_pct == 100 and got[2].shortfall == 0 and got[2].surplus_today == pytest.approx(30_000) and got[2].annualised_pct is None
    for k in (3, 4):
        assert got[k].reason == "no-value" and got[k].progress_pct is None and got[k].shortfall is None and got[k].from_sales_today is None
    assert got[5].yield_pct == 0 and got[5].value_for_dividends_alone is None and got[5].grew_by_pct is None
    with pytest.raises(ValueError):
        portfolio.income_goal(w, 0, 3)


def test_contributions_compound_by_their_period(spark):
    w = spark.createDataFrame([(1, 100_000.0), (2, 900_000.0), (3, -1.0), (4, 0.0)], "wallet_id int, value double")
    got = {r.wallet_id: r for r in portfolio.required_contribution(w, 1e6, 10, 5.0).collect()}
    grown, r, m = 100_000 * 1.05**10, 0.05, 1.05 ** (1 / 12) - 1
    assert got[1].per_year == pytest.approx((1e6 - grown) * r / (1.05**10 - 1)) and got[1].per_month == pytest.approx((1e6 - grown) * m / (1.05**10 - 1)) and got[1].per_month < got[1].per_year / 12
    assert got[2].already_there and got[2].per_year == got[2].per_month == 0 and got[3].per_year is None
    flat = {r.wallet_id: r for r in portfolio.required_contribution(w, 1e6, 10, 0.0).collect()}
    assert flat[1].per_year == pytest.approx(90_000) and flat[1].per_month == pytest.approx(7_500)


def test_the_plan_says_where_its_return_comes_from(spark):
    w = spark.createDataFrame([(1, 1e5, 3e3, 2.0), (2, 1e5, 0.0, None), (3, None, 1.0, 1.0)], "wallet_id int, value double, annual_income double, measured_pct double")
    got = {r.wallet_id: r for r in portfolio.contribution_plan(w, 1e6, 20).collect()}
    assert (got[1].return_source, round(got[1].return_pct, 9)) == ("measured", 5.0) and (got[2].return_source, got[2].return_pct) == ("assumed", 7.0)
    assert got[1].per_year_spent > got[1].per_year_reinvested and got[1].extra_per_month > 0 and got[2].extra_per_year == 0 and got[3].extra_per_year is None
    assert portfolio.contribution_plan(w, 1e6, 20, 6.0).first().return_source == "set"


def test_scores_of_a_wallet_are_weighted_by_value(spark):
    h = spark.createDataFrame([(1, "A", 10.0, None), (1, "B", 1.0, day("2024-02-15")), (1, "U", 5.0, None), (2, "B", 1.0, day("2030-01-01"))], "wallet_id int, symbol string, shares double, bought_at date")
    closes = spark.createDataFrame([("A", day("2024-01-31"), 10.0), ("A", day("2024-02-29"), 20.0), ("A", day("2024-03-29"), 20.0), ("B", day("2024-01-31"), 50.0), ("B", day("2024-03-29"), 100.0), ("U", day("2024-02-29"), 20.0)], "symbol string, t date, close double")
    scores = spark.createDataFrame([("A", day("2024-01-01"), 50.0), ("A", day("2024-03-10"), 70.0), ("B", day("2024-02-01"), 90.0), ("B", day("2024-03-30"), 1.0), ("A", day("2024-02-02"), None)], "symbol string, period date, overall_score double")
    got = {str(r.t): (r.score, r.coverage_pct) for r in portfolio.portfolio_score_series(h, closes, scores).collect()}
    assert set(got) == {"2024-01-31", "2024-02-29", "2024-03-29"}
    assert got["2024-01-31"] == pytest.approx((50.0, 100.0))
    assert got["2024-02-29"] == pytest.approx(((200 * 50 + 50 * 90) / 250, 250 / 350 * 100))
    assert got["2024-03-29"] == pytest.approx(((200 * 70 + 100 * 90) / 300, 75.0))


def test_facets_keep_what_they_fold(spark):
    rows = [(1, f"S{k}", None if k == 7 else f"f{k}", 100.0 - k, 0) for k in range(8)] + [(1, "S8", "f0", 1.0, 0), (1, "bad", "f1", -5.0, 0), (2, "X", "f", 1.0, 0)]
    got = {(r.wallet_id, r.label): r for r in portfolio.group_by_facet(spark.createDataFrame(rows, "wallet_id int, symbol string, facet string, value double, rank int"), "facet").collect()}
    other = got[1, "Other"]
    assert len(got) == 7 and other.folded == 3 and other.folded_labels == ["f5", "f6", "Unclassified"] and other.symbols == ["S5", "S6", "S7"]
    assert got[1, "f0"].symbols == ["S0", "S8"] and got[1, "f0"].folded_labels is None and got[2, "f"].share_pct == 100


def test_ranges_and_years(spark):
    bars = spark.createDataFrame([("A", day(d), c, c) for d, c in (("2019-06-03", 1.0), ("2023-12-29", 2.0), ("2024-01-02", 3.0), ("2024-03-01", 4.0), ("2024-03-28", 5.0), ("2024-05-01", 9.0))], "symbol string, trade_date date, close double, adj_close double")
    at = lambda r: sorted(x.close for x in prices.chart_range(bars, r, "2024-03-31").collect())
    assert at("1mo") == [4.0, 5.0] and at("ytd") == [3.0, 4.0, 5.0] and at("1y") == [2.0, 3.0, 4.0, 5.0] and at("5y") == [1.0, 2.0, 3.0, 4.0, 5.0] and at("max") == [1.0, 2.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        prices.chart_range(bars, "1d", "2024-03-31")
    div = spark.createDataFrame([("A", day(f"{y}-05-05"), 0.1) for y in range(2000, 2025)] + [("A", day("2024-02-02"), 0.2)], "symbol string, pay_date date, amount double")
    got = sorted((r.year, r.amount, r.partial) for r in dividends.dividends_by_year(div, "2024-06-01").collect())
    assert len(got) == 12 and got[-1] == (2024, 0.3, True) and got[0] == (2013, 0.1, False)


def test_many_rules_take_one_scan_a_table(spark, tmp_path):
    spark.createDataFrame([(1, 5.0, "a"), (1, None, "b"), (2, -1.0, "c"), (None, 0.0, None)], "k int, v double, n string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    R = checks.Rule
    rules = [R("v_known", F.col("v").isNull()), R("v_positive", F.col("v") <= 0, "warn"), R("k_unique", unique=("k",)), R("n_unique", unique=("n",))]
    empty = spark.createDataFrame([], "k int")
    report = checks.check_tables({"t": (df, rules), "none": (empty, [R("nothing", F.col("k") > 0), R("none_twice", unique=("k",))])}, {"other": ("warn", df.filter("n = 'a'"))})
    assert {(r.check, r.severity, r.offending) for r in report.collect()} == {("v_known", "error", 1), ("v_positive", "warn", 2), ("k_unique", "error", 1), ("n_unique", "error", 0), ("nothing", "error", 0), ("none_twice", "error", 0), ("other", "warn", 1)}
    one = checks.check_tables({"t": (df, rules[:3])})
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert checks.build_fails(report)


def test_grades_and_windows(spark):
    bars = spark.createDataFrame([(s, day(d), c) for s, c1, c2 in (("A", 10.0, 20.0), ("B", 10.0, 5.0), ("C", 10.0, 11.0)) for d, c in (("2020-01-02", c1), ("2024-01-02", c2))] + [("D", day("2023-06-01"), 1.0)], "symbol string, trade_date date, adj_close double")
    timeline = spark.createDataFrame([("A", day("2019-12-31"), "A+"), ("A", day("2023-01-01"), "F"), ("B", day("2020-01-01"), "C"), ("C", day("2021-01-01"), "B")], "symbol string, period date, grade string")
    windows = {"4y": ("2020-01-01", 4.0), "1y": ("2023-01-01", 1.0), "30y": ("1994-01-01", 30.0)}
    grades, out = studies.grade_study_tables(bars, timeline, windows, least=3)
    w = {r.window: r for r in out.collect()}
    assert w["4y"].available and w["4y"].covered == 3 and w["4y"].universe_mean == pytest.approx(20) and (w["4y"].top_grade, w["4y"].bottom_grade, w["4y"].spread) == ("A+", "C", pytest.approx(150))
    assert not w["1y"].available and w["1y"].reason == "price history does not reach back this far" and w["30y"].universe_mean is None
    g = {(r.window, r.grade): r for r in grades.collect()}
    assert set(g) == {("4y", "A+"), ("4y", "C")} and g["4y", "A+"].best == "A" and g["4y", "A+"].annualised == pytest.approx((2**0.25 - 1) * 100)
    nobody = studies.grade_study_tables(bars, timeline, windows, spark.createDataFrame([], "symbol string, grade string"), least=3)[1]
    assert {r.reason for r in nobody.filter("window = '4y'").collect()} == {"no company could be graded as at this date"}


def test_map_has_three_levels_and_folds_small_tiles(spark):
    bars = spark.createDataFrame([(s, day(d), c, 1) for s, c in ((1, 2.0), (2, 3.0), (3, 4.0)) for d, c in (("2024-01-01", 1.0), ("2024-01-02", c))], "symbol int, trade_date date, close double, volume int")
    dim = spark.createDataFrame([(1, "a", "x", 100.0), (2, "b", "x", 300.0), (3, "c", None, 50.0), (4, "no bar", "x", 9.0), (1, "no cap", "x", 0.0)], "symbol int, name string, sector string, market_cap double")
    got = prices.market_map_tree(bars, dim, spark.createDataFrame([(2, "A")], "symbol int, grade string"), 1).collect()
    level = {(r.level, r.sector, r.symbol): r for r in got}
    assert len(got) == 6 and level["total", None, None].market_cap == 450 and level["sector", "x", None].change_pct == pytest.approx(175) and level["tile", "Unclassified", 3].companies == 1
    x = level["sector", "x", None]
    assert [(c.symbol, c.grade) for c in x.children] == [(2, "A")] and x.folded == 1 and x.companies == 2


def test_tracked_symbols(spark):
    asked = spark.createDataFrame([("A",), ("A",), ("Z",), (None,)], "symbol string")
    dim = spark.createDataFrame([("A", "a"), ("B", "b")], "symbol string, name string")
    assert {r.symbol: r.tracked for r in scoring.is_tracked(asked, dim).collect()} == {"A": True, "Z": False, None: False}
    assert [tuple(r) for r in scoring.names_for(asked, dim).collect()] == [("A", "a")]


def test_reached_percent_goes_on_beyond_the_goal(spark):
    w = spark.createDataFrame([(1, 2_500_000.0, 0.0), (2, 500_000.0, 0.0), (3, 0.0, 0.0)], "wallet_id int, value double, annual_income double")
    got = {r.wallet_id: (r.progress_pct, r.reached_pct) for r in portfolio.income_goal(w, 30_000, 3).collect()}
    assert got == {1: (100.0, 250.0), 2: (50.0, 50.0), 3: (None, None)}


def test_checks_read_their_rows_once(spark):
    """Before, the dividend record was built for payments and again for years, and statements were melted to a row a metric."""
    pays = [(1, y) for y in (1990, 1991, 1993)] + [(2, y) for y in (1990, 1990, 1991)] + [(3, 1990), (3, 1995)] + [(None, y) for y in (1990, 1991, 1993)]
    record = checks.dividend_record_not_truncated(spark.createDataFrame(pays, "symbol long, calendar_year long"), 3)
    assert [tuple(r) for r in record.collect()] == [(1, 3)]
    plan = record._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    nan = float("nan")
    rows = [(1, "annual", "2020-12-31", 1.0, -2.0), (1, "annual", "2021-12-31", None, None), (2, "annual", "2020-12-31", 3.0, nan), (3, "annual", "2020-12-31", None, nan), (4, "annual", "2020-12-31", 1.0, None), (None, "annual", "2020-12-31", 1.0, 1.0)]
    wide = spark.createDataFrame(rows, "symbol long, period_type string, period_end string, totalrevenue double, capitalexpenditure double")
    dim = spark.createDataFrame([(1, True), (1, True), (2, True), (3, True), (4, False)], "symbol long, is_reit boolean")
    metrics = ["totalrevenue", "capitalexpenditure"]
    for w, want in ((wide, (2, 1)), (wide.filter("symbol = 1"), (1, 1)), (wide.limit(0), (0, 0))):
        a, b = checks.reit_capex_coverage(statements.melt_statements(w, metrics), dim), checks.reit_capex_coverage_wide(w, dim, metrics)
        assert tuple(a.first()) == tuple(b.first()) == want
        assert checks.reit_affo_proxy_still_needed_wide(w, dim, metrics).count() == checks.reit_affo_proxy_still_needed(statements.melt_statements(w, metrics), dim).count() == (want == (1, 1))
    assert "Expand" not in b._jdf.queryExecution().optimizedPlan().toString()

import datetime as dt

from finquarry.operators import statements


def test_financials_equal_the_melted_and_pivoted_ones(spark):
    n, day = len(statements.METRICS), dt.date
    amounts = [[1.0 + i for i in range(n)], [9.0 - i for i in range(n)], [None] * n, [float("nan"), float("inf"), *[None] * (n - 2)], [float("nan"), *[2.0] * (n - 1)]]
    rows = [(1, "annual", day(2022, 12, 31), *amounts[0]), (1, "annual", day(2022, 12, 31), *amounts[1]), (1, "quarterly", day(2022, 12, 31), *amounts[4]), (2, "annual", day(2021, 12, 31), *amounts[2]), (2, "annual", day(2022, 12, 31), *amounts[3]), (2, "annual", day(2023, 12, 31), *amounts[0])]
    wide = spark.createDataFrame(rows, f"symbol long, period_type string, period_end date, {', '.join(f'{m} double' for m in statements.METRICS)}")
    dim = spark.createDataFrame([(1, "REIT - Retail"), (2, "Software")], "symbol long, industry string")
    got, want = statements.financials(wide, dim), statements.fct_financials(statements.melt_statements(wide), dim)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # and no pivot, which takes two

"""Financial statements: melting, pivoting, margins, endpoints, trailing twelve months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import growth, is_reit, safe_ratio

#: The metrics a pivoted statement has.
METRICS = ["totalrevenue", "netincome", "operatingincome", "ebitda", "ebit", "depreciationandamortization", "freecashflow", "operatingcashflow", "cashdividendspaid", "totaldebt", "cashandcashequivalents", "totalassets", "interestexpense", "dilutedaverageshares", "dilutedeps", "stockholdersequity"]
FLOWS = METRICS[:9] + ["interestexpense", "dilutedeps"]
KEYS = ["symbol", "period_type", "period_end"]
#: The further metrics of a whole statement, the flows among all metrics that add up over quarters, and
#: the lines that an income statement shows in its order (its net margin is derived).
MORE_METRICS = ["costofrevenue", "grossprofit", "researchanddevelopment", "sellinggeneralandadministration", "otheroperatingexpenses", "operatingexpense", "totalexpenses", "othernonoperatingincomeexpenses", "interestincome", "netinterestincome", "pretaxincome", "taxprovision", "taxrateforcalcs", "basiceps", "reconcileddepreciation", "capitalexpenditure"]
ALL_METRICS = METRICS + MORE_METRICS
ALL_FLOWS = FLOWS + ["costofrevenue", "grossprofit", "researchanddevelopment", "operatingexpense", "interestincome", "pretaxincome", "taxprovision", "basiceps", "reconcileddepreciation", "capitalexpenditure"]
SHOWN_LINES = ["totalrevenue", "costofrevenue", "grossprofit", "researchanddevelopment", "sellinggeneralandadministration", "otheroperatingexpenses", "operatingexpense", "totalexpenses", "operatingincome", "othernonoperatingincomeexpenses", "interestincome", "interestexpense", "netinterestincome", "pretaxincome", "taxprovision", "taxrateforcalcs", "netincome", "dilutedeps", "basiceps", "dilutedaverageshares", "reconcileddepreciation", "ebitda", "freecashflow"]


def melt_statements(wide: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Wide to long (metric, value); null, NaN and infinite values go."""
    long = wide.unpivot(KEYS, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def fct_financials(long: DataFrame, dim: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """One row a period, with margins, FFO for REITs and rank by recency. The metric list is given, so the pivot needs
    no extra job to find it."""
    return _with_margins(long.groupBy(*KEYS).pivot("metric", metrics).agg(F.max("value")), dim, ["symbol", "period_type"])


def financials(wide: DataFrame, dim: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """fct_financials straight from wide rows: one aggregate with a row a period, where melting and the pivot hold a row a
    period and metric. Null, NaN and infinite values are null, a period without any value goes, of repeated rows the
    largest value of each metric stays."""
    return _with_margins(_periods(wide, KEYS, metrics), dim, ["symbol", "period_type"])


def annual_financials(wide: DataFrame, dim: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """financials of the annual statements alone, so that one shuffle by symbol serves rank, history and score."""
    p = _periods(wide.filter("period_type = 'annual'"), ["symbol", "period_end"], metrics)
    return _with_margins(p.withColumn("period_type", F.lit("annual")), dim, ["symbol"])


def _periods(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    v = {m: F.col(m).cast("double") for m in metrics}
    v = {m: F.max(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)).alias(m) for m, c in v.items()}
    return wide.groupBy(*keys).agg(*v.values()).filter(F.coalesce(*metrics).isNotNull())


def _with_margins(p: DataFrame, dim: DataFrame, by: list[str]) -> DataFrame:
    reit = dim.select("symbol", is_reit("industry").alias("is_reit"))
    p = p.join(reit, "symbol", "left").withColumn("ffo", F.when(F.col("is_reit"), F.col("netincome") + F.col("depreciationandamortization")))
    share = lambda c: F.when(F.col("totalrevenue") > 0, F.col(c) / F.col("totalrevenue") * 100)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("period_end"))).cast("long")
    return p.withColumns({"net_margin_pct": share("netincome"), "operating_margin_pct": share("operatingincome"), "ebitda_margin_pct": share("ebitda"), "recency_rank": rank}).drop("is_reit")


def payout_3y(fin: DataFrame, dim: DataFrame) -> DataFrame:
    cash = F.when(F.col("is_reit"), F.col("operatingcashflow")).otherwise(F.col("freecashflow"))
    a = fin.filter("period_type = 'annual' and recency_rank <= 3").join(dim.select("symbol", is_reit("industry").alias("is_reit")), "symbol").withColumn("cash", cash)
    a = a.filter("cashdividendspaid is not null and cash is not null")
    return a.groupBy("symbol").agg(F.count("*").alias("years_used"), F.sum(F.abs("cashdividendspaid")).alias("dividends_paid"), F.sum("cash").alias("distributable_cash"))


def growth_endpoints(fin: DataFrame, most: int = 5) -> DataFrame:
    return _annual(fin, most).groupBy("symbol").agg(*_endpoints())


def _annual(fin: DataFrame, most: int) -> DataFrame:
    return fin.filter("period_type = 'annual'").withColumn("old", F.least(F.lit(most), F.max("recency_rank").over(Window.partitionBy("symbol"))))


def _endpoints() -> list[Column]:
    per_share = F.col("ffo") / F.when(F.col("dilutedaverageshares") != 0, F.col("dilutedaverageshares"))
    at = lambda c, r: F.max(F.when(F.col("recency_rank") == r, c))
    ends = {}
    for name, c in (("revenue", F.col("totalrevenue")), ("eps", F.col("dilutedeps")), ("ffops", per_share)):
        ends |= {f"{name}_new": at(c, F.lit(1)), f"{name}_old": at(c, F.col("old"))}
    return [*[v.alias(k) for k, v in ends.items()], (F.max("old") - 1).cast("long").alias("growth_years")]


def annual_history(fin: DataFrame, most: int = 5) -> DataFrame:
    """Latest annual statement, growth endpoints and the payout of three years (on free and on operating cash flow) of
    each symbol, in one aggregate: what growth_endpoints and payout_3y give without scanning the statements thrice."""
    latest = [c for c in fin.columns if c not in ("symbol", "period_type", "recency_rank")]
    sums = []
    for c in ("freecashflow", "operatingcashflow"):
        used = (F.col("recency_rank") <= 3) & F.col("cashdividendspaid").isNotNull() & F.col(c).isNotNull()
        sums += [F.sum(F.when(used, F.abs("cashdividendspaid"))).alias(f"paid_on_{c}"), F.sum(F.when(used, F.col(c))).alias(f"sum_of_{c}")]
    return _annual(fin, most).groupBy("symbol").agg(*[F.max(F.when(F.col("recency_rank") == 1, F.col(c))).alias(c) for c in latest], *_endpoints(), *sums)


def ttm_fold(quarters: DataFrame, flows: list[str] = FLOWS, balances: tuple[str, ...] = ("totaldebt", "cashandcashequivalents", "totalassets", "stockholdersequity", "dilutedaverageshares")) -> DataFrame:
    """Up to four quarters ending at each: flows summed to a year, null if any is null; balances of the last."""
    w = Window.partitionBy("symbol").orderBy("period_end").rowsBetween(-3, 0)
    n = F.count("*").over(w)
    cols = [F.when(F.count(c).over(w) == n, F.sum(c).over(w) * 4 / n).alias(c) for c in flows]
    return quarters.select("symbol", "period_end", *cols, *balances, n.alias("quarters_used"))


def income_statement(fin: DataFrame, annual: int = 6, quarterly: int = 8, lines: list[str] = METRICS) -> DataFrame:
    """Long statement of the last periods; a line that is null in all shown periods is left out."""
    most = F.when(F.col("period_type") == "annual", annual).otherwise(quarterly)
    shown = fin.filter(F.col("recency_rank") <= most).withColumn("netmargin", F.col("net_margin_pct"))
    long = shown.unpivot(KEYS, [*lines, "netmargin"], "line", "value")
    some = F.count("value").over(Window.partitionBy("symbol", "period_type", "line"))
    return long.withColumn("_n", some).filter("_n > 0").drop("_n")


def financials_view(fin: DataFrame, annual: int = 10, quarterly: int = 12) -> DataFrame:
    most = F.when(F.col("period_type") == "annual", annual).otherwise(quarterly)
    return fin.filter(F.col("recency_rank") <= most).select(*KEYS, "totalrevenue", "netincome", "freecashflow", "dilutedeps")


def yearly_ratios(fin: DataFrame) -> DataFrame:
    """Latest annual ratios and growth over the period before it."""
    w = Window.partitionBy("symbol", "period_type").orderBy("period_end")
    f = fin.withColumns({"rev0": F.lag("totalrevenue").over(w), "ni0": F.lag("netincome").over(w)}).filter("period_type = 'annual' and recency_rank = 1")
    return f.select("symbol", "period_end", safe_ratio("netincome", "totalassets").alias("roa"), safe_ratio("totaldebt", "stockholdersequity").alias("debt_to_equity"), safe_ratio("stockholdersequity", "dilutedaverageshares").alias("book_per_share"), growth("totalrevenue", "rev0").alias("revenue_growth_pct"), growth("netincome", "ni0").alias("earnings_growth_pct"))

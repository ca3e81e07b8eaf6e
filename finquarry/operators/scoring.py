"""The five-pillar quality score, its screens, summaries and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import cagr, grade, is_reit, score_between, weighted_score
from finquarry.operators.core import top_k
from finquarry.operators.dividends import dividend_history
from finquarry.operators.statements import annual_history


def dim_security(stg: DataFrame) -> DataFrame:
    return stg.withColumn("is_reit", is_reit("industry"))


def quality_score(dim: DataFrame, fin: DataFrame, windows: DataFrame) -> DataFrame:
    """Score of each symbol with an annual statement; rounded once, at the end. live_score has the on-line form."""
    s = dim.join(annual_history(fin), "symbol").join(dividend_history(windows), "symbol", "left")
    reit = F.col("is_reit")
    cash = lambda c: F.when(reit, F.col(f"{c}_operatingcashflow")).otherwise(F.col(f"{c}_freecashflow"))
    s = s.withColumns({"dividends_paid": cash("paid_on"), "distributable_cash": cash("sum_of")})
    net_debt = F.col("totaldebt") - F.coalesce("cashandcashequivalents", F.lit(0.0))
    s = s.withColumns({
        "raise_streak": F.coalesce("raise_streak", F.lit(0)),
        "price_to_ffo": F.when(F.col("ffo") > 0, F.col("market_cap") / F.col("ffo")),
        "net_debt_to_ebitda": F.when(F.col("ebitda") > 0, net_debt / F.col("ebitda")),
        "interest_coverage": F.when(F.abs("interestexpense") > 0, F.when(reit, F.col("ebitda")).otherwise(F.col("ebit")) / F.abs("interestexpense")),
        "debt_to_assets": F.when(F.col("totalassets") > 0, F.col("totaldebt") / F.col("totalassets")),
        "ffo_margin_pct": F.when(F.col("totalrevenue") > 0, F.col("ffo") / F.col("totalrevenue") * 100),
        "payout_pct": F.when(F.col("distributable_cash") > 0, F.col("dividends_paid") / F.col("distributable_cash") * 100),
        "yield_vs_history": F.when(F.col("five_year_avg_dividend_yield_pct") > 0, F.col("dividend_yield_pct") / F.col("five_year_avg_dividend_yield_pct")),
        "revenue_cagr_pct": cagr("revenue_old", "revenue_new", "growth_years"),
        "per_share_cagr_pct": F.when(reit, cagr("ffops_old", "ffops_new", "growth_years")).otherwise(cagr("eps_old", "eps_new", "growth_years")),
        "dividend_cagr_pct": cagr("older_year_amount", "latest_year_amount", "dividend_years"),
        "fcf_yield_pct": F.when(F.col("totalrevenue") > 0, F.try_divide("freecashflow", "market_cap") * 100),
    })
    pays = F.coalesce((F.col("dividend_yield_pct") > 0) & ((F.col("dividend_yield_pct") >= 0.25) | F.coalesce(F.col("payout_pct") >= 5, F.lit(False))), F.lit(False))
    usable = F.coalesce((F.col("dividend_yield_pct") >= 1) & (F.col("five_year_avg_dividend_yield_pct") > 0), F.lit(False))

    def by(a: float, b: float):
        return F.when(reit, F.lit(a)).otherwise(F.lit(b))

    pillars = {
        "pillar_dividend": [(F.when(pays, score_between("payout_pct", by(100.0, 90.0), by(70.0, 40.0))), 0.55), (F.when(pays, score_between("raise_streak", 0, 10)), 0.45)],
        "pillar_balance_sheet": [(score_between("net_debt_to_ebitda", by(8.0, 4.5), by(4.5, 1.0)), 0.5), (score_between("interest_coverage", by(2.0, 3.0), by(5.5, 15.0)), 0.3), (score_between("debt_to_assets", by(0.65, 0.6), by(0.30, 0.20)), 0.2)],
        "pillar_growth": [(score_between("revenue_cagr_pct", 0, 12), 0.35), (score_between("per_share_cagr_pct", 0, 10), 0.4), (F.when(pays, score_between("dividend_cagr_pct", 0, 8)), 0.25)],
        "pillar_profitability": [(F.when(reit, score_between("ebitda_margin_pct", 40, 70)).otherwise(score_between("operating_margin_pct", 5, 30)), 0.5), (F.when(reit, score_between("ffo_margin_pct", 30, 65)).otherwise(score_between("return_on_equity_pct", 5, 25)), 0.5)],
        "pillar_valuation": [(F.when(reit, score_between("price_to_ffo", 28, 13)).otherwise(score_between("trailing_pe", 35, 12)), 0.6), (F.when(usable, score_between("yield_vs_history", 0.7, 1.3)).otherwise(score_between("fcf_yield_pct", 2, 8)), 0.4)],
    }
    s = s.withColumns({k: weighted_score(v) for k, v in pillars.items()})
    weights = {"pillar_dividend": 25, "pillar_balance_sheet": 25, "pillar_growth": 20, "pillar_profitability": 15, "pillar_valuation": 15}
    covered = sum((F.when(F.col(k).isNotNull(), F.lit(v)).otherwise(0) for k, v in weights.items()), F.lit(0))  # whole percents
    s = s.withColumn("coverage_pct", covered.cast("double")).withColumn("overall_score", F.when(F.col("coverage_pct") >= 40, F.round(weighted_score([(k, v / 100) for k, v in weights.items()]))))
    inputs = ["payout_pct", "raise_streak", "net_debt_to_ebitda", "interest_coverage", "debt_to_assets", "revenue_cagr_pct", "per_share_cagr_pct", "dividend_cagr_pct", "price_to_ffo", "yield_vs_history", "fcf_yield_pct"]
    return s.select(
        "symbol", "name", "sector", "industry", "is_reit", F.when(reit, "reit").otherwise("standard").alias("scoring_basis"), F.col("period_end").alias("fiscal_year_end"), "overall_score", grade("overall_score").alias("grade"), "coverage_pct",
        *[F.round(k).alias(k) for k in weights], pays.alias("pays_dividend"), *inputs, "market_cap",
    )


def screener(scores: DataFrame, basis: str | None = None, sector: str | None = None) -> DataFrame:
    out = scores
    if basis:
        out = out.filter(F.col("scoring_basis") == basis)
    if sector:
        out = out.filter(F.col("sector") == sector)
    return out.select("symbol", "name", "sector", "scoring_basis", "overall_score", "grade").orderBy(F.desc_nulls_last("overall_score"), "symbol")


def sector_summary(scores: DataFrame) -> DataFrame:
    g = scores.groupBy(F.coalesce("sector", F.lit("Unclassified")).alias("sector"))
    return g.agg(F.count("*").alias("companies"), F.round(F.avg("overall_score"), 1).alias("avg_score"), F.round(F.avg("payout_pct"), 1).alias("avg_payout"), F.round(F.avg("net_debt_to_ebitda"), 2).alias("avg_leverage"), F.sum(F.col("is_reit").cast("long")).alias("reits"))


def stg_score_history(rows: DataFrame) -> DataFrame:
    """One row per symbol and day: the lowest score wins, nulls last."""
    rest = [c for c in rows.columns if c not in ("symbol", "score_date", "overall_score")]  # ties are settled by these
    return top_k(rows, ["symbol", "score_date"], [F.asc_nulls_last("overall_score"), *rest], 1)


def score_history(stg: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("score_date")
    back = {f"previous_{a}": F.lag(b).over(w) for a, b in (("score", "overall_score"), ("grade", "grade"), ("score_date", "score_date"))}
    h = stg.withColumns(back)
    return h.withColumns({"score_change": F.col("overall_score") - F.col("previous_score"), "grade_changed": ~F.col("grade").eqNullSafe(F.col("previous_grade")), "is_latest": F.lead("score_date").over(w).isNull()})


def score_movers(history: DataFrame, dim: DataFrame) -> DataFrame:
    h = history.filter("is_latest and score_change is not null").join(dim.select("symbol", "name", "sector"), "symbol", "left")
    return h.select("symbol", "name", "sector", "score_date", "overall_score", "previous_score", "score_change", "grade", "previous_grade", "grade_changed").orderBy(F.desc(F.abs("score_change")), "symbol")


def security_facets(dim: DataFrame, scores: DataFrame) -> DataFrame:
    return dim.select("symbol", "name", "sector", "industry", "is_reit").join(scores.select("symbol", "grade", "overall_score", "scoring_basis"), "symbol", "left")


def screener_sectors(scores: DataFrame) -> DataFrame:
    """The sectors that a screen can be narrowed to."""
    return scores.filter("sector is not null").select("sector").distinct().orderBy("sector")


def names_for(asked: DataFrame, dim: DataFrame) -> DataFrame:
    """(symbol, name) of the symbols asked for that are tracked, each once."""
    return dim.select("symbol", "name").join(asked.select("symbol").distinct(), "symbol", "left_semi")


def is_tracked(asked: DataFrame, dim: DataFrame) -> DataFrame:
    """Each symbol asked for, once, with whether it is tracked."""
    known = dim.select("symbol", F.lit(True).alias("tracked")).distinct()
    return asked.select("symbol").distinct().join(known, "symbol", "left").select("symbol", F.coalesce("tracked", F.lit(False)).alias("tracked"))


def unknown_symbols(asked: DataFrame, dim: DataFrame) -> DataFrame:
    return asked.select("symbol").distinct().join(dim, "symbol", "left_anti")


#: The columns that a screen can be sorted by.
SORTS = ("symbol", "name", "sector", "overall_score", "coverage_pct", "market_cap", "payout_pct", "raise_streak", "net_debt_to_ebitda", "interest_coverage", "revenue_cagr_pct", "per_share_cagr_pct", "dividend_cagr_pct", "fcf_yield_pct", "yield_vs_history", "valuation_multiple")


def screener_sort(scores: DataFrame, dim: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Scores in the order of a column, nulls last either way; valuation_multiple is P/FFO for REITs, else P/E."""
    if by not in SORTS:
        raise ValueError(f"no sort by {by}")
    s = scores.join(dim.select("symbol", "trailing_pe"), "symbol").withColumn("valuation_multiple", F.when(F.col("is_reit"), F.col("price_to_ffo")).otherwise(F.col("trailing_pe")))
    return s.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "symbol")

"""Typed, latest-wins views of the landing zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquarry.functions.columns import unwrap_num
from finquarry.operators.core import latest_wins, top_k


def _symbol() -> Column:
    return F.upper(F.trim("symbol"))


def _day(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("date"), F.col(c).try_cast("timestamp").cast("date"))


def _at() -> Column:
    return F.col("_ingested_at").try_cast("timestamp").alias("ingested_at")


def stg_prices(raw: DataFrame) -> DataFrame:
    nums = [unwrap_num(c).alias(c) for c in ("open", "high", "low", "close", "adj_close")]
    p = raw.select(_symbol().alias("symbol"), _day("trade_date").alias("trade_date"), *nums, unwrap_num("volume").cast("long").alias("volume"), _at())
    return latest_wins(p.filter("close > 0 and symbol is not null and trade_date is not null"), ["symbol", "trade_date"], ["ingested_at"])


def stg_dividends(raw: DataFrame) -> DataFrame:
    d = raw.select(_symbol().alias("symbol"), _day("pay_date").alias("pay_date"), unwrap_num("amount").alias("amount"), _at())
    return latest_wins(d.filter("amount > 0"), ["symbol", "pay_date"], ["ingested_at"])


def stg_financials_versions(raw: DataFrame) -> DataFrame:
    return raw.select(_symbol().alias("symbol"), F.lower("period_type").alias("period_type"), _day("period_end").alias("period_end"), F.lower("metric").alias("metric"), unwrap_num("value").alias("value"), _at()).filter("period_end is not null")


def stg_financials(raw: DataFrame) -> DataFrame:
    f = stg_financials_versions(raw).filter("value is not null")
    return latest_wins(f, ["symbol", "period_type", "period_end", "metric"], ["ingested_at"])


def stg_securities(raw: DataFrame) -> DataFrame:
    text = ["name", "exchange", "quote_type", "sector", "industry", "country", "website", "recommendation_key"]
    nums = ["market_cap", "shares_outstanding", "trailing_pe", "five_year_avg_dividend_yield", "beta", "current_price", "target_mean_price", "target_low_price", "target_high_price", "current_ratio", "forward_pe", "peg_ratio"]
    s = raw.select(
        _symbol().alias("symbol"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in text], F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("USD")).alias("currency"), unwrap_num("employees").cast("long").alias("employees"),
        *[unwrap_num(c).alias(c) for c in nums], (unwrap_num("dividend_yield") * 100).alias("dividend_yield_pct"), (unwrap_num("return_on_equity") * 100).alias("return_on_equity_pct"), F.timestamp_seconds(unwrap_num("ex_dividend_date")).alias("ex_dividend_at"), _at(),
    )
    return latest_wins(s, ["symbol"], ["ingested_at"]).withColumnRenamed("five_year_avg_dividend_yield", "five_year_avg_dividend_yield_pct")


def stg_splits(raw: DataFrame) -> DataFrame:
    s = raw.select(_symbol().alias("symbol"), _day("split_date").alias("split_date"), F.try_divide(unwrap_num("numerator"), unwrap_num("denominator")).alias("ratio"), _at())
    return latest_wins(s.filter("ratio > 0 and ratio <> 1"), ["symbol", "split_date"], ["ingested_at"])


def stg_index_membership(raw: DataFrame) -> DataFrame:
    return raw.select(_symbol().alias("symbol"), F.coalesce("index_name", F.lit("sp500")).alias("index_name"), _day("observed_at").alias("observed_on")).distinct()


def stg_score_history(raw: DataFrame) -> DataFrame:
    nums = ["overall_score", "coverage_pct", "pillar_dividend", "pillar_balance_sheet", "pillar_growth", "pillar_profitability", "pillar_valuation"]
    s = raw.select(_day("score_date").alias("score_date"), _symbol().alias("symbol"), "scoring_basis", "grade", *[unwrap_num(c).alias(c) for c in nums])
    rest = [c for c in s.columns if c not in ("symbol", "score_date", "overall_score")]  # ties are settled by these
    return top_k(s, ["symbol", "score_date"], [F.asc_nulls_last("overall_score"), *rest], 1)

"""The append-only landing zone: reading by entity, appending runs, feeding scores back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquarry.sources.store import has_files

_STAMPS = "_ingested_at string, _run_id string"
_SECURITY = "symbol name currency exchange quote_type sector industry country employees website description market_cap shares_outstanding trailing_pe dividend_yield five_year_avg_dividend_yield beta current_price target_mean_price target_low_price target_high_price target_median_price analyst_opinions recommendation_key recommendation_mean return_on_equity current_ratio forward_pe peg_ratio ex_dividend_date short_percent_of_float quarterly_earnings_growth".split()
#: The fields of raw entities. All are text, so that {} and wrapped numbers survive until they are cast.
SCHEMAS = {
    "price": f"symbol string, trade_date string, open string, high string, low string, close string, adj_close string, volume string, {_STAMPS}",
    "split": f"symbol string, split_date string, numerator string, denominator string, {_STAMPS}",
    "dividend": f"symbol string, pay_date string, amount string, {_STAMPS}",
    "financial": f"symbol string, period_type string, period_end string, metric string, value string, {_STAMPS}",
    "security": ", ".join(f"{c} string" for c in _SECURITY) + f", {_STAMPS}",
    "membership": "symbol string, index_name string, observed_at string, source string, _ingested_at string",
    "score_history": "score_date string, symbol string, scoring_basis string, overall_score string, grade string, coverage_pct string, pillar_dividend string, pillar_balance_sheet string, pillar_growth string, pillar_profitability string, pillar_valuation string",
}


def read_landing(spark: SparkSession, raw_dir: str, entity: str) -> DataFrame:
    """All runs of an entity, plain or gzipped; columns that old files lack are null."""
    return spark.read.schema(SCHEMAS[entity]).json(f"{raw_dir}/{entity}__*.jsonl*")


def read_landing_or_empty(spark: SparkSession, raw_dir: str, entity: str) -> DataFrame:
    if has_files(spark, f"{raw_dir}/{entity}__*.jsonl*"):
        return read_landing(spark, raw_dir, entity)
    return spark.createDataFrame([], SCHEMAS[entity])


def append_landing(df: DataFrame, raw_dir: str, entity: str, run_id: str, ingested_at: str) -> None:
    """One folder a run, gzipped JSON lines, every row stamped. Folders are never rewritten."""
    stamped = df.withColumns({"_ingested_at": F.lit(ingested_at), "_run_id": F.lit(run_id)})
    stamped.write.mode("errorifexists").option("compression", "gzip").json(f"{raw_dir}/{entity}__{run_id}.jsonl")


def append_membership(df: DataFrame, raw_dir: str, run_id: str, observed_at: str) -> None:
    rows = df.select("symbol", "index_name", F.lit(observed_at).alias("observed_at"), "source", F.lit(observed_at).alias("_ingested_at"))
    rows.write.mode("errorifexists").option("compression", "gzip").json(f"{raw_dir}/membership__{run_id}.jsonl")


def export_score_history(scores: DataFrame, path: str, score_date: str) -> None:
    """The day's scores; a second run of the day replaces its partition only."""
    day = scores.withColumn("score_date", F.lit(score_date))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("score_date").json(path)


def extract_run_report(counts: DataFrame, failures: DataFrame, symbols: int) -> DataFrame:
    """Rows by entity, failed symbols, and whether too many failed (over a third)."""
    failed = failures.agg(F.count_distinct("symbol").alias("failed"))  # one row
    out = counts.groupBy("entity").agg(F.count("*").alias("rows")).join(F.broadcast(failed))
    return out.withColumn("run_fails", F.col("failed") > symbols / 3)


def extract_plan(universe: DataFrame, state: DataFrame, now: str, overlap_days: int = 7) -> DataFrame:
    """What is due: prices from the watermark less an overlap, or a cold start by tier (six or two years); what a symbol's
    security, statements and payments need once their last refresh is a day (deep tier) or a week old, or missing."""
    day = F.to_date(F.lit(now))
    p = universe.join(state, "symbol", "left")
    start = F.coalesce(F.date_sub("last_date", overlap_days), F.add_months(day, F.when(F.col("tier") == "deep", -72).otherwise(-24)))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("refreshed_at")) / 3600
    limit = F.when(F.col("tier") == "deep", 24).otherwise(168)
    return p.select("symbol", "tier", start.alias("from_date"), (age.isNull() | (age >= limit)).alias("security_due"), (age.isNull() | (age >= 168)).alias("financial_due"), F.col("last_date").isNull().alias("cold_start"))

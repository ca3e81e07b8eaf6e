"""Dividend cadence, windows, streaks and calendar years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import snap_to_dividend_frequency
from finquarry.operators.core import top_k


def fct_dividends(div: DataFrame, as_of: str, years: int = 3) -> DataFrame:
    """Payments with sequence, count and cadence: the median gap of the last years, else of the whole record."""
    w = Window.partitionBy("symbol").orderBy("pay_date")
    d = div.filter("symbol is not null").withColumns({"payment_seq": F.row_number().over(w).cast("long"), "payments_total": F.count("*").over(Window.partitionBy("symbol")), "gap": F.datediff("pay_date", F.lag("pay_date").over(w))})
    recent = F.col("pay_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years)
    all_rows = Window.partitionBy("symbol")
    d = d.withColumns({"near": F.median(F.when(recent, F.col("gap"))).over(all_rows), "all": F.median("gap").over(all_rows)})
    d = d.withColumn("payments_per_year", F.coalesce(snap_to_dividend_frequency("near"), snap_to_dividend_frequency("all")).cast("long"))
    return d.select("symbol", "pay_date", "amount", "payment_seq", "payments_total", "payments_per_year", F.year("pay_date").cast("long").alias("calendar_year"))


def dividend_windows(fct: DataFrame) -> DataFrame:
    """Sums over each year's worth of payments, counted back from the last; full windows only."""
    b = fct.filter("payments_per_year is not null").withColumn("window_index", F.floor((F.col("payments_total") - F.col("payment_seq")) / F.col("payments_per_year")).cast("long"))
    g = b.groupBy("symbol", "window_index").agg(F.sum("amount").alias("amount"), F.count("*").alias("payments"), F.max("payments_per_year").alias("payments_per_year"), F.min("pay_date").alias("window_start"), F.max("pay_date").alias("window_end"))
    return g.filter("payments = payments_per_year")


def raise_streak(windows: DataFrame) -> DataFrame:
    """Rising windows in a row, counted back from the latest."""
    older = F.lead("amount").over(Window.partitionBy("symbol").orderBy("window_index"))
    r = windows.withColumn("rose", F.col("amount") > older * 1.001).filter("rose is not null")
    return r.groupBy("symbol").agg(F.coalesce(F.min(F.when(~F.col("rose"), F.col("window_index"))), F.max("window_index")).alias("raise_streak"), F.max("window_index").alias("windows_compared"))


def dividend_history(windows: DataFrame, most: int = 5) -> DataFrame:
    """Newest window, the oldest of the last ones and the streak of each symbol, in one pass over its windows."""
    by = Window.partitionBy("symbol")
    i, last = F.col("window_index"), F.col("last")
    w = windows.withColumns({"rose": F.col("amount") > F.lead("amount").over(by.orderBy("window_index")) * 1.001, "last": F.least(F.lit(most), F.max("window_index").over(by))})
    at = lambda k: F.max(F.when(i == k, F.col("amount")))
    streak = F.coalesce(F.min(F.when(~F.col("rose"), i)), F.max(F.when(F.col("rose").isNotNull(), i)))
    return w.groupBy("symbol").agg(at(0).alias("latest_year_amount"), at(last).alias("older_year_amount"), F.max(last).alias("dividend_years"), streak.alias("raise_streak"))


def dividend_years(fct: DataFrame, as_of: str) -> DataFrame:
    g = fct.groupBy("symbol", "calendar_year").agg(F.sum("amount").alias("total"), F.count("*").alias("payments"), F.max("payments_per_year").alias("payments_per_year"))
    return g.withColumn("is_partial", F.col("calendar_year") >= F.year(F.lit(as_of).cast("date")))


def dividends_by_year(div: DataFrame, as_of: str, years: int = 12) -> DataFrame:
    """A symbol's last `years` calendar years with payments: amount to four places, and whether the year is still running."""
    y = div.groupBy("symbol", F.year("pay_date").cast("long").alias("year")).agg(F.round(F.sum(F.col("amount").cast("decimal(28,6)")), 4).cast("double").alias("amount"))
    return top_k(y, ["symbol"], [F.desc("year")], years).withColumn("partial", F.col("year") == F.year(F.lit(as_of).cast("date")))


def dividend_yoy(years: DataFrame) -> DataFrame:
    """Growth of the last complete year over the one before it."""
    w = Window.partitionBy("symbol").orderBy("calendar_year")
    y = years.filter(~F.col("is_partial")).withColumns({"prior": F.lag("total").over(w), "prior_year": F.lag("calendar_year").over(w)})
    last = y.groupBy("symbol").agg(F.max_by(F.struct("calendar_year", "total", "prior", "prior_year"), "calendar_year").alias("r"))
    ok = (F.col("r.prior") > 0) & (F.col("r.prior_year") == F.col("r.calendar_year") - 1)
    return last.select("symbol", F.col("r.calendar_year").alias("calendar_year"), F.when(ok, (F.col("r.total") / F.col("r.prior") - 1) * 100).alias("yoy_pct"))


def trailing_year_totals(div: DataFrame, most: int = 11) -> DataFrame:
    """The looser cadence: upper median gap of the whole record, 1 to 12 payments a year, at most `most` windows."""
    w = Window.partitionBy("symbol").orderBy("pay_date")
    d = div.filter("amount > 0").withColumns({"gap": F.datediff("pay_date", F.lag("pay_date").over(w)), "back": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("pay_date"))) - 1})
    g = d.groupBy("symbol").agg(F.sort_array(F.collect_list("gap")).alias("gaps"), F.count("*").alias("n"))
    mid = F.try_element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int"))
    g = g.select("symbol", "n", F.greatest(F.lit(1), F.least(F.lit(12), F.round(F.lit(365.25) / mid).cast("int"))).alias("per_year"))
    t = d.join(g.filter("per_year is not null"), "symbol").withColumn("window_index", F.floor(F.col("back") / F.col("per_year")).cast("long"))
    t = t.filter((F.col("window_index") < most) & ((F.col("window_index") + 1) * F.col("per_year") <= F.col("n")))
    return t.groupBy("symbol", "window_index").agg(F.sum("amount").alias("amount"), F.max("per_year").cast("long").alias("per_year"))


def dividends_for(div: DataFrame, symbols: DataFrame) -> DataFrame:
    return div.filter("amount > 0").join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.col("pay_date").alias("ex_date"), "amount")

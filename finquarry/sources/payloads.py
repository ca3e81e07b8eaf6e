"""Upstream JSON payloads to rows: charts, events, time series, universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHART = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,adjclose:array<double>,volume:array<bigint>>"


def flatten_chart_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """(symbol, payload) with parallel arrays to bars. Null or non-positive closes go; adj_close falls back to close."""
    p = F.from_json(col, _CHART)
    z = df.select("symbol", p.alias("p")).select("symbol", F.explode(F.arrays_zip("p.timestamp", "p.open", "p.high", "p.low", "p.close", "p.adjclose", "p.volume")).alias("b"))
    b = z.select("symbol", F.to_date(F.timestamp_seconds("b.timestamp")).alias("trade_date"), *[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("b.adjclose", "b.close").alias("adj_close"), F.coalesce("b.volume", F.lit(0)).alias("volume"))
    return b.filter("close > 0")


def flatten_dividend_events(df: DataFrame, col: str = "payload") -> DataFrame:
    e = df.select("symbol", F.explode(F.map_values(F.from_json(col, "map<string,struct<date:bigint,amount:double>>"))).alias("e"))
    return e.filter("e.date > 0 and e.amount > 0").select("symbol", F.to_date(F.timestamp_seconds("e.date")).alias("pay_date"), F.col("e.amount").alias("amount"))


def flatten_split_events(df: DataFrame, col: str = "payload") -> DataFrame:
    e = df.select("symbol", F.explode(F.map_values(F.from_json(col, "map<string,struct<date:bigint,numerator:double,denominator:double>>"))).alias("e"))
    return e.filter("e.date > 0 and e.numerator > 0 and e.denominator > 0").select("symbol", F.to_date(F.timestamp_seconds("e.date")).alias("split_date"), (F.col("e.numerator") / F.col("e.denominator")).alias("ratio"))


def flatten_timeseries_payload(df: DataFrame) -> DataFrame:
    """(symbol, metric, as_of, value), metrics named annualTotalRevenue and so on, to long statements; periods without
    revenue and net income go."""
    bare = F.regexp_replace("metric", "^(annual|quarterly)", "")
    name = F.when(bare == "EBITDA", "ebitda").when(bare == "EBIT", "ebit").otherwise(F.concat(F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2))))
    long = df.select("symbol", F.when(F.col("metric").startswith("annual"), "annual").otherwise("quarterly").alias("period_type"), F.col("as_of").try_cast("date").alias("period_end"), name.alias("metric"), "value").filter("value is not null")
    keep = long.filter(F.col("metric").isin("totalRevenue", "netIncome")).select("symbol", "period_type", "period_end").distinct()
    return long.join(keep, ["symbol", "period_type", "period_end"], "left_semi")


def load_constituents_csv(spark, path: str) -> DataFrame:
    first = spark.read.csv(path, header=True)
    symbol = F.replace(F.upper(F.trim(first.columns[0])), F.lit("."), F.lit("-"))
    return first.select(symbol.alias("symbol")).filter(F.col("symbol").rlike(r"^[A-Z][A-Z0-9-]{0,9}$")).distinct()


def load_constituents_pipe(spark, path: str) -> DataFrame:
    p = spark.read.csv(path, header=True, sep="|")
    ok = ~F.col("Symbol").startswith("File Creation") & (F.coalesce(F.col("ETF"), F.lit("N")) != "Y") & (F.coalesce(F.col("Test Issue"), F.lit("N")) != "Y")
    return p.filter(ok & F.col("Symbol").rlike(r"^[A-Z][A-Z0-9.-]{0,9}$")).select(F.replace("Symbol", F.lit("."), F.lit("-")).alias("symbol")).distinct()


def load_holdings_json(spark, path: str) -> DataFrame:
    h = spark.read.schema("fund struct<entity:array<struct<ticker:string>>>").option("multiLine", True).json(path)
    return h.select(F.explode("fund.entity").alias("e")).select(F.upper(F.trim("e.ticker")).alias("symbol")).filter(F.col("symbol").rlike(r"^[A-Z][A-Z0-9.-]{0,9}$")).distinct()


def judge_universe(lists: DataFrame, bars: DataFrame, deep: tuple[str, ...] = ("sp500",)) -> DataFrame:
    """(symbol, index_name) lists to one row a symbol: its indexes, tier (deep if any of its indexes is, else wide) and
    reason, null for those that stay: no-symbol (null or blank) or no-price-bar. One pass and one join for both results."""
    u = lists.groupBy(F.nullif(F.upper(F.trim("symbol")), F.lit("")).alias("symbol")).agg(F.sort_array(F.collect_set("index_name")).alias("indexes"))
    known = bars.select("symbol", F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("symbol").isNull(), "no-symbol").when(F.col("known").isNull(), "no-price-bar")
    return _tiered(u, deep).join(known, "symbol", "left").withColumn("reason", reason).drop("known")


def _tiered(u: DataFrame, deep: tuple[str, ...]) -> DataFrame:
    return u.withColumn("tier", F.when(F.arrays_overlap("indexes", F.array(*map(F.lit, deep))), "deep").otherwise("wide"))


def build_universe(lists: DataFrame, bars: DataFrame | None = None, deep: tuple[str, ...] = ("sp500",)) -> DataFrame:
    """The symbols that stay, with indexes and tier; judge_universe also has those dropped, with the reason."""
    if bars is not None:
        return judge_universe(lists, bars, deep).filter("reason is null").drop("reason")
    return _tiered(lists.groupBy("symbol").agg(F.sort_array(F.collect_set("index_name")).alias("indexes")), deep)


def resolve_previous_close(df: DataFrame) -> DataFrame:
    """(price, stored_close, chart_previous, daily_previous, range, interval) with previous_close, change, change_pct.

    The stored close wins whatever the chart shows. A chart's own previous close is that of the day before only if its
    range is one day; on longer ranges the last bar but one is, if bars are daily. Else there is none.
    """
    chart = F.when(F.col("range") == "1d", F.col("chart_previous")).when(F.col("interval") == "1d", F.col("daily_previous"))
    df = df.withColumn("previous_close", F.coalesce("stored_close", chart))
    change = F.col("price") - F.col("previous_close")
    return df.withColumns({"change": change, "change_pct": F.try_divide(change, F.col("previous_close")) * 100})

"""Bars: latest prices, market map, split repair, anomalies, returns, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import is_reit_word, range_position, safe_ratio


def _by():
    return Window.partitionBy("symbol").orderBy("trade_date")


def latest_prices(bars: DataFrame) -> DataFrame:
    """Last bar of each symbol with the close before it."""
    b = bars.select("symbol", "trade_date", "close", "volume", F.lag("close").over(_by()).alias("previous_close"))
    last = b.groupBy("symbol").agg(F.max_by(F.struct("trade_date", "close", "previous_close", "volume"), "trade_date").alias("r")).select("symbol", "r.*")
    return last.withColumn("change_pct", F.try_divide(F.col("close") - F.col("previous_close"), F.col("previous_close")) * 100)


def market_map(bars: DataFrame, dim: DataFrame, scores: DataFrame) -> DataFrame:
    """Tiles of companies with a market cap, with their sector's total."""
    m = dim.filter("market_cap > 0").join(latest_prices(bars), "symbol").join(scores.select("symbol", "grade"), "symbol", "left")
    m = m.withColumn("sector", F.coalesce("sector", F.lit("Unclassified")))
    sector = m.groupBy("sector").agg(F.sum(F.round(F.col("market_cap") * 100).cast("long")).alias("sector_cents"), F.count("*").alias("companies"))
    return m.join(sector, "sector").select("sector", "symbol", "name", "market_cap", "change_pct", "grade", (F.col("sector_cents") / 100.0).alias("sector_cap"), "companies")


def market_map_tree(bars: DataFrame, dim: DataFrame, scores: DataFrame, most: int = 50) -> DataFrame:
    """The map's three levels from one aggregate: a row a tile, a row a sector and the total.

    Columns: level (tile, sector, total), sector, symbol, market_cap (summed in whole cents), companies, change_pct (of
    sectors and the total weighted by cap, over tiles with a change) and children, a sector's `most` largest tiles in
    order as (market_cap, symbol, name, change_pct, grade); folded counts the tiles that children leaves out. Companies
    without a bar or a cap above 0 have no tile; no sector is Unclassified.
    """
    m = dim.filter("market_cap > 0").select("symbol", "name", F.coalesce("sector", F.lit("Unclassified")).alias("sector"), "market_cap").join(latest_prices(bars).select("symbol", "change_pct"), "symbol").join(scores.select("symbol", "grade"), "symbol", "left")
    m = m.withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("market_cap"), "symbol")))
    cents = F.round(F.col("market_cap") * 100).cast("long")
    child = F.struct(F.col("place"), F.struct("market_cap", "symbol", "name", "change_pct", "grade").alias("tile"))
    g = m.groupingSets([["sector", "symbol"], ["sector"], []], "sector", "symbol").agg(
        F.grouping_id().alias("id"), (F.sum(cents) / 100.0).alias("market_cap"), F.count("*").alias("companies"), F.try_divide(F.sum(F.col("change_pct") * F.col("market_cap")), F.sum(F.when(F.col("change_pct").isNotNull(), F.col("market_cap")))).alias("change_pct"),
        F.collect_list(F.when(F.col("place") <= most, child)).alias("kept"),
    )
    sector = F.col("id") == 1
    children = F.when(sector, F.transform(F.sort_array("kept"), lambda x: x["tile"]))
    return g.select(F.when(F.col("id") == 0, "tile").when(sector, "sector").otherwise("total").alias("level"), "sector", "symbol", "market_cap", "companies", "change_pct", children.alias("children"), F.when(sector, F.col("companies") - F.size("kept")).alias("folded"))


def split_corrections(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits on trading days, with the steps of both closes; missed upstream if both fall by the ratio alike."""
    b = bars.select("symbol", F.col("trade_date").alias("split_date"), "close", "adj_close", F.lag("close").over(_by()).alias("c0"), F.lag("adj_close").over(_by()).alias("a0")).filter("c0 > 0 and a0 > 0")
    s = splits.join(b, ["symbol", "split_date"]).select("symbol", "split_date", "ratio", (F.col("close") / F.col("c0")).alias("close_step"), (F.col("adj_close") / F.col("a0")).alias("adj_step"))
    missed = (F.abs(F.col("close_step") - 1.0 / F.col("ratio")) < 0.05 / F.col("ratio")) & (F.abs(F.col("close_step") - F.col("adj_step")) < 0.001)
    return s.withColumn("upstream_missed_it", missed)


def fct_prices(bars: DataFrame, corrections: DataFrame) -> DataFrame:
    """Bars with the product of the missed splits after them. A symbol's splits are few, so they come as one array a
    symbol and no bar is multiplied."""
    m = corrections.filter("upstream_missed_it").groupBy("symbol").agg(F.collect_list(F.struct("split_date", "ratio")).alias("m"))
    later = F.filter("m", lambda s: s["split_date"] > F.col("trade_date"))
    factor = F.coalesce(F.aggregate(later, F.lit(1.0), lambda acc, s: acc * s["ratio"]), F.lit(1.0))
    p = bars.join(m, "symbol", "left").withColumn("correction_factor", factor).drop("m")
    p = p.withColumn("adj_close_reported", F.col("adj_close")).withColumn("adj_close", F.col("adj_close") / F.col("correction_factor"))
    return p.withColumn("total_return_factor", F.when(F.col("close") > 0, F.col("adj_close") / F.col("close")))


def price_anomalies(prices: DataFrame, window: int = 90, min_obs: int = 45, sigma: float = 8.0) -> DataFrame:
    r = prices.withColumn("prev", F.lag("adj_close").over(_by())).filter("prev > 0").withColumn("daily_return_pct", (F.col("adj_close") / F.col("prev") - 1) * 100)
    w = _by().rowsBetween(-window, -1)
    r = r.withColumns({"trailing_mean": F.avg("daily_return_pct").over(w), "trailing_stddev": F.stddev_samp("daily_return_pct").over(w), "trailing_observations": F.count("*").over(w)})
    r = r.filter((F.col("trailing_stddev") > 0.05) & (F.col("trailing_observations") >= min_obs)).withColumn("sigma", (F.col("daily_return_pct") - F.col("trailing_mean")) / F.col("trailing_stddev"))
    return r.filter(F.abs("sigma") >= sigma).select("symbol", "trade_date", "close", "daily_return_pct", "trailing_mean", "trailing_stddev", "sigma", "trailing_observations")


def returns_since(bars: DataFrame, start: str) -> DataFrame:
    """Total return from the first bar at or after start to the last bar, in one aggregation."""
    b = bars.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    g = b.groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.min_by("adj_close", "trade_date").alias("a"), F.max_by("adj_close", "trade_date").alias("b"))
    return g.filter("first_date < last_date and a > 0").select("symbol", "first_date", "last_date", ((F.col("b") / F.col("a") - 1) * 100).alias("total_return"))


def chart_series(bars: DataFrame, since: str, interval: str) -> DataFrame:
    """Last bar of each day, week or month since a date; null closes are dropped, never filled."""
    b = bars.filter((F.col("trade_date") >= F.lit(since).cast("date")) & F.col("close").isNotNull())
    g = b.groupBy("symbol", F.date_trunc(interval, "trade_date").cast("date").alias("bucket")).agg(F.max_by(F.struct("trade_date", "close", "adj_close"), "trade_date").alias("r"))
    return g.select("symbol", "bucket", F.col("r.trade_date").alias("t"), F.col("r.close").alias("close"), F.col("r.adj_close").alias("adj_close"))


#: A chart's ranges, as its interval and the months that it goes back (None: to the year's start, 0: all).
RANGES = {"1mo": ("day", 1), "6mo": ("day", 6), "ytd": ("day", None), "1y": ("day", 12), "5y": ("week", 60), "max": ("month", 0)}


def chart_range(bars: DataFrame, name: str, as_of: str) -> DataFrame:
    """chart_series of a named range up to a date. Ranges of days (1d, 5d) need bars within days, which a table of daily
    bars has not."""
    if name not in RANGES:
        raise ValueError(f"no daily bars for {name}")
    interval, months = RANGES[name]
    day = F.lit(as_of).cast("date")
    since = F.trunc(day, "year") if months is None else F.add_months(day, -months)
    shown = bars.filter(F.col("trade_date") <= day) if months == 0 else bars.filter((F.col("trade_date") >= since) & (F.col("trade_date") <= day))
    return chart_series(shown, "0001-01-01", interval)


def security_bundle(bars: DataFrame, dim: DataFrame, fin: DataFrame, scores: DataFrame, as_of: str, short: int = 50, long: int = 200, vol: int = 90) -> DataFrame:
    """Every company of dim up to a date: its last bar, the range and first close of the year up to as_of, averages over
    its last bars, and the ratios of its last annual statement.

    Bars are read and ranked once; one aggregate with conditions gives all price figures. Growth, margins and returns are
    fractions, debt_to_equity is in percent. A ratio is null unless both sides are finite and the divisor is not 0; a
    growth needs a positive base; dividend_rate needs a company that pays. fin: fct_financials rows; a statement without
    grossprofit gives no gross margin. Companies without bars or statements keep nulls.
    """
    day = F.lit(as_of).cast("date")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    b = bars.filter(F.col("trade_date") <= day).withColumn("rn", rank)
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    year = F.col("trade_date") >= F.add_months(day, -12)
    first = lambda c: F.min_by(F.when(year, F.col(c)), F.when(year, F.col("trade_date")))
    last = {"price_as_of": "trade_date", "open": "open", "day_high": "high", "day_low": "low", "close": "close", "volume": "volume"}
    g = b.groupBy("symbol").agg(
        *[at(1, c).alias(k) for k, c in last.items()], at(2, "close").alias("previous_close"), F.max(F.when(year, F.col("high"))).alias("high_52w"), F.min(F.when(year, F.col("low"))).alias("low_52w"), first("close").alias("close_1y_ago"),
        F.avg(F.when(F.col("rn") <= short, F.col("close"))).alias("ma_50"), F.avg(F.when(F.col("rn") <= long, F.col("close"))).alias("ma_200"), F.avg(F.when(F.col("rn") <= vol, F.col("volume"))).alias("avg_volume_90"),
    )
    f = fin.filter("period_type = 'annual' and recency_rank <= 2")
    if "grossprofit" not in fin.columns:
        f = f.withColumn("grossprofit", F.lit(None).cast("double"))
    lines = ["totalrevenue", "grossprofit", "netincome", "operatingincome", "ebitda", "freecashflow", "totaldebt", "cashandcashequivalents", "totalassets", "stockholdersequity", "dilutedaverageshares", "dilutedeps", "cashdividendspaid"]
    of = lambda r, c: F.max(F.when(F.col("recency_rank") == r, F.col(c)))
    f = f.groupBy("symbol").agg(*[of(1, c).alias(c) for c in lines], of(2, "totalrevenue").alias("revenue_0"), of(2, "netincome").alias("income_0"))
    out = dim
    for t in (g, f, scores.select("symbol", "pays_dividend")):
        out = out.join(t, "symbol", "left")
    over = {
        "price_to_sales": ("market_cap", "totalrevenue"), "price_to_book": ("market_cap", "stockholdersequity"), "book_per_share": ("stockholdersequity", "dilutedaverageshares"), "gross_margin": ("grossprofit", "totalrevenue"),
        "profit_margin": ("netincome", "totalrevenue"), "operating_margin": ("operatingincome", "totalrevenue"), "return_on_assets": ("netincome", "totalassets"),
    }
    grown = lambda now, then: F.when(F.col(then) > 0, (F.col(now) - F.col(then)) / F.col(then))
    return out.withColumns({
        "range_position": range_position("close", "low_52w", "high_52w"), "enterprise_value": F.col("market_cap") + F.col("totaldebt") - F.coalesce("cashandcashequivalents", F.lit(0.0)), **{k: safe_ratio(x, y) for k, (x, y) in over.items()},
        "payout_ratio": safe_ratio(F.abs("cashdividendspaid"), "netincome"), "debt_to_equity": safe_ratio("totaldebt", "stockholdersequity") * 100, "dividend_rate": F.when(F.col("pays_dividend"), F.col("dividend_yield_pct") / 100 * F.col("close")),
        "change_52w": grown("close", "close_1y_ago"), "revenue_growth": grown("totalrevenue", "revenue_0"), "earnings_growth": grown("netincome", "income_0"),
    }).drop("revenue_0", "income_0")


#: A profile's groups and their metrics in order, as (label, column of the bundle, kind). Columns of kind
#: share are fractions that are shown in percent; dates are epoch seconds.
PROFILE = {
    "Valuation": [("Market cap", "market_cap", "currency"), ("Enterprise value", "enterprise_value", "currency"), ("P/E (TTM)", "trailing_pe", "ratio"), ("Forward P/E", "forward_pe", "ratio"), ("PEG ratio", "peg_ratio", "ratio"), ("Price / sales", "price_to_sales", "ratio"), ("Price / book", "price_to_book", "ratio"), ("EV / EBITDA", "ev_to_ebitda", "ratio")],
    "Profitability": [("Gross margin", "gross_margin", "share"), ("Operating margin", "operating_margin", "share"), ("Profit margin", "profit_margin", "share"), ("Return on equity", "return_on_equity_pct", "percent"), ("Return on assets", "return_on_assets", "share"), ("Revenue (TTM)", "totalrevenue", "currency"), ("Free cash flow", "freecashflow", "currency"), ("EPS (TTM)", "dilutedeps", "currency")],
    "Growth": [("Revenue growth (YoY)", "revenue_growth", "share"), ("Earnings growth (YoY)", "earnings_growth", "share"), ("Quarterly earnings growth", "quarterly_earnings_growth", "share"), ("52-week change", "change_52w", "share")],
    "Dividend": [("Dividend yield", "dividend_yield_pct", "percent"), ("Annual dividend", "dividend_rate", "currency"), ("Payout ratio", "payout_ratio", "share"), ("5-year average yield", "five_year_avg_dividend_yield_pct", "percent"), ("Ex-dividend date", "ex_dividend_epoch", "date"), ("Next dividend date", "next_dividend_epoch", "date")],
    "Balance sheet": [("Total cash", "cashandcashequivalents", "currency"), ("Total debt", "totaldebt", "currency"), ("Debt / equity", "debt_to_equity", "ratio"), ("Current ratio", "current_ratio", "ratio"), ("Book value / share", "book_per_share", "currency"), ("Shares outstanding", "shares_outstanding", "integer")],
    "Trading": [("Beta (5Y monthly)", "beta", "ratio"), ("Volume", "volume", "integer"), ("Average volume", "avg_volume_90", "integer"), ("50-day average", "ma_50", "currency"), ("200-day average", "ma_200", "currency"), ("Short % of float", "short_percent_of_float", "share")],
}
#: The metrics that a REIT's reported earnings make hard to compare.
EARNINGS_BASED = ("P/E (TTM)", "Forward P/E", "PEG ratio")


def profile_metrics(bundle: DataFrame) -> DataFrame:
    """The 38 metrics of every company as rows: symbol, place (1 to 38), group, label, value, day (of dates), kind,
    comparable (false where a REIT's earnings mislead).

    A metric without a value has no row; the dividend group has rows only with a yield or a rate. The groups are one
    array of structs a company, filtered and exploded in its row, so nothing is shuffled. Columns that the bundle lacks
    count as null.
    """
    b = bundle.withColumn("ev_to_ebitda", safe_ratio("enterprise_value", "ebitda"))
    reit = is_reit_word("industry")
    null = F.lit(None).cast("double")
    rows, place = [], 0
    for group, metrics in PROFILE.items():
        for label, column, kind in metrics:
            place += 1
            v = F.col(column).cast("double") if column in b.columns else null
            v = F.when(~F.isnan(v), v * 100 if kind == "share" else v)
            day = F.timestamp_seconds(v).cast("date") if kind == "date" else F.lit(None).cast("date")
            fields = {"place": F.lit(place), "group": F.lit(group), "label": F.lit(label), "value": null if kind == "date" else v, "day": day, "kind": F.lit("percent" if kind == "share" else kind), "comparable": ~reit if label in EARNINGS_BASED else F.lit(True)}
            rows.append(F.struct(*[c.alias(k) for k, c in fields.items()]))
    pays = F.col("dividend_yield_pct").isNotNull() | F.col("dividend_rate").isNotNull()
    shown = F.filter(F.array(*rows), lambda m: (m["value"].isNotNull() | m["day"].isNotNull()) & ((m["group"] != "Dividend") | pays))
    return b.select("symbol", F.explode(shown).alias("m")).select("symbol", "m.*")


def price_watermarks(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("trade_date").alias("last_date"), F.max_by("close", "trade_date").alias("last_close"))


def detect_restatement(stored: DataFrame, fresh: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Refetched closes of the watermark date that differ from the stored ones by more than the tolerance."""
    r = stored.join(fresh.select("symbol", F.col("trade_date").alias("last_date"), F.col("close").alias("fresh_close")), ["symbol", "last_date"])
    r = r.withColumn("ratio", F.try_divide("fresh_close", "last_close"))
    return r.filter(F.abs(F.col("ratio") - 1) > tolerance).select("symbol", "last_date", "last_close", "fresh_close", "ratio")


def merge_prices(stored: DataFrame, fresh: DataFrame, days: int = 10) -> DataFrame:
    """Stored bars with fresh ones of the last days merged in, fresh winning. One literal bound prunes partitions."""
    top = stored.agg(F.max("trade_date")).first()[0]
    fresh = fresh if top is None else fresh.filter(F.col("trade_date") >= F.date_sub(F.lit(top), days))
    from finquarry.operators import core

    v = core.fresh(stored.columns, "_v")
    both = stored.withColumn(v, F.lit(0)).unionByName(fresh.withColumn(v, F.lit(1)))
    return core.latest_wins(both, ["symbol", "trade_date"], [v]).drop(v)

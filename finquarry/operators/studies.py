"""Studies across companies: comparison, grades against returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import annualise
from finquarry.operators.prices import returns_since

LADDER = ["A+", "A", "B+", "B", "C+", "C", "D", "F", "ungraded"]


def compare_rebased(history: DataFrame, symbols: DataFrame, start_value: float = 10_000.0) -> DataFrame:
    """Growth of equal stakes from the latest of the first dates: price, total and dividend part, in percent."""
    h = history.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    first = h.groupBy("symbol").agg(F.min("t").alias("first"))
    h = h.filter(F.col("t") >= first.agg(F.max("first")).scalar())
    g = h.groupBy("symbol").agg(F.count("*").alias("points"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("close", "t").alias("c0"), F.max_by("close", "t").alias("c1"), F.min_by("adj_close", "t").alias("a0"), F.max_by("adj_close", "t").alias("a1"))
    g = g.filter("points >= 2 and c0 > 0 and a0 > 0").withColumns({"price_return": (F.col("c1") / F.col("c0") - 1) * 100, "total_return": (F.col("a1") / F.col("a0") - 1) * 100, "years": F.datediff("t1", "t0") / 365.25})
    part = F.col("total_return") - F.col("price_return")
    return g.select("symbol", F.col("t0").alias("start"), F.col("t1").alias("last"), "price_return", "total_return", part.alias("dividend_contribution"), F.when(F.col("total_return") > 0, part / F.col("total_return") * 100).alias("dividend_share"), annualise("total_return", "years").alias("cagr"), (F.lit(start_value) * F.col("a1") / F.col("a0")).alias("final_value"))


def grades_as_of(timeline: DataFrame, day: str) -> DataFrame:
    """Last grade in force at a date, inclusive."""
    t = timeline.filter((F.col("period") <= F.lit(day).cast("date")) & F.col("grade").isNotNull())
    return t.groupBy("symbol").agg(F.max_by("grade", "period").alias("grade"))


def grade_portfolios(returns: DataFrame, grades: DataFrame, years: float) -> DataFrame:
    """Returns by grade, ungraded companies included; best and worst member; annualised from one year on."""
    r = returns.select("symbol", "total_return").join(grades, "symbol", "left").withColumn("grade", F.coalesce("grade", F.lit("ungraded")))
    pair = F.struct("total_return", "symbol")
    g = r.groupBy("grade").agg(F.count("*").alias("companies"), F.avg("total_return").alias("mean_return"), F.median("total_return").alias("median_return"), F.max(pair)["symbol"].alias("best"), F.min(pair)["symbol"].alias("worst"), F.sum((F.col("total_return") > 0).cast("long")).alias("positive"))
    rank = F.array_position(F.array(*map(F.lit, LADDER)), F.col("grade"))
    return g.withColumns({"annualised": annualise("mean_return", F.lit(float(years))), "ladder": rank.cast("long")})


def window_returns(bars: DataFrame, windows: dict[str, tuple[str, float]]) -> DataFrame:
    """(window, symbol, first_date, last_date, total_return) of every symbol in every named window (start, years): from
    its first bar at or after the start to its last bar. One scan and one aggregate for all windows."""
    day = {n: F.lit(start).cast("date") for n, (start, _) in windows.items()}
    since = {n: F.min(F.when(F.col("trade_date") >= d, F.struct("trade_date", "adj_close"))) for n, d in day.items()}
    g = bars.groupBy("symbol").agg(F.max(F.struct("trade_date", "adj_close")).alias("last"), *[c.alias(f"w{k}") for k, c in enumerate(since.values())])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"w{k}").alias("first")) for k, n in enumerate(windows)]))
    g = g.select("symbol", "last", each.alias("e")).select("e.window", "symbol", F.col("e.first.trade_date").alias("first_date"), F.col("last.trade_date").alias("last_date"), F.col("e.first.adj_close").alias("a"), F.col("last.adj_close").alias("b"))
    return g.filter("first_date < last_date and a > 0").select("window", "symbol", "first_date", "last_date", ((F.col("b") / F.col("a") - 1) * 100).alias("total_return"))


def window_grades(timeline: DataFrame, windows: dict[str, tuple[str, float]]) -> DataFrame:
    """(window, symbol, grade): the grade in force at each window's start, in one aggregate."""
    at = {n: F.max_by("grade", F.when((F.col("period") <= F.lit(start).cast("date")) & F.col("grade").isNotNull(), F.col("period"))) for n, (start, _) in windows.items()}
    g = timeline.groupBy("symbol").agg(*[c.alias(f"w{k}") for k, c in enumerate(at.values())])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"w{k}").alias("grade")) for k, n in enumerate(windows)]))
    return g.select("symbol", each.alias("e")).select("e.window", "symbol", "e.grade").filter("grade is not null")


def _in_windows(bars: DataFrame, windows: dict[str, tuple[str, float]], slack_days: int) -> DataFrame:
    """window_returns of symbols that have a bar near their window's start."""
    start = F.create_map(*[F.lit(x) for n, (s, _) in windows.items() for x in (n, s)])
    return window_returns(bars, windows).filter(F.col("first_date") <= F.date_add(start[F.col("window")].cast("date"), slack_days))


def grade_study(bars: DataFrame, timeline: DataFrame, windows: dict[str, tuple[str, float]], least: int = 20, slack_days: int = 10) -> DataFrame:
    """Returns by grade, ungraded companies included, in each named window (start, years) that covers `least` symbols."""
    r = _in_windows(bars, windows, slack_days).join(window_grades(timeline, windows), ["window", "symbol"], "left")
    g = _by_grade(r.withColumn("grade", F.coalesce("grade", F.lit("ungraded"))), windows)
    covered = F.sum("companies").over(Window.partitionBy("window"))  # at most nine rows a window
    return g.filter("grade is not null").withColumn("covered", covered).filter(F.col("covered") >= least).drop("covered", "best_return", "worst_return")


def _by_grade(r: DataFrame, windows: dict[str, tuple[str, float]]) -> DataFrame:
    """Figures of each (window, grade), and of each window with a null grade, from one aggregate over both groupings."""
    pair = F.struct("total_return", "symbol")
    g = r.groupingSets([["window", "grade"], ["window"]], "window", "grade").agg(
        F.grouping("grade").alias("whole"), F.count("*").alias("companies"), F.avg("total_return").alias("mean_return"), F.median("total_return").alias("median_return"), F.max(pair).alias("best"), F.min(pair).alias("worst"),
        F.sum((F.col("total_return") > 0).cast("long")).alias("positive"),
    )
    years = F.create_map(*[F.lit(x) for n, (_, y) in windows.items() for x in (n, float(y))])
    rank = F.array_position(F.array(*map(F.lit, LADDER)), F.col("grade")).cast("long")
    g = g.filter("whole = 1 or grade is not null").withColumns({"annualised": annualise("mean_return", years[F.col("window")]), "ladder": rank})
    return g.select("window", "grade", "companies", "mean_return", "median_return", F.col("best.symbol").alias("best"), F.col("best.total_return").alias("best_return"), F.col("worst.symbol").alias("worst"), F.col("worst.total_return").alias("worst_return"), "positive", "annualised", "ladder")


def grade_study_tables(bars: DataFrame, timeline: DataFrame, windows: dict[str, tuple[str, float]], current: DataFrame | None = None, least: int = 20, slack_days: int = 10) -> tuple[DataFrame, DataFrame]:
    """(grades, windows): the portfolios by grade of every available window, and one row for each window.

    Grades are those in force at a window's start, or today's (symbol, grade) if current is given. A window whose prices
    cover fewer than `least` symbols, or in which no company has a grade, has a row with available false and the reason,
    and no grades. The universe counts companies without a grade too; spread is the best grade's mean less the worst's.
    """
    grades = window_grades(timeline, windows) if current is None else current.select("symbol", "grade")
    on = ["window", "symbol"] if current is None else ["symbol"]
    g = _by_grade(_in_windows(bars, windows, slack_days).join(grades, on, "left"), windows)
    graded = F.col("grade").isNotNull()
    top, low = F.min(F.when(graded, F.struct("ladder", "grade", "mean_return"))), F.max(F.when(graded, F.struct("ladder", "grade", "mean_return")))
    w = g.groupBy("window").agg(F.max(F.when(~graded, F.col("companies"))).alias("covered"), F.max(F.when(~graded, F.col("mean_return"))).alias("universe_mean"), top.alias("top"), low.alias("low"), F.count(F.when(graded, 1)).alias("n"))
    asked = bars.sparkSession.createDataFrame([(n, s, float(y)) for n, (s, y) in windows.items()], "window string, start string, years double").withColumn("start", F.col("start").cast("date"))
    w = asked.join(w, "window", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    why = F.when(F.col("covered") < least, "price history does not reach back this far").when(F.col("n") == 0, "no company could be graded as at this date")
    w = w.withColumn("reason", why)
    seen = lambda c: F.when(F.col("reason").isNull(), c)
    out = w.select("window", "years", "start", F.col("reason").isNull().alias("available"), "reason", "covered", seen(F.col("universe_mean")).alias("universe_mean"), seen(F.col("top.grade")).alias("top_grade"), seen(F.col("low.grade")).alias("bottom_grade"), seen(F.when(F.col("n") >= 2, F.col("top.mean_return") - F.col("low.mean_return"))).alias("spread"))
    return g.filter(graded).join(F.broadcast(out.filter("available").select("window")), "window"), out

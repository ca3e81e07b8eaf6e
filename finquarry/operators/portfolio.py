"""Wallets: parsing, valuation, value series, returns, scores, income, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import annualise, cagr
from finquarry.operators.core import asof_join, fresh


def exact_sum(c):
    """A sum of money to six places, the same in whatever order its parts come."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def _wallet():
    return Window.partitionBy("wallet_id")


def parse_wallet_strings(wallets: DataFrame, today: str, most: int = 40) -> DataFrame:
    """(wallet_id, spec) to holdings: SYM:shares:cost:date, comma separated; the first mention of a symbol counts."""
    p = wallets.select("wallet_id", F.posexplode(F.split("spec", ",")).alias("pos", "item"))
    part = F.split("item", ":")
    get = lambda i: F.nullif(F.trim(F.try_element_at(part, F.lit(i))), F.lit(""))
    cost, day = get(3).try_cast("double"), F.try_to_date(get(4), "yyyy-MM-dd")
    p = p.select("wallet_id", "pos", F.upper(get(1)).alias("symbol"), get(2).try_cast("double").alias("shares"), F.when(cost >= 0, cost).alias("cost"), F.when((F.date_format(day, "yyyy-MM-dd") == get(4)) & (day <= F.lit(today).cast("date")), day).alias("bought_at"))
    p = p.filter(F.col("symbol").rlike(r"^[A-Z0-9.^=\-]{1,20}$") & (F.col("shares") > 0))
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("wallet_id", "symbol").orderBy("pos"))).filter("n = 1")  # p has these columns only
    return first.withColumn("n", F.row_number().over(_wallet().orderBy("pos"))).filter(F.col("n") <= most).drop("n", "pos")


def price_holdings(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Value, day change, gain and weight of each holding; unpriced ones keep nulls."""
    h = holdings.join(quotes.select("symbol", "close", "previous_close"), "symbol", "left")
    h = h.withColumns({"value": F.col("shares") * F.col("close"), "day_change": F.col("shares") * (F.col("close") - F.col("previous_close")), "cost_total": F.col("shares") * F.col("cost")})
    return h.select("wallet_id", "symbol", "shares", "value", "day_change", "cost_total", (F.col("value") - F.col("cost_total")).alias("gain"), (F.try_divide(F.col("value"), F.sum("value").over(_wallet())) * 100).alias("weight_pct"))


def wallet_totals(priced: DataFrame) -> DataFrame:
    both = F.col("value").isNotNull() & F.col("cost_total").isNotNull()
    return priced.groupBy("wallet_id").agg(exact_sum(F.col("value")).alias("value"), exact_sum(F.col("day_change")).alias("day_change"), exact_sum(F.when(both, F.col("gain"))).alias("gain"), (F.try_divide(exact_sum(F.when(both, F.col("value"))), exact_sum(F.col("value"))) * 100).alias("cost_coverage_pct"), F.count("*").alias("holdings"))


def best_worst_movers(priced: DataFrame) -> DataFrame:
    s = F.struct("day_change", "symbol")
    return priced.filter("day_change is not null").groupBy("wallet_id").agg(F.max(s)["symbol"].alias("best"), F.min(s)["symbol"].alias("worst"))


def _value_points(holdings: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wallet_id, trade_date, value, held, missing) on every date of a wallet's symbols, and holdings with `priced`.

    A purchase and each change of a price are events with what they add to a wallet's value, to what it holds and to
    what it holds without a price. Events of a date are added up, then the dates in one order a wallet; no date meets a
    holding that has no event on it. Amounts are decimals, so the sums do not depend on their order.
    """
    money = lambda c: c.cast("decimal(28,6)")
    quoted = prices.filter("close is not null").select("symbol", "trade_date", "close")
    quoted = quoted.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date")))
    firsts = quoted.filter("before is null").select("symbol", F.col("trade_date").alias("first_quote"))
    known = holdings.select("wallet_id", "symbol", "shares", "bought_at").join(firsts, "symbol", "left").withColumn("priced", F.col("first_quote").isNotNull())
    mine = known.filter("priced")

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counts = F.col("bought_at").isNull() | (F.col("trade_date") > F.col("bought_at"))
    step = money(F.col("shares") * F.col("close")) - F.coalesce(money(F.col("shares") * F.col("before")), F.lit(0).cast("decimal(28,6)"))
    moves = mine.select("symbol", "wallet_id", "shares", "bought_at").join(quoted, "symbol")
    moves = moves.select("wallet_id", "trade_date", F.when(counts, step).alias("dv"), zero.alias("dh"), F.when(counts & F.col("before").isNull(), -one).otherwise(zero).alias("dm"), F.lit(True).alias("quoted"))
    bought = asof_join(mine.filter("bought_at is not null"), quoted, "symbol", "bought_at", "trade_date", ["close"])
    buys = bought.select("wallet_id", F.col("bought_at").alias("trade_date"), money(F.col("shares") * F.col("close")).alias("dv"), one.alias("dh"), F.when(F.col("close").isNull(), one).otherwise(zero).alias("dm"), F.lit(False).alias("quoted"))
    always = mine.filter("bought_at is null").select("wallet_id", F.lit("0001-01-01").cast("date").alias("trade_date"), F.lit(None).cast("decimal(28,6)").alias("dv"), one.alias("dh"), one.alias("dm"), F.lit(False).alias("quoted"))
    g = moves.unionByName(buys).unionByName(always).groupBy("wallet_id", "trade_date").agg(F.sum("dv").alias("dv"), F.sum("dh").alias("dh"), F.sum("dm").alias("dm"), F.max("quoted").alias("quoted"))
    w = _wallet().orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    sums = g.select("wallet_id", "trade_date", "quoted", F.sum("dv").over(w).cast("double").alias("value"), F.sum("dh").over(w).alias("held"), F.sum("dm").over(w).alias("missing"))
    return sums.filter("quoted").drop("quoted"), known


def value_series(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Wallet value on every date of its symbols. Prices carry forward; a holding counts from its purchase, without a
    date from the start; a date with a held symbol that has no price yet is withheld, as are dates with none held.
    Holdings whose symbol is never quoted are left out (see series_coverage)."""
    return _value_points(holdings, prices)[0].filter("held > 0 and missing = 0").drop("missing")


def series_start(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Where each wallet's series starts and why: purchase if nothing was held on an earlier quoted date, else coverage
    (null without a point); with the first purchase among quoted holdings and the number of points."""
    points, known = _value_points(holdings, prices)
    shown = (F.col("held") > 0) & (F.col("missing") == 0)
    g = points.groupBy("wallet_id").agg(F.min(F.when(shown, F.col("trade_date"))).alias("started_at"), F.coalesce(F.bool_or(F.col("held") == 0), F.lit(False)).alias("unheld"), F.count(F.when(shown, 1)).alias("points"))
    first = known.groupBy("wallet_id").agg(F.min(F.when(F.col("priced"), F.col("bought_at"))).alias("first_purchase"))
    why = F.when(F.col("started_at").isNotNull(), F.when(F.col("unheld"), "purchase").otherwise("coverage"))
    return first.join(g, "wallet_id", "left").select("wallet_id", "started_at", why.alias("start_reason"), "first_purchase", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def series_contributions(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Quoted holdings that join after a wallet's series has started: the series steps there without a return."""
    started = series_start(holdings, prices).select("wallet_id", "started_at")
    firsts = prices.filter("close is not null").select("symbol").distinct()
    h = holdings.join(firsts, "symbol", "left_semi").join(started, "wallet_id").filter(F.col("bought_at") > F.col("started_at"))
    return h.select("wallet_id", "symbol", F.col("bought_at").alias("joined_at"))


def series_coverage(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Whether each holding's symbol is quoted at all."""
    known = prices.filter("close is not null").select("symbol", F.lit(True).alias("priced")).distinct()
    return holdings.select("wallet_id", "symbol").join(known, "symbol", "left").select("wallet_id", "symbol", F.coalesce("priced", F.lit(False)).alias("priced"))


def range_change(series: DataFrame) -> DataFrame:
    g = series.groupBy("wallet_id").agg(F.min_by("value", "trade_date").alias("a"), F.max_by("value", "trade_date").alias("b"))
    return g.select("wallet_id", (F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 100).alias("change_pct"))


def time_weighted_return(series: DataFrame) -> DataFrame:
    """Segments between changes of what is held, their growths multiplied; one-point segments do not count. With the
    years from the first point to the last, and the yearly rate from one year on."""
    w = Window.partitionBy("wallet_id").orderBy("trade_date")
    s = series.withColumn("cut", F.coalesce((F.col("held") != F.lag("held").over(w)).cast("int"), F.lit(0)))
    s = s.withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("wallet_id", "segment").agg(F.count("*").alias("n"), F.min_by("value", "trade_date").alias("a"), F.max_by("value", "trade_date").alias("b"), F.min("trade_date").alias("since"), F.max("trade_date").alias("until"))
    counts = (F.col("n") > 1) & (F.col("a") > 0) & (F.col("b") > 0)
    g = g.groupBy("wallet_id").agg(((F.product(F.when(counts, F.col("b") / F.col("a"))) - 1) * 100).alias("twr_pct"), F.count(F.when(counts, 1)).alias("segments"), (F.datediff(F.max("until"), F.min("since")) / 365.25).alias("years"))
    return g.filter("segments > 0").withColumn("annualised_pct", annualise("twr_pct", "years"))


def portfolio_score_current(holdings: DataFrame, quotes: DataFrame, scores: DataFrame) -> DataFrame:
    """Value-weighted score of graded holdings, and the share of value that is graded."""
    h = holdings.join(quotes.select("symbol", "close"), "symbol", "left").join(scores.select("symbol", "overall_score"), "symbol", "left").withColumn("value", F.col("shares") * F.col("close"))
    ok = F.col("overall_score").isNotNull() & F.col("value").isNotNull()
    return h.groupBy("wallet_id").agg(F.try_divide(F.sum(F.when(ok, F.col("value") * F.col("overall_score"))), F.sum(F.when(ok, F.col("value")))).alias("score"), (F.try_divide(F.sum(F.when(ok, F.col("value"))), F.sum("value")) * 100).alias("coverage_pct"))


def portfolio_excluded(holdings: DataFrame, quotes: DataFrame, scores: DataFrame) -> DataFrame:
    unpriced = holdings.join(quotes, "symbol", "left_anti").select("wallet_id", "symbol", F.lit("no price").alias("reason"))
    ungraded = holdings.join(quotes, "symbol", "left_semi").join(scores.filter("overall_score is not null"), "symbol", "left_anti").select("wallet_id", "symbol", F.lit("no score").alias("reason"))
    return unpriced.unionByName(ungraded)


def group_by_facet(priced: DataFrame, facet: str, keep: int = 5) -> DataFrame:
    """Value by facet, null as Unclassified; beyond keep + 1 groups the smaller ones fold into Other. symbols lists a
    group's members and folded_labels the labels that Other took in, largest first (null for the other groups)."""
    n, of = fresh(priced.columns, "_rank"), fresh(priced.columns, "_groups")
    g = priced.filter("value > 0").groupBy("wallet_id", F.coalesce(facet, F.lit("Unclassified")).alias("label")).agg(F.sum("value").alias("value"), F.count("*").alias("members"), F.sort_array(F.collect_list("symbol")).alias("symbols"))
    g = g.withColumns({n: F.row_number().over(_wallet().orderBy(F.desc("value"), "label")), of: F.count("*").over(_wallet())})
    fold = (F.col(of) > keep + 1) & (F.col(n) > keep)
    g = g.groupBy("wallet_id", F.when(fold, F.lit("Other")).otherwise(F.col("label")).alias("shown"), fold.alias("other")).agg(
        F.sum("value").alias("value"), F.sum("members").alias("members"), F.count("*").alias("folded"), F.array_sort(F.flatten(F.collect_list("symbols"))).alias("symbols"), F.sort_array(F.collect_list(F.struct(n, "label"))).alias("labels")
    )
    share = F.col("value") / F.sum("value").over(_wallet()) * 100
    return g.select("wallet_id", F.col("shown").alias("label"), "value", "members", "folded", "symbols", F.when(F.col("other"), F.transform("labels", lambda x: x["label"])).alias("folded_labels"), share.alias("share_pct"))


def dividend_income(holdings: DataFrame, div: DataFrame, as_of: str) -> DataFrame:
    """Payments received: bought before the ex-date, ex-date up to as_of."""
    h = holdings.filter("bought_at is not null").select("wallet_id", "symbol", "shares", "bought_at")
    d = div.join(h, "symbol").filter((F.col("bought_at") < F.col("pay_date")) & (F.col("pay_date") <= F.lit(as_of).cast("date")))
    return d.select("wallet_id", "symbol", F.col("pay_date").alias("ex_date"), "amount", (F.col("shares") * F.col("amount")).alias("income"))


def income_excluded(holdings: DataFrame, div: DataFrame, income: DataFrame) -> DataFrame:
    h = holdings.select("wallet_id", "symbol", "bought_at").join(income.select("wallet_id", "symbol").distinct().withColumn("paid", F.lit(True)), ["wallet_id", "symbol"], "left")
    h = h.join(div.select("symbol").distinct().withColumn("known", F.lit(True)), "symbol", "left").filter("paid is null")
    return h.select("wallet_id", "symbol", F.when(F.col("bought_at").isNull(), "no-purchase-date").when(F.col("known").isNull(), "no-dividend-record").otherwise("none-since-purchase").alias("reason"))


def income_by_month(income: DataFrame) -> DataFrame:
    """Every month from a wallet's first to its last payment, zero where nothing was paid."""
    m = income.groupBy("wallet_id", F.trunc("ex_date", "MM").alias("month")).agg(F.sum("income").alias("income"))
    span = m.groupBy("wallet_id").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("wallet_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return span.join(m, ["wallet_id", "month"], "left").select("wallet_id", "month", F.coalesce("income", F.lit(0.0)).alias("income"))


def income_by_symbol(income: DataFrame) -> DataFrame:
    return income.groupBy("wallet_id", "symbol").agg(F.sum("income").alias("income"), F.count("*").alias("payments"), F.min("ex_date").alias("first_ex"), F.max("ex_date").alias("last_ex"))


def income_totals(income: DataFrame, as_of: str) -> DataFrame:
    recent = F.col("ex_date") > F.date_sub(F.lit(as_of).cast("date"), 365)
    return income.groupBy("wallet_id").agg(F.sum("income").alias("total"), F.coalesce(F.sum(F.when(recent, F.col("income"))), F.lit(0.0)).alias("trailing_12m"), F.count("*").alias("payments"))


def income_summary(income: DataFrame, as_of: str) -> DataFrame:
    """Totals of each wallet with the mean of its completed months (null without one) and its best month, the earliest
    of equals. Months count in whole cents, so that ties do not depend on the order of addition."""
    day = F.lit(as_of).cast("date")
    m = income_by_month(income).withColumn("c", F.round(F.col("income") * 100).cast("long"))
    done = F.col("month") < F.trunc(day, "MM")
    months = m.groupBy("wallet_id").agg((F.sum(F.when(done, F.col("c"))) / F.count(F.when(done, 1)) / 100.0).alias("monthly_average"), F.max_by("month", F.struct("c", -F.unix_date("month"))).alias("best_month"), (F.max("c") / 100.0).alias("best_amount"))
    more = income.groupBy("wallet_id").agg(F.countDistinct("symbol").alias("symbols"), F.min("ex_date").alias("first_ex"))
    return income_totals(income, as_of).join(more, "wallet_id").join(months, "wallet_id")


def projection_rows(holdings: DataFrame, div: DataFrame, totals: DataFrame, as_of: str) -> DataFrame:
    """Each holding's trailing year of income with its dividend growth over up to six yearly totals, the years that it
    spans and whether it is too fast to last (over 20 percent). reason says why a holding has no projection: no payment
    on record up to as_of, or none in the last year; its figures are null then. No growth rate means a flat projection."""
    day = F.lit(as_of).cast("date")
    t = totals.filter("window_index <= 5").groupBy("symbol").agg(F.max_by("amount", "window_index").alias("old"), F.min_by("amount", "window_index").alias("new"), F.max("window_index").alias("years_of_growth"))
    paid = F.when(F.col("pay_date") > F.date_sub(day, 365), F.round(F.col("amount") * 100).cast("long"))
    record = div.filter(F.col("pay_date") <= day).groupBy("symbol").agg((F.sum(paid) / 100.0).alias("per_share"), F.lit(True).alias("known"))
    h = holdings.select("wallet_id", "symbol", "shares").join(record.join(t, "symbol", "left"), "symbol", "left")
    reason = F.when(F.col("known").isNull(), "no-dividend-record").when(~F.coalesce(F.col("per_share") > 0, F.lit(False)), "nothing-paid-in-the-last-year")
    h = h.withColumn("reason", reason).withColumn("growth_pct", F.when(F.col("reason").isNull(), cagr("old", "new", "years_of_growth")))
    shown = lambda c: F.when(F.col("reason").isNull(), c)
    return h.select("wallet_id", "symbol", shown(F.col("shares") * F.col("per_share")).alias("current_annual"), "growth_pct", shown(F.col("years_of_growth")).alias("years_of_growth"), shown(F.coalesce(F.col("growth_pct") > 20, F.lit(False))).alias("fast_growth"), "reason")


def projection_totals(rows: DataFrame) -> DataFrame:
    """Each wallet's projected income, growth weighted by income, and the share of income that has a growth rate."""
    r = rows.filter("reason is null").withColumn("rated", F.when(F.col("growth_pct").isNotNull(), F.col("current_annual")))
    g = r.groupBy("wallet_id").agg(F.sum("current_annual").alias("current_annual"), F.sum("rated").alias("rated"), F.sum(F.col("growth_pct") * F.col("rated")).alias("weighted"))
    return g.select("wallet_id", "current_annual", F.try_divide("weighted", "rated").alias("blended_growth"), F.when(F.col("current_annual") > 0, F.coalesce("rated", F.lit(0.0)) / F.col("current_annual") * 100).alias("rated_share"))


def income_projection(holdings: DataFrame, div: DataFrame, totals: DataFrame, as_of: str, years: int = 10) -> DataFrame:
    """Trailing year's income grown by each holding's dividend CAGR over up to six yearly totals."""
    years = max(1, min(30, years))
    t = totals.filter("window_index <= 5").groupBy("symbol").agg(F.max_by("amount", "window_index").alias("old"), F.min_by("amount", "window_index").alias("new"), F.max("window_index").alias("n"))
    recent = div.filter((F.col("pay_date") > F.date_sub(F.lit(as_of).cast("date"), 365)) & (F.col("pay_date") <= F.lit(as_of).cast("date"))).groupBy("symbol").agg(F.sum("amount").alias("per_share"))
    h = holdings.join(recent, "symbol").join(t, "symbol", "left").withColumn("g", F.coalesce(cagr("old", "new", "n"), F.lit(0.0)))
    h = h.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    return h.groupBy("wallet_id", F.col("year").cast("long").alias("year")).agg(F.sum(F.col("shares") * F.col("per_share") * F.pow(1 + F.col("g") / 100, F.col("year"))).alias("income"))


def income_goal(wallets: DataFrame, target: float, rate_pct: float, as_of: str | None = None) -> DataFrame:
    """What a target income asks for at a withdrawal rate, and how far each wallet (value, annual_income) is.

    A withdrawal, today's and at the target, is split into what dividends cover at today's yield, what has to be sold,
    and what dividends leave over. With start_value, started_at and contributions (a count) the growth since the start
    is told, and its yearly rate where nothing was paid in and a year has passed up to as_of. progress_pct ends at 100,
    reached_pct goes on. Wallets without a value above 0 keep their row with reason no-value and nulls; a null income
    counts as 0.
    """
    if not target > 0 or not rate_pct > 0:
        raise ValueError("target and rate must be above 0")
    rate, need = rate_pct / 100, F.lit(target / (rate_pct / 100))
    ok = F.coalesce(F.col("value") > 0, F.lit(False))
    w = wallets.withColumns({"_value": F.when(ok, F.col("value")), "_share": F.when(ok, F.coalesce("annual_income", F.lit(0.0)) / F.col("value"))})
    value, share = F.col("_value"), F.col("_share")
    out = {"reason": F.when(~ok, "no-value"), "required_value": F.when(ok, need), "progress_pct": F.least(F.lit(100.0), value / need * 100), "reached_pct": value / need * 100, "yield_pct": share * 100, "shortfall": F.greatest(F.lit(0.0), need - value), "value_for_dividends_alone": F.when(share > 0, F.lit(target) / share)}
    out["progress_pct"], out["shortfall"] = F.when(ok, out["progress_pct"]), F.when(ok, out["shortfall"])  # least and greatest skip nulls
    for name, v in (("today", value), ("at_target", F.when(ok, need))):
        draw, paid = v * rate, v * share
        out |= {f"withdrawal_{name}": draw, f"dividends_{name}": paid, f"from_dividends_{name}": F.when(ok, F.least(paid, draw)), f"from_sales_{name}": F.when(ok, F.greatest(F.lit(0.0), draw - paid)), f"surplus_{name}": F.when(ok, F.greatest(F.lit(0.0), paid - draw))}
    out["covered_pct"] = F.when(ok, F.least(F.lit(100.0), share / rate * 100))
    if as_of and {"start_value", "started_at", "contributions"} <= set(wallets.columns):
        years = F.greatest(F.lit(0.0), F.datediff(F.lit(as_of).cast("date"), "started_at") / 365.25)
        grew = F.when(F.col("start_value") > 0, (value / F.col("start_value") - 1) * 100)
        out |= {"years": years, "grew_by_pct": grew, "annualised_pct": F.when(F.coalesce("contributions", F.lit(0)) == 0, annualise(grew, years))}
    return w.select("wallet_id", *[c.alias(k) for k, c in out.items()])


def _payment(gap: Column, rate: Column, periods: Column | float) -> Column:
    """The regular payment that grows to gap."""
    return F.when(F.abs(rate) < 1e-15, gap / periods).otherwise(gap * rate / (F.pow(1 + rate, F.lit(periods) if isinstance(periods, float | int) else periods) - 1))


def _contribution(value: Column, required: float, years: float, return_pct: Column) -> dict[str, Column]:
    r = return_pct / 100
    grown = value * F.pow(1 + r, F.lit(float(years)))
    gap, there = F.lit(required) - grown, grown >= F.lit(required)
    monthly = F.pow(1 + r, F.lit(1.0 / 12)) - 1
    return {"per_year": F.when(there, 0.0).otherwise(_payment(gap, r, float(years))), "per_month": F.when(there, 0.0).otherwise(_payment(gap, monthly, years * 12.0)), "future_value": grown, "already_there": there, "shortfall_at_target": F.when(there, 0.0).otherwise(gap)}


def required_contribution(wallets: DataFrame, required: float, years: float, return_pct: float) -> DataFrame:
    """Yearly and monthly payments that grow value to the required one; 0 where it gets there alone. Monthly payments
    compound monthly, so they are less than a twelfth. Null or negative values have nulls."""
    c = _contribution(F.when(F.col("value") >= 0, F.col("value")), required, years, F.lit(float(return_pct)))
    return wallets.select("wallet_id", *[x.alias(k) for k, x in c.items()])


def portfolio_score_history(holdings: DataFrame, prices: DataFrame, timeline: DataFrame, dates: list[str]) -> DataFrame:
    """Value-weighted score of each wallet at each date, from prices and scores in force then. dates: one a month."""
    at = F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("at")
    h = holdings.select("wallet_id", "symbol", "shares", "bought_at", at)
    h = h.filter(F.col("bought_at").isNull() | (F.col("bought_at") <= F.col("at")))
    h = asof_join(h, prices, "symbol", "at", "trade_date", ["close"])
    h = asof_join(h, timeline, "symbol", "at", "period", ["overall_score"]).withColumn("value", F.col("shares") * F.col("close"))
    ok = F.col("overall_score").isNotNull() & F.col("value").isNotNull()
    graded = F.sum(F.when(ok, F.col("value")))
    return h.groupBy("wallet_id", "at").agg(F.try_divide(F.sum(F.when(ok, F.col("value") * F.col("overall_score"))), graded).alias("score"), (F.try_divide(graded, F.sum("value")) * 100).alias("coverage_pct"))


def portfolio_score_series(holdings: DataFrame, closes: DataFrame, timeline: DataFrame) -> DataFrame:
    """(wallet_id, t, score, coverage_pct) on every date of a wallet's closes, for instance month ends: the score of what
    is held and graded then, weighted by value, and the graded share of the value held.

    Closes and scores of a symbol are laid in one order, so each change of either is one event with what it adds to a
    wallet's held value, graded value and weighted score. Purchases are events too. Dates are sums over events, and no date
    meets a holding that has no event on it. Scores are exact to six places. Dates without graded value are left out.
    closes: (symbol, t, close); timeline: (symbol, period, overall_score).
    """
    num = "decimal(32,6)"
    line = closes.filter("close is not null").select("symbol", "t", "close", F.lit(None).cast("double").alias("score"), F.lit(True).alias("quoted"))
    held = holdings.select("symbol").distinct()  # scores of other symbols add nothing
    scored = timeline.join(held, "symbol", "left_semi").filter("overall_score is not null").select("symbol", F.col("period").alias("t"), F.lit(None).cast("double").alias("close"), F.col("overall_score").cast("double").alias("score"), F.lit(False).alias("quoted"))
    day = line.unionByName(scored).groupBy("symbol", "t").agg(F.max("close").alias("close"), F.max("score").alias("score"), F.max("quoted").alias("quoted"))
    w = Window.partitionBy("symbol").orderBy("t")
    now = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("close", "score")}
    state = day.withColumns(now)
    before = {f"{c}_0": F.lag(c).over(w) for c in ("close", "score")}
    state = state.withColumns(before)

    def sums(close: Column, score: Column) -> list[Column]:
        value = F.col("shares") * close
        parts = [value, F.when(score.isNotNull(), value), value * score]
        return [F.coalesce(p.cast(num), F.lit(0).cast(num)) for p in parts]

    names = ["held_value", "graded_value", "weighted"]
    h = holdings.select("wallet_id", "symbol", "shares", "bought_at")
    moves = h.join(state, "symbol").withColumn("own", F.col("bought_at").isNull() | (F.col("t") > F.col("bought_at")))
    changes = [F.when(F.col("own"), a - b).otherwise(F.lit(0).cast(num)).alias(n) for n, a, b in zip(names, sums(F.col("close"), F.col("score")), sums(F.col("close_0"), F.col("score_0")), strict=True)]
    moves = moves.select("wallet_id", "t", *changes, "quoted")
    bought = asof_join(h.filter("bought_at is not null"), state, "symbol", "bought_at", "t", ["close", "score"])
    buys = bought.select("wallet_id", F.col("bought_at").alias("t"), *[c.alias(n) for n, c in zip(names, sums(F.col("close"), F.col("score")), strict=True)], F.lit(False).alias("quoted"))
    g = moves.unionByName(buys).groupBy("wallet_id", "t").agg(*[F.sum(n).alias(n) for n in names], F.max("quoted").alias("quoted"))
    run = _wallet().orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("wallet_id", "t", "quoted", *[F.sum(n).over(run).cast("double").alias(n) for n in names]).filter("quoted and graded_value > 0")
    return g.select("wallet_id", "t", (F.col("weighted") / F.col("graded_value")).alias("score"), F.when(F.col("held_value") > 0, F.col("graded_value") / F.col("held_value") * 100).alias("coverage_pct"))


def slice_shares(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Shares of the total in percent; non-positive values are dropped and counted."""
    w = Window.partitionBy(key)
    s = df.withColumn("dropped", F.sum((F.coalesce(F.col(value), F.lit(0.0)) <= 0).cast("long")).over(w)).filter(F.col(value) > 0)
    return s.select(key, label, value, (F.col(value) / F.sum(value).over(w) * 100).alias("share_pct"), "dropped")


def goal_progress_series(series: DataFrame, required: float | DataFrame) -> DataFrame:
    """Each point in percent of the required value: one for all wallets, or each wallet's own out of income_goal."""
    if not isinstance(required, DataFrame):
        return series.select("wallet_id", "trade_date", (F.col("value") * 100 / F.lit(required)).alias("progress_pct"))  # one rounding, not two
    own = required.filter("required_value is not null").select("wallet_id", "required_value")  # a row a wallet
    return series.join(own, "wallet_id").select("wallet_id", "trade_date", (F.col("value") * 100 / F.col("required_value")).alias("progress_pct"))


def income_yield(projection: DataFrame, totals: DataFrame) -> DataFrame:
    return projection.filter("year = 1").join(totals.select("wallet_id", "value"), "wallet_id").select("wallet_id", (F.try_divide("income", "value") * 100).alias("yield_pct"))


def contribution_plan(wallets: DataFrame, required: float, years: float, return_pct: float | None = None, assumed_pct: float = 7.0) -> DataFrame:
    """Payments with dividends reinvested and with dividends spent, by year and by month, and what spending costs.

    The total return is the one set, else the wallet's measured one (measured_pct, a yearly price return, plus its yield,
    where the column is there and known), else an assumed one; return_source says which. Spent dividends take the yield
    off it. Wallets without a value above 0 have nulls.
    """
    value = F.when(F.col("value") > 0, F.col("value"))
    share = F.coalesce("annual_income", F.lit(0.0)) / value * 100
    measured = F.col("measured_pct") + share if "measured_pct" in wallets.columns else F.lit(None).cast("double")
    total = F.lit(float(return_pct)) if return_pct is not None else F.coalesce(measured, F.lit(assumed_pct))
    source = F.lit("set") if return_pct is not None else F.when(measured.isNotNull(), "measured").otherwise("assumed")
    w = wallets.select("wallet_id", value.alias("value"), share.alias("share"), total.alias("total"), source.alias("return_source"))
    kept, spent = (_contribution(F.col("value"), required, years, r) for r in (F.col("total"), F.col("total") - F.col("share")))
    w = w.select("wallet_id", "return_source", F.col("total").alias("return_pct"), *[kept[k].alias(f"{k}_reinvested") for k in ("per_year", "per_month")], *[spent[k].alias(f"{k}_spent") for k in ("per_year", "per_month")])
    extra = lambda k: F.when(F.col(f"{k}_spent").isNotNull(), F.greatest(F.lit(0.0), F.col(f"{k}_spent") - F.col(f"{k}_reinvested")))
    return w.withColumns({"extra_per_year": extra("per_year"), "extra_per_month": extra("per_month")})


def mixed_currency(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each wallet's main currency (the first by name; USD without one) and whether its holdings have several, as sums
    over them are not converted. quotes: (symbol, currency)."""
    h = holdings.select("wallet_id", "symbol").join(quotes.select("symbol", "currency").dropDuplicates(["symbol"]), "symbol", "left").withColumn("currency", F.coalesce("currency", F.lit("USD")))
    return h.groupBy("wallet_id").agg(F.min("currency").alias("currency"), F.count_distinct("currency").alias("currencies")).withColumn("mixed", F.col("currencies") > 1)

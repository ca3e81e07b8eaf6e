"""The on-line form of the quality score, with pillars and metrics, now and at every past period end.

All histories are running states of bounded size over ordered frames: the last five statements, the last eleven yearly
dividend totals, the close and the payments so far. A past period reads the states in force at it, so the work grows
with the periods and payments, not with their prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import band, cagr, cagr_series, grade, is_reit_word, pick, safe_ratio, score_between, shift_back, weighted_score
from finquarry.operators.statements import FLOWS, METRICS

#: Yearly dividend totals that a streak may use, those that growth spans, and the most payments that a year may have.
TOTALS, GROWTH_TOTALS, MOST_A_YEAR = 11, 6, 12
#: Weights of the pillars in percent, in the order of the score.
WEIGHTS = {"Dividend safety": 25, "Balance sheet": 25, "Growth": 20, "Profitability": 15, "Valuation": 15}


def statement_states(wide: DataFrame) -> DataFrame:
    """Each annual or quarterly period end with what its score reads of the statements up to it.

    An annual period is seen with the years before it, a quarter as the four quarters that end at it (fewer are scaled up,
    balances are those of the last) with such years four, eight, ... quarters before it. One shuffle, by symbol and kind.
    Columns: the metrics, statement_periods and quarters_used, the last five revenues, earnings and FFO a share that are
    known, payments and cash of the last three, window_start (the period end before, or a year or quarter back) and
    newest, which marks the last period of its kind.
    """
    by = Window.partitionBy("symbol", "period_type").orderBy("period_end")
    quarter, year = F.col("period_type") == "quarterly", by.rowsBetween(-3, 0)
    n = F.count(F.lit(1)).over(year)
    known = {m: F.when(~F.isnan(m) & (F.abs(m) != float("inf")), F.col(m)) for m in METRICS}
    s = wide.filter(F.col("period_type").isin("annual", "quarterly")).withColumns({m: c.cast("double") for m, c in known.items()})
    folded = {m: F.when(quarter, F.when(F.count(m).over(year) == n, F.sum(m).over(year) * (F.lit(4.0) / n))).otherwise(F.col(m)).alias(m) for m in FLOWS}
    back = F.when(quarter, shift_back("period_end", 3)).otherwise(shift_back("period_end", 12))
    s = s.select(
        "symbol", "period_type", "period_end", *[folded.get(m, F.col(m)) for m in METRICS], F.when(quarter, n).alias("quarters_used"), F.when(quarter, (F.row_number().over(by) - 1) % 4).otherwise(0).alias("lane"),
        F.coalesce(F.lag("period_end").over(by), back).alias("window_start"), F.lead("period_end").over(by).isNull().alias("newest"),
    )
    lane = Window.partitionBy("symbol", "period_type", "lane").orderBy("period_end")
    five, three = lane.rowsBetween(-4, 0), lane.rowsBetween(-2, 0)
    per_share = safe_ratio(F.col("netincome") + F.col("depreciationandamortization"), "dilutedaverageshares")
    out = {"statement_periods": F.row_number().over(lane).cast("long"), "payout_years": F.count("cashdividendspaid").over(three)}
    out |= {f"{k}_values": F.collect_list(c).over(five) for k, c in (("revenue", F.col("totalrevenue")), ("eps", F.col("dilutedeps")), ("ffops", per_share))}
    for c in ("freecashflow", "operatingcashflow"):
        both = F.col("cashdividendspaid").isNotNull() & F.col(c).isNotNull()
        out |= {f"paid_on_{c}": F.sum(F.when(both, F.abs("cashdividendspaid"))).over(three), f"sum_of_{c}": F.sum(F.when(both, F.col(c))).over(three)}
    return s.withColumns(out).drop("lane")


def dividend_states(div: DataFrame) -> DataFrame:
    """Each payment with the record as it stood then: payments, streak of rising yearly totals, totals compared, growth
    over up to six of them, and all that was paid so far.

    A year is as many payments as the upper median of the gaps so far says. That needs no list of gaps: the cadence falls
    as the gap grows, so counts of the thirteen cadences give the median's. Yearly totals are sums over the last payments.
    """
    w = Window.partitionBy("symbol").orderBy("pay_date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.datediff("pay_date", F.lag("pay_date").over(w))
    a_year = F.when(gap == 0, MOST_A_YEAR + 1).when(gap > 0, F.greatest(F.lit(1), F.least(F.lit(MOST_A_YEAR), F.round(F.lit(365.25) / gap).cast("int"))))
    d = div.select("symbol", "pay_date", "amount", a_year.alias("cadence"))
    at_least = {f"over_{b}": F.sum(F.when(F.col("cadence") >= b, 1).otherwise(0)).over(past) for b in range(1, MOST_A_YEAR + 2)}
    recent = w.rowsBetween(1 - TOTALS * MOST_A_YEAR, 0)
    d = d.withColumns({**at_least, "payments": F.row_number().over(w), "paid": F.sum(F.col("amount").cast("decimal(28,6)")).over(past), "recent": F.collect_list(F.coalesce("amount", F.lit(0.0))).over(recent)})
    middle = F.floor((F.col("payments") - 1) / 2)  # place of the upper median among payments - 1 gaps, shortest first
    cadence = reduce(lambda acc, b: acc.when(F.col(f"over_{b}") > middle, b), range(MOST_A_YEAR, 0, -1), F.when((F.col("payments") < 2) | (F.col(f"over_{MOST_A_YEAR + 1}") > middle), F.lit(None).cast("int")))
    d = d.select("symbol", "pay_date", "payments", "paid", "recent", cadence.alias("per_year"))
    full = F.when(F.col("per_year").isNotNull(), F.least(F.lit(TOTALS), F.floor(F.col("payments") / F.col("per_year")).cast("int")))
    sums = F.transform(F.sequence(F.lit(1), full), lambda k: F.aggregate(F.slice("recent", F.size("recent") - k * F.col("per_year") + 1, F.col("per_year")), F.lit(0.0), lambda a, x: a + x))
    d = d.withColumn("totals", F.when(full >= 1, sums).otherwise(F.array().cast("array<double>")))  # newest first
    size = F.size("totals")
    rose = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.get("totals", i - 1) > F.get("totals", i) * 1.001))
    first_stop = F.array_position(rose, F.lit(False))
    streak = F.when(first_stop > 0, first_stop - 1).otherwise(F.greatest(size - 1, F.lit(0)))
    old = F.least(size, F.lit(GROWTH_TOTALS)) - 1
    growth = F.when(size > 1, cagr(F.get("totals", old), F.get("totals", F.lit(0)), old.cast("double")))
    return d.select("symbol", "pay_date", F.col("payments").cast("long").alias("payments"), streak.cast("long").alias("streak"), F.greatest(size - 1, F.lit(0)).cast("long").alias("totals_compared"), growth.alias("dividend_cagr_pct"), "paid")


def _number(label: str, value: Column, kind: str, score: Column, weight: float, of: Column | None = None) -> tuple[Column, Column, float]:
    made = F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(kind).alias("kind"), (F.lit(None).cast("long") if of is None else of.cast("long")).alias("of"), F.lit(None).cast("double").alias("score"), F.lit(weight).alias("weight"))
    return made, score, weight


def live_score(states: DataFrame, keys: list[str]) -> DataFrame:
    """The score of each row of states, which holds the statements' and dividends' states and is_reit, market_cap,
    trailing_pe, dividend_yield_pct, five_year_avg_dividend_yield_pct and return_on_equity_pct.

    overall_score (null below 40 percent coverage) weighs rounded pillars. pillars is an array of (title, score, metrics),
    metrics of (label, value, kind, of, score, weight): value is a number of its kind (percent, multiple, count) instead
    of text, null where it is not shown; of is the years behind a payout or the totals behind a streak. key_figures has
    (label, value, kind). pillar_scores has the pillars' (title, score) alone: who reads no metrics need not have them
    made. Columns of keys and statement counts are kept.
    """
    reit, c = F.col("is_reit"), F.col
    both = lambda a, b: F.when(reit, a).otherwise(b)
    pct = lambda a, b: safe_ratio(a, b) * 100
    limits = lambda v, r, s: score_between(v, both(F.lit(float(r[0])), F.lit(float(s[0]))), both(F.lit(float(r[1])), F.lit(float(s[1]))))
    ffo = c("netincome") + c("depreciationandamortization")
    cash = both(c("sum_of_operatingcashflow"), c("sum_of_freecashflow"))
    payout = F.when(cash > 0, both(c("paid_on_operatingcashflow"), c("paid_on_freecashflow")) / cash * 100)
    s = states.withColumns({
        "ffo": ffo, "payout_pct": payout, "price_to_ffo": safe_ratio("market_cap", ffo), "ffo_per_share": safe_ratio(ffo, "dilutedaverageshares"), "streak": F.coalesce("streak", F.lit(0)), "totals_compared": F.coalesce("totals_compared", F.lit(0)),
        "net_debt_to_ebitda": safe_ratio(c("totaldebt") - pick("cashandcashequivalents", F.lit(0.0)), "ebitda"), "interest_coverage": safe_ratio(both(c("ebitda"), c("ebit")), F.abs("interestexpense")), "debt_to_assets": safe_ratio("totaldebt", "totalassets"),
        "revenue_cagr_pct": cagr_series("revenue_values"), "per_share_cagr_pct": both(cagr_series("ffops_values"), cagr_series("eps_values")), "yield_vs_history": safe_ratio("dividend_yield_pct", "five_year_avg_dividend_yield_pct"),
        "cash_yield_pct": pct(both(ffo, c("freecashflow")), "market_cap"), "margin_pct": pct(both(c("ebitda"), c("operatingincome")), "totalrevenue"), "return_pct": both(pct(ffo, "totalrevenue"), c("return_on_equity_pct")),
    })
    yields = c("dividend_yield_pct")
    pays = F.coalesce((yields > 0) & ((yields >= 0.25) | F.coalesce(c("payout_pct") >= 5, F.lit(False))), F.lit(False))
    s = s.withColumns({"pays_dividend": pays, "usable_history": F.coalesce((yields >= 1) & (c("five_year_avg_dividend_yield_pct") > 0), F.lit(False))})
    paid = lambda x: F.when(c("pays_dividend"), x)
    usable = c("usable_history")
    label = lambda r, n: both(F.lit(r), F.lit(n))

    def named(text: Column, part: tuple) -> tuple:
        return (part[0].withField("label", text), *part[1:])

    parts = {
        "Dividend safety": [
            named(label("Payout / cash flow", "Payout / free cash flow"), _number("", paid(c("payout_pct")), "percent", paid(limits("payout_pct", (100, 70), (90, 40))), 0.55, c("payout_years"))),
            _number("Years of consecutive raises", paid(c("streak").cast("double")), "count", paid(score_between("streak", 0, 10)), 0.45, c("totals_compared")),
        ],
        "Balance sheet": [
            _number("Net debt / EBITDA", c("net_debt_to_ebitda"), "multiple", limits("net_debt_to_ebitda", (8, 4.5), (4.5, 1)), 0.5),
            _number("Interest coverage", c("interest_coverage"), "multiple", limits("interest_coverage", (2, 5.5), (3, 15)), 0.3),
            _number("Debt / assets", c("debt_to_assets") * 100, "percent", limits("debt_to_assets", (0.65, 0.3), (0.6, 0.2)), 0.2),
        ],
        "Growth": [
            _number("Revenue CAGR", c("revenue_cagr_pct"), "percent", score_between("revenue_cagr_pct", 0, 12), 0.35),
            named(label("FFO / share CAGR", "EPS CAGR"), _number("", c("per_share_cagr_pct"), "percent", score_between("per_share_cagr_pct", 0, 10), 0.4)),
            _number("Dividend CAGR", paid(c("dividend_cagr_pct")), "percent", paid(score_between("dividend_cagr_pct", 0, 8)), 0.25),
        ],
        "Profitability": [
            named(label("EBITDA margin", "Operating margin"), _number("", c("margin_pct"), "percent", limits("margin_pct", (40, 70), (5, 30)), 0.5)),
            named(label("FFO margin", "Return on equity"), _number("", c("return_pct"), "percent", limits("return_pct", (30, 65), (5, 25)), 0.5)),
        ],
        "Valuation": [
            named(label("P / FFO", "P / E (TTM)"), _number("", both(c("price_to_ffo"), c("trailing_pe")), "multiple", both(score_between("price_to_ffo", 28, 13), score_between("trailing_pe", 35, 12)), 0.6)),
            named(F.when(usable, "Yield vs 5-year average").otherwise(label("FFO yield", "Free cash flow yield")), _number("", F.when(usable, c("yield_vs_history")).otherwise(c("cash_yield_pct")), "percent", F.when(usable, score_between("yield_vs_history", 0.7, 1.3)).otherwise(score_between("cash_yield_pct", 2, 8)), 0.4)),
        ],
    }
    kind = F.when(usable, "multiple").otherwise("percent")
    last = parts["Valuation"][1]
    parts["Valuation"][1] = (last[0].withField("kind", kind), *last[1:])
    made = {f"_score_{t}_{k}": p[1] for t, ps in parts.items() for k, p in enumerate(ps)}  # each named once, so that the plan stays small
    s = s.withColumns(made)
    parts = {t: [(p[0].withField("score", F.round(f"_score_{t}_{k}")), F.col(f"_score_{t}_{k}"), p[2]) for k, p in enumerate(ps)] for t, ps in parts.items()}
    names = {title: f"pillar_{k}" for k, title in enumerate(WEIGHTS)}
    s = s.withColumns({names[t]: F.round(weighted_score([(p[1], p[2]) for p in ps])) for t, ps in parts.items()})
    covered = reduce(lambda a, b: a + b, [F.when(c(names[t]).isNotNull(), w).otherwise(0) for t, w in WEIGHTS.items()])
    s = s.withColumn("coverage_pct", covered.cast("double"))
    s = s.withColumn("overall_score", F.when(c("coverage_pct") >= 40, F.round(weighted_score([(names[t], w / 100) for t, w in WEIGHTS.items()]))))
    figure = lambda name, value, how: F.struct(F.lit(name).alias("label"), value.alias("value"), F.lit(how).alias("kind"))
    reit_figures = F.array(figure("FFO (last FY)", c("ffo"), "money"), figure("FFO / share", c("ffo_per_share"), "money"), figure("P / FFO", c("price_to_ffo"), "multiple"), figure("Cash flow payout", c("payout_pct"), "percent"))
    figures = F.array(figure("EPS (last FY)", c("dilutedeps"), "money"), figure("Free cash flow", c("freecashflow"), "money"), figure("P / E (TTM)", c("trailing_pe"), "multiple"), figure("FCF payout", c("payout_pct"), "percent"))
    pillars = F.array(*[F.struct(F.lit(t).alias("title"), c(names[t]).alias("score"), F.array(*[p[0] for p in ps]).alias("metrics")) for t, ps in parts.items()])
    pillar_scores = F.array(*[F.struct(F.lit(t).alias("title"), c(n).alias("score")) for t, n in names.items()])
    return s.select(*keys, F.when(reit, "reit").otherwise("standard").alias("scoring_basis"), "overall_score", grade("overall_score").alias("grade"), band("overall_score").alias("band"), "coverage_pct", "pays_dividend", pillars.alias("pillars"), pillar_scores.alias("pillar_scores"), both(reit_figures, figures).alias("key_figures"))


def quality_score_live(dim: DataFrame, wide: DataFrame, div: DataFrame) -> DataFrame:
    """live_score of every company with an annual statement, from its statements and payments so far and dim's market
    fields. A company without payments has no streak; one without market fields is scored on the rest."""
    latest = statement_states(wide.filter("period_type = 'annual'")).filter("newest")
    states = dividend_states(div)
    paid = states.groupBy("symbol").agg(F.max_by(F.struct(*[x for x in states.columns if x != "symbol"]), "pay_date").alias("d")).select("symbol", "d.streak", "d.totals_compared", "d.dividend_cagr_pct")
    fields = ["symbol", "name", "sector", "industry", "market_cap", "trailing_pe", "dividend_yield_pct", "five_year_avg_dividend_yield_pct", "return_on_equity_pct"]
    s = latest.join(dim.select(*fields), "symbol").join(paid, "symbol", "left").withColumn("is_reit", is_reit_word("industry"))
    return live_score(s, ["symbol", "name", "sector", "period_end"])


def pillar_details(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row a metric of live_score's result: keys, pillar, pillar_score, metric, value, kind, of, score, weight."""
    p = scored.select(*keys, F.explode("pillars").alias("p"))
    m = p.select(*keys, F.col("p.title").alias("pillar"), F.col("p.score").alias("pillar_score"), F.explode("p.metrics").alias("m"))
    return m.select(*keys, "pillar", "pillar_score", F.col("m.label").alias("metric"), *[F.col(f"m.{x}").alias(x) for x in ("value", "kind", "of", "score", "weight")])


def key_figures(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.select(*keys, F.explode("key_figures").alias("f")).select(*keys, F.col("f.label").alias("figure"), F.col("f.value").alias("value"), F.col("f.kind").alias("kind"))


def _as_of(points: DataFrame, div: DataFrame, closes: DataFrame) -> DataFrame:
    """points with the close and dividend state in force at period_end, what had been paid a year before it, and the
    close in force at window_start. Points and events of a symbol lie in one order; the last of each event is carried
    forward, so no pair of a point and an event is made. A window starts at the period end before, whose close is known;
    only the first period of a kind asks for a close of its own."""
    kept = F.struct(*[c for c in points.columns if c != "symbol"])
    slim = F.struct(*[(F.col(c) if c in ("period_type", "period_end") else F.lit(None).cast(points.schema[c].dataType)).alias(c) for c in points.columns if c != "symbol"])
    probe = lambda t, ends, s: F.struct(t.alias("t"), F.lit(ends).alias("ends"), s.alias("s"))
    end, first = probe(F.col("period_end"), True, kept), (F.col("statement_periods") == 1) & (F.coalesce("quarters_used", F.lit(1)) == 1)
    asked = F.explode(F.when(first, F.array(end, probe(F.col("window_start"), False, slim))).otherwise(F.array(end)))
    probes = points.select("symbol", asked.alias("q")).select("symbol", "q.t", "q.ends", "q.s")
    paid = dividend_states(div)
    paid = paid.select("symbol", F.col("pay_date").alias("t"), F.struct(*[c for c in paid.columns if c not in ("symbol", "pay_date")]).alias("d"))
    quoted = closes.select("symbol", "t", F.struct("t", "close", F.coalesce("adj_close", "close").alias("adj_close")).alias("c"))
    line = probes.unionByName(paid, True).unionByName(quoted, True).withColumn("day", F.unix_date("t"))
    w = Window.partitionBy("symbol").orderBy("day")
    now, year = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.unboundedPreceding, -365)
    seen = line.withColumns({"d": F.last("d", True).over(now), "c": F.last("c", True).over(now), "before": F.last("d.paid", True).over(year)}).filter("ends is not null")
    g = seen.withColumn("c0", F.lag("c").over(Window.partitionBy("symbol", "s.period_type").orderBy("day", "ends"))).filter("ends")
    return g.select("symbol", "s.*", "d.streak", "d.totals_compared", "d.dividend_cagr_pct", (F.col("d.paid") - F.coalesce("before", F.lit(0).cast("decimal(28,6)"))).cast("double").alias("paid_1y"), F.col("c.t").alias("quoted_on"), F.col("c.close").alias("price"), F.col("c.adj_close").alias("adj_now"), F.col("c0.t").alias("quoted_before"), F.col("c0.adj_close").alias("adj_before"))


def summary_as_at(points: DataFrame, industries: DataFrame) -> DataFrame:
    """The market fields of each point as of its period end: market cap, P/E, return on equity and trailing yield from
    its own statement and price. A past five-year average yield is not known, so that is null. Only the industry is
    today's; companies without one are scored by the standard rules."""
    eps, equity, price = F.col("dilutedeps"), F.col("stockholdersequity"), F.col("price")
    known = industries.select("symbol", "industry", is_reit_word("industry").alias("is_reit"))
    return points.join(known, "symbol", "left").withColumns({
        "is_reit": F.coalesce("is_reit", F.lit(False)), "market_cap": F.col("dilutedaverageshares") * price, "trailing_pe": F.when(eps > 0, price / eps), "return_on_equity_pct": F.when(equity > 0, F.col("netincome") / equity * 100),
        "dividend_yield_pct": F.when((F.col("paid_1y") > 0) & (price > 0), F.col("paid_1y") / price * 100), "five_year_avg_dividend_yield_pct": F.lit(None).cast("double"),
    })


def thin_history(statement_periods: str = "statement_periods", quarters_used: str = "quarters_used") -> Column:
    """Whether a grade rests on fewer than three statements or, for a quarter, on fewer than four quarters."""
    return (F.col(statement_periods) < 3) | F.coalesce(F.col(quarters_used) < 4, F.lit(False))


def score_timeline(wide: DataFrame, dim: DataFrame, div: DataFrame, closes: DataFrame) -> DataFrame:
    """The score at every annual and quarterly period end of every company, from what was reported, paid and quoted up
    to then, with the price, the return over the period and the pillars; one job, linear in periods.

    closes: (symbol, t, close, adj_close), for instance of month ends. div may leave out symbols without statements. Periods before the first close, or with too little
    to grade, keep their row with the reason in unscored.
    """
    points = summary_as_at(_as_of(statement_states(wide), div, closes), dim)
    whole = (F.col("quoted_before") < F.col("quoted_on")) & (F.col("adj_before") > 0) & (F.col("adj_now") > 0)
    points = points.withColumns({"period_return": F.when(whole, (F.col("adj_now") / F.col("adj_before") - 1) * 100), "thin_history": thin_history()})
    s = live_score(points, ["symbol", "period_type", F.col("period_end").alias("period"), "statement_periods", "quarters_used", "thin_history", "price", "window_start", "period_return"])
    unpriced = F.col("price").isNull()
    hidden = {c: F.when(~unpriced, F.col(c)) for c in ("overall_score", "grade", "band", "coverage_pct", "pillars", "pillar_scores", "key_figures", "pays_dividend")}
    why = F.when(unpriced, "no price history at this date").when(F.col("overall_score").isNull(), "not enough reported data to grade")
    return s.withColumns(hidden).withColumn("unscored", why)

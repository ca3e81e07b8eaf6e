"""Column builders of the engine: scores, growth, grades, cadence, ratios. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOr = Column | float | int | str


def _c(x: ColumnOr) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def score_between(v: ColumnOr, poor: ColumnOr, great: ColumnOr) -> Column:
    """0 at poor, 100 at great, linear and clamped between; null for a null value or a zero span."""
    v, poor, great = _c(v), _c(poor), _c(great)
    raw = F.try_divide(v - poor, great - poor) * 100.0
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def weighted_score(parts: list[tuple[ColumnOr, float]]) -> Column:
    """Weighted mean of the parts that are not null; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_c(x) * w, F.lit(0.0)) for x, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(_c(x).isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts])
    return F.try_divide(total, weight)


def cagr(first: ColumnOr, last: ColumnOr, years: ColumnOr) -> Column:
    """Yearly growth in percent; null unless both ends and the years are positive."""
    first, last, years = _c(first), _c(last), _c(years)
    return F.when((first > 0) & (last > 0) & (years > 0), (F.pow(last / first, F.lit(1.0) / years) - 1) * 100)


def cagr_series(values: ColumnOr) -> Column:
    """Yearly growth in percent over an ordered array, gaps left out: its known values count as a year each. Null with
    fewer than two of them or unless the first and the last are positive."""
    v = F.filter(_c(values), lambda x: x.isNotNull())
    years = F.size(v) - 1
    return F.when(years > 0, cagr(F.get(v, F.lit(0)), F.get(v, years), years.cast("double")))


def pick(*values: ColumnOr) -> Column:
    """The first value that is not null."""
    return F.coalesce(*map(_c, values))


def metric(name: str) -> Column:
    return F.max(F.when(F.col("metric") == name, F.col("value")))


def snap_to_dividend_frequency(gap: ColumnOr) -> Column:
    """Payments a year nearest to a gap of days: 1, 2, 4, 6 or 12."""
    gap = _c(gap)
    n = F.lit(365.25) / gap
    return F.when(gap > 0, F.when(n < 1.5, 1).when(n < 3, 2).when(n < 5, 4).when(n < 9, 6).otherwise(12))


#: The ladder of grades and of bands, highest first.
GRADES = [(88, "A+"), (80, "A"), (73, "B+"), (66, "B"), (58, "C+"), (50, "C"), (40, "D")]
BANDS = [(75, "Strong"), (60, "Solid"), (45, "Mixed"), (30, "Weak")]


def _ladder(score: ColumnOr, steps: list[tuple[int, str]], last: str) -> Column:
    score = _c(score)
    out = reduce(lambda acc, s: acc.when(score >= s[0], s[1]), steps, F.when(score.isNull(), F.lit(None).cast("string")))
    return out.otherwise(last)


def grade(score: ColumnOr) -> Column:
    return _ladder(score, GRADES, "F")


def band(score: ColumnOr) -> Column:
    return _ladder(score, BANDS, "Poor")


def is_reit(industry: ColumnOr) -> Column:
    return F.coalesce(_c(industry).ilike("REIT%"), F.lit(False))


def is_reit_word(industry: ColumnOr) -> Column:
    """The looser test: the word REIT at the start, blanks before it allowed."""
    return F.coalesce(_c(industry).rlike(r"(?i)^\s*REIT\b"), F.lit(False))


def safe_ratio(a: ColumnOr, b: ColumnOr) -> Column:
    out = F.try_divide(_c(a), _c(b))
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def growth(now: ColumnOr, before: ColumnOr) -> Column:
    return F.when(_c(before) > 0, (_c(now) / _c(before) - 1) * 100)


def period_label(period_type: ColumnOr, period_end: ColumnOr) -> Column:
    end = _c(period_end)
    return F.when(_c(period_type) == "annual", F.concat(F.lit("FY"), F.year(end))).otherwise(F.concat(F.lit("Q"), F.quarter(end), F.lit(" "), F.year(end)))


def shift_back(day: ColumnOr, months: int) -> Column:
    return F.add_months(_c(day), -months)


def annualise(total_pct: ColumnOr, years: ColumnOr) -> Column:
    total_pct, years = _c(total_pct), _c(years)
    return F.when((years >= 1) & (total_pct > -100), (F.pow(1 + total_pct / 100, F.lit(1.0) / years) - 1) * 100)


def range_position(price: ColumnOr, low: ColumnOr, high: ColumnOr) -> Column:
    return score_between(price, low, high)


def target_upside(target: ColumnOr, price: ColumnOr) -> Column:
    return F.try_divide(_c(target) - _c(price), _c(price)) * 100


def unwrap_num(c: ColumnOr) -> Column:
    """A number out of 5, "5" or {"raw": 5}; null for {}, text, NaN and infinities."""
    c = _c(c).cast("string")
    v = F.coalesce(F.get_json_object(c, "$.raw"), c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def as_percent(c: ColumnOr) -> Column:
    return _c(c) * 100

"""Data-quality checks. Each returns the offending rows; a suite counts them by severity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquarry.functions.columns import grade
from finquarry.operators.core import fresh


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def unique_combination(df: DataFrame, cols: list[str]) -> DataFrame:
    """The combinations that are there more than once, with their count n (n_ if a column has that name)."""
    n = fresh(cols, "n")
    return df.groupBy(*cols).agg(F.count("*").alias(n)).filter(F.col(n) > 1)


def accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(values))


def relationships(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def in_range(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(col) < low)
    if high is not None:
        bad = bad | (F.col(col) > high)
    return df.filter(bad)


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) <= 0)


def grade_matches_score(scores: DataFrame) -> DataFrame:
    return scores.filter(~grade("overall_score").eqNullSafe(F.col("grade")))


def intervals_do_not_overlap(df: DataFrame, keys: list[str], start: str, end: str, inclusive: bool) -> DataFrame:
    """Rows whose interval runs into the next one of its key; an open one must be the last."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    following = fresh(df.columns, "_next")
    return df.withColumn(following, nxt).filter(_runs_over(end, following, inclusive)).drop(following)


def _runs_over(end: str, following: str, inclusive: bool) -> Column:
    clash = F.col(end).isNull() | ((F.col(end) >= F.col(following)) if inclusive else (F.col(end) > F.col(following)))
    return F.col(following).isNotNull() & clash


def dividend_record_not_truncated(fct: DataFrame, limit: int = 168) -> DataFrame:
    """Symbols with exactly `limit` payments and a calendar gap inside their record."""
    w = Window.partitionBy("symbol")
    y = fct.groupBy("symbol", "calendar_year").agg(F.count("*").alias("n"))
    y = y.withColumns({"gap": F.lead("calendar_year").over(w.orderBy("calendar_year")) - F.col("calendar_year"), "payments": F.sum("n").over(w)})
    return y.filter((F.col("gap") > 1) & (F.col("payments") == limit) & F.col("symbol").isNotNull()).select("symbol", "payments").distinct()


def missed_splits_are_corrected(prices: DataFrame, corrections: DataFrame) -> DataFrame:
    m = corrections.filter("upstream_missed_it").select("symbol", "split_date")
    b = prices.join(m, "symbol").filter(F.col("trade_date") < F.col("split_date")).groupBy("symbol", "split_date").agg(F.max("correction_factor").alias("factor"))
    return b.filter("factor <= 1")


def no_unadjusted_split(prices: DataFrame, ratios: tuple[float, ...] = (0.5, 0.25, 0.3333, 0.6667, 2.0, 3.0), tolerance: float = 0.01) -> DataFrame:
    """Days whose adjusted close steps by a split's ratio."""
    step = F.try_divide(F.col("adj_close"), F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("trade_date")))
    hit = F.lit(False)
    for r in ratios:
        hit = hit | (F.abs(F.col("step") - r) < tolerance * r)
    return prices.withColumn("step", step).filter(hit).select("symbol", "trade_date", "step")


def no_phantom_dividend_cut(years: DataFrame, windows: DataFrame) -> DataFrame:
    """Calendar drops of symbols whose count-based windows never fell."""
    w = Window.partitionBy("symbol").orderBy("calendar_year")
    drop = years.filter(~F.col("is_partial")).withColumn("before", F.lag("total").over(w)).filter("total < before").select("symbol", "calendar_year")
    older = F.lead("amount").over(Window.partitionBy("symbol").orderBy("window_index"))
    fell = windows.withColumn("older", older).filter("amount < older").select("symbol").distinct()
    return drop.join(fell, "symbol", "left_anti")


def payout_ratio_sane(scores: DataFrame, most: float = 200.0) -> DataFrame:
    return scores.filter(F.col("payout_pct") > most).select("symbol", "payout_pct")


def prices_are_fresh(bars: DataFrame, as_of: str, days: int = 4) -> DataFrame:
    return bars.agg(F.max("trade_date").alias("latest")).filter(F.datediff(F.lit(as_of).cast("date"), "latest") > days)


def ebitda_present_with_revenue(fin: DataFrame, dim: DataFrame, exempt: str = "Financial Services") -> DataFrame:
    d = dim.select("symbol", "sector")
    return fin.filter("period_type = 'annual' and totalrevenue is not null and ebitda is null").join(d, "symbol").filter(~F.col("sector").eqNullSafe(F.lit(exempt))).select("symbol", "period_end")


def reit_capex_coverage(long: DataFrame, dim: DataFrame) -> DataFrame:
    return _coverage(long.groupBy("symbol").agg(F.max(F.col("metric") == "capitalexpenditure").alias("capex")), dim)


def _coverage(by_symbol: DataFrame, dim: DataFrame) -> DataFrame:
    reits = by_symbol.join(dim.filter("is_reit").select("symbol").distinct(), "symbol", "left_semi")
    return reits.agg(F.count("*").alias("reits"), F.count_if("capex").alias("with_capex"))


def reit_capex_coverage_wide(wide: DataFrame, dim: DataFrame, metrics: list[str]) -> DataFrame:
    """reit_capex_coverage of statements with a column a metric, one row a symbol instead of one a metric and period."""
    there = lambda m: F.coalesce(~F.isnan(m) & (F.abs(m) != float("inf")), F.lit(False))
    known = wide.filter(reduce(Column.__or__, [there(F.col(m).cast("double")) for m in metrics]))
    return _coverage(known.groupBy("symbol").agg(F.max(there(F.col("capitalexpenditure").cast("double"))).alias("capex")), dim)


def reit_affo_proxy_still_needed(long: DataFrame, dim: DataFrame) -> DataFrame:
    """A row once every REIT reports capital expenditure, so that its true figure could take the proxy's place."""
    return _all_report(reit_capex_coverage(long, dim))


def _all_report(coverage: DataFrame) -> DataFrame:
    return coverage.filter("reits > 0 and with_capex = reits")


def reit_affo_proxy_still_needed_wide(wide: DataFrame, dim: DataFrame, metrics: list[str]) -> DataFrame:
    return _all_report(reit_capex_coverage_wide(wide, dim, metrics))


def warehouse_health(bars: DataFrame, fin: DataFrame, div: DataFrame, dim: DataFrame, scores: DataFrame, as_of: str) -> DataFrame:
    """One row: the rows of five tables, the last bar's date and how many days old it is."""
    first = bars.agg(F.count("*").alias("price_rows"), F.max("trade_date").alias("latest_trade_date"))
    for name, df in (("financial_rows", fin), ("dividend_rows", div), ("securities", dim), ("scored", scores)):
        first = first.join(F.broadcast(df.agg(F.count("*").alias(name))))  # single rows
    return first.withColumn("days_stale", F.datediff(F.lit(as_of).cast("date"), "latest_trade_date"))


@dataclass(frozen=True)
class Rule:
    """A check of single rows of a table: those that meet the condition offend. unique: columns whose combinations must be
    single; then the condition is not used. Severity is error or warn."""

    name: str
    condition: Column | None = None
    severity: str = "error"
    unique: tuple[str, ...] = ()


def check_tables(tables: dict[str, tuple[DataFrame, list[Rule]]], others: dict[str, tuple[str, DataFrame]] | None = None) -> DataFrame:
    """(check, severity, offending) of many rules, from one scan of each table.

    All rules on single rows of a table are conditional counts of one aggregate. The first uniqueness of a table shares
    it too: counts by key first, then over keys. Further ones, and others (severity and offending rows), are an aggregate
    each. The report is one DataFrame, so all of it runs as one job. Null conditions do not offend; an empty table has
    zero counts.
    """
    parts = []
    for df, rules in tables.values():
        rows = [r for r in rules if not r.unique]
        keys = [r for r in rules if r.unique]
        counts = [F.count_if(r.condition).alias(f"c{k}") for k, r in enumerate(rows)]
        if keys:
            g = df.groupBy(*keys[0].unique).agg(F.struct(F.count("*").alias("n"), *counts).alias(fresh(df.columns, "_counts")))
            g = g.select(F.col(g.columns[-1]).alias("s"))
            one = g.agg(F.count_if(F.col("s.n") > 1).alias("u"), *[F.coalesce(F.sum(f"s.c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(rows))])
        else:
            one = df.agg(*counts)
        found = [(r, F.col(f"c{k}")) for k, r in enumerate(rows)] + [(r, F.col("u")) for r in keys[:1]]
        each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("check"), F.lit(r.severity).alias("severity"), c.alias("offending")) for r, c in found]))
        parts.append(one.select(each.alias("r")).select("r.*"))
        for r in keys[1:]:
            parts.append(_counted(r.name, r.severity, unique_combination(df, list(r.unique))))
    parts += [_counted(name, severity, rows) for name, (severity, rows) in (others or {}).items()]
    return reduce(DataFrame.unionByName, parts)


def _counted(name: str, severity: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("offending")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "offending")


def with_next(df: DataFrame, keys: list[str], start: str, name: str = "next_start") -> DataFrame:
    return df.withColumn(name, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def overlaps(end: str, inclusive: bool, following: str = "next_start") -> Column:
    """Whether an interval with its follower's start (with_next) runs into it."""
    return _runs_over(end, following, inclusive)


def run_checks(checks: dict[str, tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """(check, severity, offending) of named checks; severity is error or warn."""
    return reduce(DataFrame.unionByName, [_counted(name, severity, rows()) for name, (severity, rows) in checks.items()])


def build_fails(report: DataFrame) -> bool:
    return not report.filter("severity = 'error' and offending > 0").isEmpty()

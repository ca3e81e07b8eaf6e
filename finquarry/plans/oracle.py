"""DuckDB twins of the queries, built from named steps that mirror the operators."""

from __future__ import annotations

import re
from functools import lru_cache

from finquarry.operators.prices import EARNINGS_BASED, PROFILE
from finquarry.operators.statements import ALL_FLOWS, ALL_METRICS, FLOWS, METRICS
from finquarry.sources.adapters import AS_OF, LINES, MORE_LINES, SPLIT_DATE

#: Steps by name; a step may read the driver's tables and the steps above it.
STEPS: dict[str, str] = {}


def _grade(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} >= 88 THEN 'A+' WHEN {c} >= 80 THEN 'A' WHEN {c} >= 73 THEN 'B+' WHEN {c} >= 66 THEN 'B' WHEN {c} >= 58 THEN 'C+' WHEN {c} >= 50 THEN 'C' WHEN {c} >= 40 THEN 'D' ELSE 'F' END"


def _snap(g: str) -> str:
    n = f"(365.25 / nullif({g}, 0))"
    return f"CASE WHEN {g} > 0 THEN CASE WHEN {n} < 1.5 THEN 1 WHEN {n} < 3 THEN 2 WHEN {n} < 5 THEN 4 WHEN {n} < 9 THEN 6 ELSE 12 END END"


def _between(v: str, poor: str, great: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL AND ({great}) <> ({poor}) THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({v} - ({poor})) / (({great}) - ({poor}))::DOUBLE * 100)) END"


def _weighted(parts: list[tuple[str, float]]) -> str:
    top = " + ".join(f"coalesce(({x}) * {w}::DOUBLE, 0)" for x, w in parts)
    low = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for x, w in parts)
    return f"({top}) / nullif({low}, 0)"


def _cagr(a: str, b: str, n: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 AND {n} > 0 THEN (pow({b} / {a}, 1.0::DOUBLE / {n}) - 1) * 100 END"


STEPS["bars"] = f"""SELECT symbol, trade_date, open * h AS open, high * h AS high, low * h AS low, close * h AS close, volume, close * h AS adj_close FROM (
  SELECT *, CASE WHEN symbol % 10 = 0 AND trade_date >= DATE '{SPLIT_DATE}' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS h FROM (
  SELECT user_id AS symbol, ts::DATE AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::BIGINT AS volume
  FROM events GROUP BY 1, 2)) WHERE close * h > 0"""
STEPS["splits"] = f"SELECT DISTINCT user_id AS symbol, DATE '{SPLIT_DATE}' AS split_date, 2.0::DOUBLE AS ratio FROM events WHERE user_id % 10 = 0"
STEPS["dividends"] = "SELECT symbol, pay_date, amount FROM (SELECT o_custkey AS symbol, o_orderdate::DATE AS pay_date, o_totalprice AS amount, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_totalprice > 0) WHERE n = 1"
STEPS["securities"] = """SELECT c_custkey AS symbol, c_name AS name, c_mktsegment AS sector, CASE WHEN c_mktsegment = 'BUILDING' THEN 'REIT - Retail' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS industry,
  round(abs(c_acctbal) * 1000, 2) AS market_cap, (8.0 + c_custkey % 30)::DOUBLE AS trailing_pe, ((c_custkey % 8) * 0.75)::DOUBLE AS dividend_yield_pct, (1.0 + (c_custkey % 5) * 0.75)::DOUBLE AS five_year_avg_dividend_yield_pct,
  (c_custkey % 35)::DOUBLE AS return_on_equity_pct, 'USD' AS currency, c_mktsegment = 'BUILDING' AS is_reit FROM customer"""


def _wide(kind: str) -> str:
    end = "make_date(year(day), 12, 31)" if kind == "annual" else "last_day((date_trunc('quarter', day) + INTERVAL 2 MONTH)::DATE)"
    lines = ", ".join(f"floor(totalrevenue * ({a}::DOUBLE + {b}::DOUBLE * (symbol % 7) + {c}::DOUBLE * (year(period_end) % 3)) * 100.0::DOUBLE + 0.3333::DOUBLE) / 100.0::DOUBLE AS {m}" for m, (a, b, c) in LINES.items())
    return f"""SELECT *, floor(netincome / dilutedaverageshares * 10000.0::DOUBLE + 0.3333::DOUBLE) / 10000.0::DOUBLE AS dilutedeps, '{kind}' AS period_type FROM (SELECT symbol, period_end, totalrevenue, {lines}, (1000.0 + (symbol % 11) * 100.0)::DOUBLE AS dilutedaverageshares FROM (
      SELECT l_suppkey AS symbol, {end} AS period_end, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS totalrevenue FROM (SELECT l_suppkey, l_shipdate::DATE AS day, l_extendedprice FROM lineitem) GROUP BY 1, 2))"""


STEPS["wide_annual"], STEPS["wide_quarterly"] = _wide("annual"), _wide("quarterly")
STEPS["wide"] = "SELECT * FROM wide_annual UNION ALL BY NAME SELECT * FROM wide_quarterly"
STEPS["fin"] = f"""SELECT w.symbol, w.period_type, w.period_end, {", ".join("w." + m for m in METRICS)}, CASE WHEN s.is_reit THEN netincome + depreciationandamortization END AS ffo,
  CASE WHEN totalrevenue > 0 THEN netincome / totalrevenue * 100 END AS net_margin_pct, CASE WHEN totalrevenue > 0 THEN operatingincome / totalrevenue * 100 END AS operating_margin_pct,
  CASE WHEN totalrevenue > 0 THEN ebitda / totalrevenue * 100 END AS ebitda_margin_pct, row_number() OVER (PARTITION BY w.symbol, w.period_type ORDER BY w.period_end DESC) AS recency_rank FROM wide w LEFT JOIN securities s USING (symbol)"""
STEPS["fct_dividends"] = f"""SELECT symbol, pay_date, amount, payment_seq, payments_total, coalesce(near, whole)::BIGINT AS payments_per_year, year(pay_date)::BIGINT AS calendar_year FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pay_date) AS payment_seq, count(*) OVER (PARTITION BY symbol) AS payments_total FROM dividends) JOIN (
  SELECT symbol, {_snap("median(gap) FILTER (WHERE pay_date >= DATE '" + AS_OF + "' - INTERVAL 3 YEAR)")} AS near, {_snap("median(gap)")} AS whole FROM (
  SELECT symbol, pay_date, date_diff('day', lag(pay_date) OVER (PARTITION BY symbol ORDER BY pay_date), pay_date) AS gap FROM dividends) GROUP BY symbol) USING (symbol)"""
STEPS["div_windows"] = """SELECT * FROM (SELECT symbol, floor((payments_total - payment_seq) / payments_per_year)::BIGINT AS window_index, sum(amount) AS amount, count(*) AS payments, max(payments_per_year) AS payments_per_year, min(pay_date) AS window_start, max(pay_date) AS window_end
  FROM fct_dividends WHERE payments_per_year IS NOT NULL GROUP BY 1, 2) WHERE payments = payments_per_year"""
STEPS["streaks"] = "SELECT symbol, coalesce(min(CASE WHEN NOT rose THEN window_index END), max(window_index)) AS raise_streak, max(window_index) AS windows_compared FROM (SELECT symbol, window_index, amount > lead(amount) OVER (PARTITION BY symbol ORDER BY window_index) * 1.001::DOUBLE AS rose FROM div_windows) WHERE rose IS NOT NULL GROUP BY symbol"
STEPS["div_years"] = f"SELECT symbol, calendar_year, sum(amount) AS total, count(*) AS payments, max(payments_per_year) AS payments_per_year, calendar_year >= year(DATE '{AS_OF}') AS is_partial FROM fct_dividends GROUP BY 1, 2"
STEPS["payout"] = "SELECT symbol, count(*) AS years_used, sum(abs(cashdividendspaid)) AS dividends_paid, sum(cash) AS distributable_cash FROM (SELECT f.*, CASE WHEN s.is_reit THEN operatingcashflow ELSE freecashflow END AS cash FROM fin f JOIN securities s USING (symbol) WHERE period_type = 'annual' AND recency_rank <= 3) WHERE cashdividendspaid IS NOT NULL AND cash IS NOT NULL GROUP BY symbol"
_ends = ", ".join(f"max(CASE WHEN recency_rank = {r} THEN {c} END) AS {n}_{k}" for n, c in (("revenue", "totalrevenue"), ("eps", "dilutedeps"), ("ffops", "ffo / nullif(dilutedaverageshares, 0)")) for k, r in (("new", "1"), ("old", "old")))
STEPS["endpoints"] = f"SELECT symbol, {_ends}, max(old) - 1 AS growth_years FROM (SELECT *, least(5, max(recency_rank) OVER (PARTITION BY symbol)) AS old FROM fin WHERE period_type = 'annual') GROUP BY symbol"
_base = f"""SELECT s.*, l.* EXCLUDE (symbol, period_type, recency_rank, period_end), l.period_end AS fiscal_year_end, coalesce(st.raise_streak, 0) AS raise_streak, p.dividends_paid, p.distributable_cash,
  CASE WHEN l.ffo > 0 THEN s.market_cap / l.ffo END AS price_to_ffo, CASE WHEN l.ebitda > 0 THEN (l.totaldebt - coalesce(l.cashandcashequivalents, 0)) / l.ebitda END AS net_debt_to_ebitda,
  CASE WHEN abs(l.interestexpense) > 0 THEN (CASE WHEN s.is_reit THEN l.ebitda ELSE l.ebit END) / abs(l.interestexpense) END AS interest_coverage, CASE WHEN l.totalassets > 0 THEN l.totaldebt / l.totalassets END AS debt_to_assets,
  CASE WHEN l.totalrevenue > 0 THEN l.ffo / l.totalrevenue * 100 END AS ffo_margin_pct, CASE WHEN p.distributable_cash > 0 THEN p.dividends_paid / p.distributable_cash * 100 END AS payout_pct,
  CASE WHEN s.five_year_avg_dividend_yield_pct > 0 THEN s.dividend_yield_pct / s.five_year_avg_dividend_yield_pct END AS yield_vs_history, {_cagr("g.revenue_old", "g.revenue_new", "g.growth_years")} AS revenue_cagr_pct,
  CASE WHEN s.is_reit THEN {_cagr("g.ffops_old", "g.ffops_new", "g.growth_years")} ELSE {_cagr("g.eps_old", "g.eps_new", "g.growth_years")} END AS per_share_cagr_pct,
  {_cagr("dw.older", "dw.latest", "dw.dividend_years")} AS dividend_cagr_pct, CASE WHEN l.totalrevenue > 0 THEN l.freecashflow / nullif(s.market_cap, 0) * 100 END AS fcf_yield_pct
  FROM securities s JOIN (SELECT * FROM fin WHERE period_type = 'annual' AND recency_rank = 1) l USING (symbol) LEFT JOIN payout p USING (symbol) LEFT JOIN endpoints g USING (symbol)
  LEFT JOIN (SELECT symbol, max(CASE WHEN window_index = 0 THEN amount END) AS latest, max(CASE WHEN window_index = last THEN amount END) AS older, max(last) AS dividend_years FROM (
    SELECT *, least(5, max(window_index) OVER (PARTITION BY symbol)) AS last FROM div_windows) GROUP BY symbol) dw USING (symbol) LEFT JOIN streaks st USING (symbol)"""
_pays = "coalesce(dividend_yield_pct > 0 AND (dividend_yield_pct >= 0.25 OR coalesce(payout_pct >= 5, false)), false)"
_usable = "coalesce(dividend_yield_pct >= 1 AND five_year_avg_dividend_yield_pct > 0, false)"


def _by(v: str, reit: tuple, std: tuple) -> str:
    return f"CASE WHEN is_reit THEN {_between(v, *map(str, reit))} ELSE {_between(v, *map(str, std))} END"


_pillars = {
    "pillar_dividend": [(f"CASE WHEN {_pays} THEN {_by('payout_pct', (100, 70), (90, 40))} END", 0.55), (f"CASE WHEN {_pays} THEN {_between('raise_streak', '0', '10')} END", 0.45)],
    "pillar_balance_sheet": [(_by("net_debt_to_ebitda", (8, 4.5), (4.5, 1)), 0.5), (_by("interest_coverage", (2, 5.5), (3, 15)), 0.3), (_by("debt_to_assets", ("0.65::DOUBLE", "0.30::DOUBLE"), ("0.6::DOUBLE", "0.20::DOUBLE")), 0.2)],
    "pillar_growth": [(_between("revenue_cagr_pct", "0", "12"), 0.35), (_between("per_share_cagr_pct", "0", "10"), 0.4), (f"CASE WHEN {_pays} THEN {_between('dividend_cagr_pct', '0', '8')} END", 0.25)],
    "pillar_profitability": [(f"CASE WHEN is_reit THEN {_between('ebitda_margin_pct', '40', '70')} ELSE {_between('operating_margin_pct', '5', '30')} END", 0.5), (f"CASE WHEN is_reit THEN {_between('ffo_margin_pct', '30', '65')} ELSE {_between('return_on_equity_pct', '5', '25')} END", 0.5)],
    "pillar_valuation": [(f"CASE WHEN is_reit THEN {_between('price_to_ffo', '28', '13')} ELSE {_between('trailing_pe', '35', '12')} END", 0.6), (f"CASE WHEN {_usable} THEN {_between('yield_vs_history', '0.7::DOUBLE', '1.3::DOUBLE')} ELSE {_between('fcf_yield_pct', '2', '8')} END", 0.4)],
}
_weights = {"pillar_dividend": 25, "pillar_balance_sheet": 25, "pillar_growth": 20, "pillar_profitability": 15, "pillar_valuation": 15}
SCORE_INPUTS = ["payout_pct", "net_debt_to_ebitda", "interest_coverage", "debt_to_assets", "revenue_cagr_pct", "per_share_cagr_pct", "dividend_cagr_pct", "price_to_ffo", "yield_vs_history", "fcf_yield_pct"]
STEPS["score"] = f"""SELECT symbol, name, sector, industry, is_reit, CASE WHEN is_reit THEN 'reit' ELSE 'standard' END AS scoring_basis, fiscal_year_end, overall_score, {_grade("overall_score")} AS grade, coverage_pct,
  {", ".join(f"round({p}) AS {p}" for p in _pillars)}, {_pays} AS pays_dividend, raise_streak::BIGINT AS raise_streak, {", ".join(SCORE_INPUTS)}, market_cap FROM (
  SELECT *, CASE WHEN coverage_pct >= 40 THEN round({_weighted([(p, w / 100) for p, w in _weights.items()])}) END AS overall_score FROM (
  SELECT *, ({" + ".join(f"CASE WHEN {p} IS NOT NULL THEN {w} ELSE 0 END" for p, w in _weights.items())})::DOUBLE AS coverage_pct FROM (
  SELECT *, {", ".join(f"{_weighted(v)} AS {p}" for p, v in _pillars.items())} FROM ({_base}))))"""
STEPS["latest"] = "SELECT symbol, trade_date, close, previous_close, volume, (close - previous_close) / nullif(previous_close, 0) * 100 AS change_pct FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS previous_close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM bars) WHERE n = 1"
STEPS["corrections"] = "SELECT symbol, split_date, ratio, close_step, adj_step, abs(close_step - 1.0 / ratio) < 0.05 / ratio AND abs(close_step - adj_step) < 0.001 AS upstream_missed_it FROM (SELECT s.symbol, split_date, ratio, close / c0 AS close_step, adj_close / a0 AS adj_step FROM splits s JOIN (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS c0, lag(adj_close) OVER (PARTITION BY symbol ORDER BY trade_date) AS a0 FROM bars) b ON b.symbol = s.symbol AND b.trade_date = s.split_date WHERE c0 > 0 AND a0 > 0)"
STEPS["prices"] = "SELECT p.* REPLACE (adj_close / f AS adj_close), f AS correction_factor, adj_close AS adj_close_reported, CASE WHEN close > 0 THEN adj_close / f / close END AS total_return_factor FROM (SELECT b.*, coalesce((SELECT product(ratio) FROM corrections c WHERE c.symbol = b.symbol AND upstream_missed_it AND split_date > trade_date), 1.0)::DOUBLE AS f FROM bars b) p".replace("p.* REPLACE (adj_close / f AS adj_close)", "p.* EXCLUDE (f, adj_close), adj_close / f AS adj_close")
STEPS["months"] = "SELECT symbol, trade_date AS t, close, coalesce(adj_close, close) AS adj_close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', trade_date) ORDER BY trade_date DESC) AS n FROM bars WHERE close > 0) WHERE n = 1"
STEPS["spells"] = """SELECT symbol, index_name, valid_from, CASE WHEN seen <> latest THEN seen END AS valid_to, seen = latest AS is_current, observations, latest AS universe_last_refreshed_on FROM (
  SELECT symbol, index_name, island, min(observed_on) AS valid_from, max(observed_on) AS seen, count(*) AS observations FROM (
  SELECT o.*, seq - row_number() OVER (PARTITION BY symbol, o.index_name ORDER BY seq) AS island FROM (SELECT DISTINCT user_id AS symbol, event_type AS index_name, ts::DATE AS observed_on FROM events) o
  JOIN (SELECT index_name, observed_on, row_number() OVER (PARTITION BY index_name ORDER BY observed_on) AS seq FROM (SELECT DISTINCT event_type AS index_name, ts::DATE AS observed_on FROM events)) d USING (index_name, observed_on)) GROUP BY 1, 2, 3)
  JOIN (SELECT event_type AS index_name, max(ts::DATE) AS latest FROM events GROUP BY 1) USING (index_name)"""
_fact = "symbol, period_type, period_end, metric"
_obs = "SELECT user_id AS symbol, 'annual' AS period_type, DATE '2023-12-31' AS period_end, event_type AS metric, floor(value / 50) AS value, ts AS ingested_at FROM events"


def _knowledge(seen: str) -> str:
    return f"""SELECT *, lead(known_from) OVER (PARTITION BY {_fact} ORDER BY version_seq) AS known_to, count(*) OVER (PARTITION BY {_fact}) AS total_versions FROM (
      SELECT {_fact}, version_seq, max(value) AS value, min("at") AS known_from FROM (SELECT *, sum(is_new) OVER (PARTITION BY {_fact} ORDER BY "at" ROWS UNBOUNDED PRECEDING)::BIGINT AS version_seq FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY {_fact} ORDER BY "at") = 1 OR value IS DISTINCT FROM lag(value) OVER (PARTITION BY {_fact} ORDER BY "at") THEN 1 ELSE 0 END AS is_new FROM ({seen}))) GROUP BY ALL)"""


STEPS["knowledge"] = _knowledge(f'SELECT {_fact}, value, min(ingested_at) AS "at" FROM ({_obs}) GROUP BY ALL')
STEPS["knowledge_all"] = _knowledge(f'SELECT {_fact}, ingested_at AS "at", max(value) AS value FROM ({_obs}) GROUP BY {_fact}, ingested_at')
STEPS["score_stg"] = f"SELECT symbol, score_date, overall_score, {_grade('overall_score')} AS grade FROM (SELECT o_custkey AS symbol, o_orderdate::DATE AS score_date, min((floor(o_totalprice)::BIGINT % 101)::DOUBLE) AS overall_score FROM orders GROUP BY 1, 2)"
STEPS["score_hist"] = "SELECT *, lag(overall_score) OVER w AS previous_score, lag(grade) OVER w AS previous_grade, lag(score_date) OVER w AS previous_score_date, overall_score - lag(overall_score) OVER w AS score_change, grade IS DISTINCT FROM lag(grade) OVER w AS grade_changed, lead(score_date) OVER w IS NULL AS is_latest FROM score_stg WINDOW w AS (PARTITION BY symbol ORDER BY score_date)"
STEPS["holdings"] = "SELECT DISTINCT user_id % 10 AS wallet_id, user_id AS symbol, (1.0 + user_id % 7)::DOUBLE AS shares, CASE WHEN user_id % 3 <> 0 THEN (100.0 + user_id)::DOUBLE END AS cost, DATE '2024-01-01' + (user_id % 20)::INT AS bought_at FROM events"
STEPS["priced"] = "SELECT wallet_id, symbol, shares, value, day_change, cost_total, value - cost_total AS gain, value / nullif(sum(value) OVER (PARTITION BY wallet_id), 0) * 100 AS weight_pct FROM (SELECT h.*, shares * close AS value, shares * (close - previous_close) AS day_change, shares * cost AS cost_total FROM holdings h LEFT JOIN latest USING (symbol))"
STEPS["value_series"] = """SELECT wallet_id, trade_date, value, held FROM (SELECT wallet_id, trade_date, sum(shares * price) AS value, bool_and(price IS NOT NULL) AS whole, count(*) AS held FROM (
  SELECT g.*, last_value(close IGNORE NULLS) OVER (PARTITION BY wallet_id, symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS price FROM (SELECT s.wallet_id, s.trade_date, h.symbol, h.shares, h.bought_at, b.close FROM (SELECT DISTINCT wallet_id, trade_date FROM bars JOIN holdings USING (symbol)) s
  JOIN holdings h USING (wallet_id) LEFT JOIN bars b ON b.symbol = h.symbol AND b.trade_date = s.trade_date) g) WHERE bought_at IS NULL OR bought_at <= trade_date GROUP BY 1, 2) WHERE whole"""
STEPS["mixed_holdings"] = "SELECT DISTINCT user_id % 23 AS wallet_id, CASE WHEN user_id % 12 = 7 THEN user_id + 1000000 ELSE user_id END AS symbol, (1.0 + user_id % 7)::DOUBLE AS shares, CASE WHEN user_id % 4 <> 0 THEN DATE '2024-01-01' + (user_id % 20)::INT - CASE WHEN user_id % 5 = 0 THEN 40 ELSE 0 END END AS bought_at FROM events"
STEPS["mixed_grid"] = """SELECT wallet_id, trade_date, sum(CASE WHEN own THEN shares * price END) AS value, bool_and(price IS NOT NULL) FILTER (WHERE own) AS whole, count(*) FILTER (WHERE own) AS held FROM (
  SELECT g.*, bought_at IS NULL OR bought_at <= trade_date AS own, last_value(close IGNORE NULLS) OVER (PARTITION BY wallet_id, symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS price FROM (SELECT s.wallet_id, s.trade_date, h.symbol, h.shares, h.bought_at, b.close FROM (SELECT DISTINCT wallet_id, trade_date FROM bars JOIN mixed_holdings USING (symbol)) s
  JOIN (SELECT * FROM mixed_holdings WHERE symbol IN (SELECT symbol FROM bars)) h USING (wallet_id) LEFT JOIN bars b ON b.symbol = h.symbol AND b.trade_date = s.trade_date) g) GROUP BY 1, 2"""
STEPS["mixed_start"] = """SELECT h.wallet_id, started_at, CASE WHEN started_at IS NOT NULL THEN CASE WHEN unheld THEN 'purchase' ELSE 'coverage' END END AS start_reason, first_purchase, coalesce(points, 0) AS points FROM (SELECT wallet_id, min(bought_at) FILTER (WHERE symbol IN (SELECT symbol FROM bars)) AS first_purchase FROM mixed_holdings GROUP BY 1) h
  LEFT JOIN (SELECT wallet_id, min(trade_date) FILTER (WHERE held > 0 AND whole) AS started_at, bool_or(held = 0) AS unheld, count(*) FILTER (WHERE held > 0 AND whole) AS points FROM mixed_grid GROUP BY 1) g USING (wallet_id)"""
STEPS["totals"] = """SELECT symbol, window_index, sum(amount) AS amount, max(per_year)::BIGINT AS per_year FROM (SELECT d.symbol, amount, floor(back / per_year)::BIGINT AS window_index, per_year, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pay_date DESC) - 1 AS back FROM dividends) d
  JOIN (SELECT symbol, n, greatest(1, least(12, round(365.25 / gaps[len(gaps) // 2 + 1])::INT)) AS per_year FROM (SELECT symbol, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM (SELECT symbol, date_diff('day', lag(pay_date) OVER (PARTITION BY symbol ORDER BY pay_date), pay_date) AS gap FROM dividends) GROUP BY symbol) WHERE len(gaps) > 0) p USING (symbol)) WHERE window_index < 11 AND (window_index + 1) * per_year <= n GROUP BY 1, 2"""
STEPS["old_holdings"] = "SELECT c_custkey % 10 AS wallet_id, c_custkey AS symbol, (1.0 + c_custkey % 7)::DOUBLE AS shares, CASE WHEN c_custkey % 4 <> 0 THEN DATE '1996-01-01' + (c_custkey % 1000)::INT END AS bought_at FROM customer"
STEPS["income"] = f"SELECT wallet_id, symbol, pay_date AS ex_date, amount, shares * amount AS income FROM dividends JOIN old_holdings USING (symbol) WHERE bought_at IS NOT NULL AND bought_at < pay_date AND pay_date <= DATE '{AS_OF}'"
_flow = ", ".join(f"CASE WHEN count({c}) OVER w = count(*) OVER w THEN sum({c}) OVER w * 4 / count(*) OVER w END AS {c}" for c in FLOWS)
STEPS["ttm"] = f"SELECT symbol, period_end, {_flow}, totaldebt, cashandcashequivalents, totalassets, stockholdersequity, dilutedaverageshares, count(*) OVER w AS quarters_used FROM wide_quarterly WINDOW w AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"

_more = ", ".join(f"{'CASE WHEN symbol % 4 > 1 OR symbol % 4 = 1 AND year(period_end) % 2 = 1 THEN ' if m == 'researchanddevelopment' else ''}floor(totalrevenue * ({a}::DOUBLE + {b}::DOUBLE * (symbol % 7) + {c}::DOUBLE * (year(period_end) % 3)) * 100.0::DOUBLE + 0.3333::DOUBLE) / 100.0::DOUBLE{' END' if m == 'researchanddevelopment' else ''} AS {m}" for m, (a, b, c) in MORE_LINES.items())
STEPS["wide_full"] = f"SELECT *, totalrevenue - costofrevenue AS grossprofit, interestincome - interestexpense AS netinterestincome, 0.2::DOUBLE + 0.01::DOUBLE * (symbol % 7) AS taxrateforcalcs, floor(netincome / (dilutedaverageshares - 50.0::DOUBLE) * 10000.0::DOUBLE + 0.3333::DOUBLE) / 10000.0::DOUBLE AS basiceps FROM (SELECT *, {_more} FROM wide)"
STEPS["fin_full"] = f"""SELECT w.symbol, w.period_type, w.period_end, {", ".join("w." + m for m in ALL_METRICS)}, CASE WHEN s.is_reit THEN netincome + depreciationandamortization END AS ffo, CASE WHEN totalrevenue > 0 THEN netincome / totalrevenue * 100 END AS net_margin_pct,
  row_number() OVER (PARTITION BY w.symbol, w.period_type ORDER BY w.period_end DESC) AS recency_rank FROM wide_full w LEFT JOIN securities s USING (symbol)"""
_all_flows = ", ".join(f"CASE WHEN count({c}) OVER w = count(*) OVER w THEN sum({c}) OVER w * 4 / count(*) OVER w END AS {c}" for c in ALL_FLOWS)
STEPS["ttm_full"] = f"SELECT symbol, period_end, {_all_flows}, count(*) OVER w AS quarters_used FROM wide_full WHERE period_type = 'quarterly' WINDOW w AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
STEPS["income_months"] = """SELECT wallet_id, month, coalesce(c, 0) AS c FROM (SELECT wallet_id, unnest(generate_series(date_trunc('month', min(ex_date)), date_trunc('month', max(ex_date)), INTERVAL 1 MONTH))::DATE AS month FROM income GROUP BY wallet_id)
  LEFT JOIN (SELECT wallet_id, date_trunc('month', ex_date)::DATE AS month, round(sum(income) * 100)::BIGINT AS c FROM income GROUP BY 1, 2) USING (wallet_id, month)"""
STEPS["projected"] = f"""SELECT wallet_id, symbol, shares * c / 100.0::DOUBLE AS current_annual, growth_pct, years_of_growth, coalesce(growth_pct > 20, false) AS fast_growth FROM old_holdings
  JOIN (SELECT symbol, sum(round(amount * 100)::BIGINT)::BIGINT AS c FROM dividends WHERE pay_date > DATE '{AS_OF}' - 365 AND pay_date <= DATE '{AS_OF}' GROUP BY 1) USING (symbol)
  LEFT JOIN (SELECT symbol, CASE WHEN n > 0 AND a > 0 AND b > 0 THEN (pow(b / a, 1.0 / n) - 1) * 100 END AS growth_pct, n AS years_of_growth FROM (SELECT symbol, arg_max(amount, window_index) AS a, arg_min(amount, window_index) AS b, max(window_index) AS n FROM totals WHERE window_index <= 5 GROUP BY 1)) USING (symbol)"""


# The on-line score, brute force: every point with all of its earlier statements and payments.
STEPS["old_bars"] = """SELECT symbol, trade_date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q::BIGINT)::BIGINT AS volume, arg_max(price, k) * (1.0::DOUBLE - arg_max(l_discount, k)) AS adj_close FROM (
  SELECT l_suppkey AS symbol, l_shipdate::DATE AS trade_date, l_discount, l_quantity AS q, floor(l_extendedprice / l_quantity * 100) / 100.0::DOUBLE AS price, (l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_quantity > 0) WHERE price > 0 GROUP BY 1, 2"""
STEPS["supplier_holdings"] = "SELECT s_suppkey % 7 AS wallet_id, s_suppkey AS symbol, (1.0 + s_suppkey % 5)::DOUBLE AS shares, DATE '1995-03-01' + (s_suppkey * 13 % 1500)::INT AS bought_at FROM supplier"
STEPS["supplier_series"] = """SELECT wallet_id, trade_date, value, held FROM (SELECT wallet_id, trade_date, sum(shares * price) AS value, bool_and(price IS NOT NULL) AS whole, count(*) AS held FROM (
  SELECT g.*, last_value(close IGNORE NULLS) OVER (PARTITION BY wallet_id, symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS price FROM (SELECT s.wallet_id, s.trade_date, h.symbol, h.shares, h.bought_at, b.close FROM (SELECT DISTINCT wallet_id, trade_date FROM old_bars JOIN supplier_holdings USING (symbol)) s
  JOIN (SELECT * FROM supplier_holdings WHERE symbol IN (SELECT symbol FROM old_bars)) h USING (wallet_id) LEFT JOIN old_bars b ON b.symbol = h.symbol AND b.trade_date = s.trade_date) g) WHERE bought_at <= trade_date GROUP BY 1, 2) WHERE whole"""


STEPS["supplier_twr"] = """SELECT *, CASE WHEN years >= 1 THEN (pow(1 + twr_pct / 100, 1.0 / years) - 1) * 100 END AS annualised_pct FROM (SELECT wallet_id, (product(b / a) FILTER (WHERE n > 1 AND a > 0) - 1) * 100 AS twr_pct, count(*) FILTER (WHERE n > 1 AND a > 0) AS segments, date_diff('day', min(d0), max(d1)) / 365.25 AS years FROM (SELECT wallet_id, seg, count(*) AS n, min(trade_date) AS d0, max(trade_date) AS d1, arg_min(value, trade_date) AS a, arg_max(value, trade_date) AS b FROM (SELECT *, sum(cut) OVER (PARTITION BY wallet_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, coalesce((held <> lag(held) OVER (PARTITION BY wallet_id ORDER BY trade_date))::INT, 0) AS cut FROM supplier_series)) GROUP BY 1, 2) GROUP BY wallet_id) WHERE segments > 0"""
STEPS["goal_wallets"] = f"""SELECT wallet_id, value, start_value, started_at, annual_income, contributions, CASE WHEN wallet_id <> 3 THEN annualised_pct END AS measured_pct FROM (SELECT wallet_id, arg_max(value, trade_date) AS value, arg_min(value, trade_date) AS start_value, min(trade_date) AS started_at FROM supplier_series GROUP BY 1) v
  LEFT JOIN (SELECT wallet_id, sum(shares * c / 100.0::DOUBLE) AS annual_income FROM supplier_holdings JOIN (SELECT symbol, sum(round(amount * 100)::BIGINT)::BIGINT AS c FROM dividends WHERE pay_date > DATE '{AS_OF}' - 365 AND pay_date <= DATE '{AS_OF}' GROUP BY 1) USING (symbol) GROUP BY 1) USING (wallet_id)
  LEFT JOIN (SELECT wallet_id, count(*) AS contributions FROM supplier_holdings JOIN (SELECT wallet_id, min(trade_date) AS d FROM supplier_series GROUP BY 1) USING (wallet_id) WHERE bought_at > d AND symbol IN (SELECT symbol FROM old_bars) GROUP BY 1) USING (wallet_id) LEFT JOIN supplier_twr USING (wallet_id)"""
STEPS["goals"] = f"""SELECT *, NULL::VARCHAR AS reason, least(100, value / required_value * 100) AS progress_pct, y * 100 AS yield_pct, greatest(0, required_value - value) AS shortfall, 62914.29::DOUBLE / nullif(y, 0) AS value_for_dividends_alone, value * 0.03::DOUBLE AS withdrawal_today, value * y AS dividends_today, least(value * y, value * 0.03::DOUBLE) AS from_dividends_today, greatest(0, value * 0.03::DOUBLE - value * y) AS from_sales_today,
  greatest(0, value * y - value * 0.03::DOUBLE) AS surplus_today, required_value * 0.03::DOUBLE AS withdrawal_at_target, least(required_value * y, required_value * 0.03::DOUBLE) AS from_dividends_at_target, greatest(0, required_value * 0.03::DOUBLE - required_value * y) AS from_sales_at_target, least(100, y / 0.03::DOUBLE * 100) AS covered_pct, (value / start_value - 1) * 100 AS grew_by_pct,
  CASE WHEN coalesce(contributions, 0) = 0 AND years >= 1 THEN (pow(value / start_value, 1.0::DOUBLE / years) - 1) * 100 END AS annualised_pct FROM (SELECT *, 62914.29::DOUBLE / 0.03::DOUBLE AS required_value, coalesce(annual_income, 0) / value AS y, date_diff('day', started_at, DATE '{AS_OF}') / 365.25::DOUBLE AS years FROM goal_wallets)"""
STEPS["facets"] = """SELECT wallet_id, label, sum(n)::BIGINT AS members, count(*) AS folded, array_to_string(list_sort(flatten(list(symbols))), ' ') AS symbols, CASE WHEN label = 'Other' THEN string_agg(own, ' ' ORDER BY rank) ELSE NULL END AS folded_labels FROM (SELECT *, CASE WHEN groups > 6 AND rank > 5 THEN 'Other' ELSE own END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet_id ORDER BY value DESC, own) AS rank, count(*) OVER (PARTITION BY wallet_id) AS groups FROM (SELECT wallet_id, (symbol % 9)::VARCHAR AS own, sum(value) AS value, count(*) AS n, list(symbol) AS symbols FROM priced WHERE value > 0 GROUP BY 1, 2))) GROUP BY 1, 2"""
STEPS["late_knowledge"] = f"SELECT * REPLACE (CASE WHEN symbol % 20 = 0 AND version_seq = 2 THEN known_to + INTERVAL 100 DAY ELSE known_to END AS known_to), lead(known_from) OVER (PARTITION BY {_fact} ORDER BY known_from) AS next_start FROM knowledge"
STEPS["late_spells"] = "SELECT * REPLACE (CASE WHEN symbol % 20 = 0 THEN valid_to + 5 ELSE valid_to END AS valid_to), lead(valid_from) OVER (PARTITION BY symbol, index_name ORDER BY valid_from) AS next_start FROM spells"
STEPS["uncorrected"] = "SELECT DISTINCT c.symbol, c.split_date, 1.0::DOUBLE AS factor FROM corrections c JOIN bars b ON b.symbol = c.symbol AND b.trade_date < c.split_date WHERE c.symbol % 20 <> 0"
_suite = {
    "currency_not_null": ("error", "(SELECT 1 FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 1 FROM customer WHERE c_custkey % 200 = 0)"), "symbol_unique": ("error", "(SELECT 1 FROM customer WHERE c_custkey % 200 = 0)"), "market_cap_positive": ("warn", "(SELECT 1 FROM customer WHERE c_custkey % 25 = 0 OR round(abs(c_acctbal) * 1000, 2) <= 0 UNION ALL SELECT 1 FROM customer WHERE c_custkey % 200 = 0)"),
    "cadence_accepted": ("error", "(SELECT 1 FROM fct_dividends WHERE symbol % 30 = 0)"), "dividends_of_known_symbols": ("error", "(SELECT 1 FROM fct_dividends WHERE symbol % 77 = 0 OR symbol NOT IN (SELECT symbol FROM securities))"), "dividend_unique": ("error", "(SELECT 1 WHERE false)"),
    "score_day_unique": ("error", "(SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate::DATE HAVING count(*) > 1)"), "score_in_range": ("error", "(SELECT 1 FROM score_stg WHERE symbol % 40 = 0 AND overall_score > 40)"),
    "grade_matches_score": ("error", f"(SELECT 1 FROM (SELECT symbol, CASE WHEN symbol % 40 = 0 THEN overall_score + 60 ELSE overall_score END AS s, CASE WHEN symbol % 50 = 0 THEN 'A' ELSE grade END AS g FROM score_stg) WHERE g IS DISTINCT FROM ({_grade('s')}))"), "period_type_accepted": ("error", "(SELECT 1 WHERE false)"),
    "ebitda_present_with_revenue": ("warn", "(SELECT 1 FROM fin LEFT JOIN securities USING (symbol) WHERE period_type = 'annual' AND symbol % 10 = 0 AND totalrevenue IS NOT NULL AND sector IS DISTINCT FROM 'MACHINERY')"), "statement_unique": ("error", "(SELECT 1 WHERE false)"),
    "knowledge_intervals_do_not_overlap": ("error", "(SELECT 1 FROM late_knowledge WHERE next_start IS NOT NULL AND (known_to IS NULL OR known_to > next_start))"), "membership_spells_do_not_overlap": ("error", "(SELECT 1 FROM late_spells WHERE next_start IS NOT NULL AND (valid_to IS NULL OR valid_to >= next_start))"),
    "payout_ratio_sane": ("warn", "(SELECT 1 FROM score WHERE payout_pct > 60)"), "coverage_in_range": ("error", "(SELECT 1 WHERE false)"), "missed_splits_are_corrected": ("error", "uncorrected"),
    "no_phantom_dividend_cut": ("error", "(SELECT 1 FROM (SELECT *, lag(total) OVER (PARTITION BY symbol ORDER BY calendar_year) AS b FROM div_years WHERE NOT is_partial) WHERE total < b AND symbol NOT IN (SELECT symbol FROM (SELECT *, lead(amount) OVER (PARTITION BY symbol ORDER BY window_index) AS older FROM div_windows) WHERE amount < older))"),
    "no_unadjusted_split": ("warn", "(SELECT 1 FROM (SELECT adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY trade_date) AS step FROM prices) WHERE " + " OR ".join(f"abs(step - {r}::DOUBLE) < {0.01 * r!r}::DOUBLE" for r in (0.5, 0.25, 0.3333, 0.6667, 2.0, 3.0)) + ")"),
    "prices_are_fresh": ("warn", "(SELECT 1 FROM bars HAVING date_diff('day', max(trade_date), DATE '2024-03-01') > 4)"), "dividend_record_not_truncated": ("error", "(SELECT 1 FROM fct_dividends WHERE symbol IN (SELECT symbol FROM (SELECT symbol, lead(y) OVER (PARTITION BY symbol ORDER BY y) - y AS gap FROM (SELECT DISTINCT symbol, calendar_year AS y FROM fct_dividends)) WHERE gap > 1) GROUP BY symbol HAVING count(*) = 9)"),
    "reit_affo_proxy_still_needed": ("warn", "(SELECT 1 FROM (SELECT count(DISTINCT symbol) AS n, count(DISTINCT symbol) FILTER (WHERE capitalexpenditure IS NOT NULL) AS c FROM fin_full JOIN securities USING (symbol) WHERE is_reit) WHERE n > 0 AND n = c)"),
}
STEPS["suite"] = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{sev}' AS severity, count(*) AS offending FROM {rows}" for n, (sev, rows) in _suite.items())


def _not(n: int, x: str) -> str:
    return f"CASE WHEN symbol % {n} <> 1 THEN ({x})::DOUBLE END"


STEPS["securities_full"] = f"""SELECT * EXCLUDE (dividend_yield_pct), CASE WHEN symbol % 9 <> 0 THEN dividend_yield_pct END AS dividend_yield_pct, {_not(11, "7.0 + symbol % 25")} AS forward_pe, {_not(5, "(symbol % 30) / 16.0")} AS peg_ratio, {_not(7, "0.5 + (symbol % 16) / 16.0")} AS beta, {_not(13, "0.5 + (symbol % 24) / 8.0")} AS current_ratio,
  {_not(17, "1000 + symbol * 37 % 5000")} AS shares_outstanding, {_not(6, "(symbol % 40) / 512.0")} AS short_percent_of_float, {_not(8, "(symbol % 21 - 10) / 64.0")} AS quarterly_earnings_growth, {_not(4, "946684800 + symbol * 86400")} AS ex_dividend_epoch, CASE WHEN symbol % 4 = 2 THEN 962409600 + symbol * 86400 END AS next_dividend_epoch FROM securities"""


def _bundle(bars: str, day: str) -> str:
    year = f"trade_date >= (DATE '{day}' - INTERVAL 12 MONTH)::DATE"
    return f"""SELECT *, CASE WHEN high_52w > low_52w THEN greatest(0, least(100, (close - low_52w) / (high_52w - low_52w) * 100)) END AS range_position, market_cap + totaldebt - coalesce(cashandcashequivalents, 0) AS enterprise_value, market_cap / nullif(totalrevenue, 0) AS price_to_sales, market_cap / nullif(stockholdersequity, 0) AS price_to_book,
      stockholdersequity / nullif(dilutedaverageshares, 0) AS book_per_share, grossprofit / nullif(totalrevenue, 0) AS gross_margin, netincome / nullif(totalrevenue, 0) AS profit_margin, operatingincome / nullif(totalrevenue, 0) AS operating_margin, netincome / nullif(totalassets, 0) AS return_on_assets, abs(cashdividendspaid) / nullif(netincome, 0) AS payout_ratio,
      totaldebt / nullif(stockholdersequity, 0) * 100 AS debt_to_equity, CASE WHEN pays_dividend THEN dividend_yield_pct / 100 * close END AS dividend_rate, CASE WHEN close_1y_ago > 0 THEN (close - close_1y_ago) / close_1y_ago END AS change_52w, CASE WHEN r0 > 0 THEN (totalrevenue - r0) / r0 END AS revenue_growth, CASE WHEN i0 > 0 THEN (netincome - i0) / i0 END AS earnings_growth
      FROM securities_full LEFT JOIN (SELECT symbol, max(trade_date) AS price_as_of, arg_max(open, trade_date) AS open, arg_max(high, trade_date) AS day_high, arg_max(low, trade_date) AS day_low, arg_max(close, trade_date) AS close, arg_max(volume, trade_date) AS volume, max(close) FILTER (WHERE rn = 2) AS previous_close, max(high) FILTER (WHERE {year}) AS high_52w,
        min(low) FILTER (WHERE {year}) AS low_52w, arg_min(close, trade_date) FILTER (WHERE {year}) AS close_1y_ago, avg(close) FILTER (WHERE rn <= 50) AS ma_50, avg(close) FILTER (WHERE rn <= 200) AS ma_200, avg(volume) FILTER (WHERE rn <= 90) AS avg_volume_90 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM {bars} WHERE trade_date <= DATE '{day}') GROUP BY symbol) USING (symbol)
      LEFT JOIN (SELECT * EXCLUDE (period_type, period_end), lead(totalrevenue) OVER w AS r0, lead(netincome) OVER w AS i0 FROM fin_full WHERE period_type = 'annual' WINDOW w AS (PARTITION BY symbol ORDER BY recency_rank) QUALIFY recency_rank = 1) USING (symbol) LEFT JOIN (SELECT symbol, pays_dividend FROM score) USING (symbol)"""


STEPS["bundle_old"], STEPS["bundle_new"] = _bundle("old_bars", "2000-06-30"), _bundle("bars", "2024-01-31")
STEPS["bundle_ev"] = "SELECT *, enterprise_value / nullif(ebitda, 0) AS ev_to_ebitda FROM bundle_old"
_share = {"share": "({}) * 100"}
STEPS["profile"] = "SELECT symbol, place, \"group\", label, value, day, kind, comparable FROM (" + " UNION ALL ".join(
    f"SELECT symbol, dividend_yield_pct, dividend_rate, {n} AS place, '{g}' AS \"group\", '{label}' AS label, {'NULL::DOUBLE' if kind == 'date' else _share.get(kind, '{}').format(c) + '::DOUBLE'} AS value, {f'to_timestamp({c}::BIGINT)::DATE' if kind == 'date' else 'NULL::DATE'} AS day, '{'percent' if kind == 'share' else kind}' AS kind, {'NOT is_reit' if label in EARNINGS_BASED else 'true'} AS comparable FROM bundle_ev"
    for n, (g, label, c, kind) in enumerate(((g, *m) for g, ms in PROFILE.items() for m in ms), 1)) + ") WHERE (value IS NOT NULL OR day IS NOT NULL) AND (\"group\" <> 'Dividend' OR dividend_yield_pct IS NOT NULL OR dividend_rate IS NOT NULL)"
STEPS["old_months"] = "SELECT symbol, t, close, adj_close FROM (SELECT symbol, trade_date AS t, close, adj_close, row_number() OVER (PARTITION BY symbol, date_trunc('month', trade_date) ORDER BY trade_date DESC) AS n FROM old_bars) WHERE n = 1"
STEPS["supplier_scores"] = """SELECT wallet_id, t, sum(CASE WHEN s IS NOT NULL THEN round(shares * c * s, 6) END) / sum(CASE WHEN s IS NOT NULL THEN round(shares * c, 6) END) AS score, sum(CASE WHEN s IS NOT NULL THEN shares * c END) / sum(shares * c) * 100 AS coverage_pct FROM (
  SELECT d.wallet_id, d.t, h.shares, b.close AS c, g.overall_score AS s FROM (SELECT DISTINCT wallet_id, t FROM old_months JOIN supplier_holdings USING (symbol)) d JOIN supplier_holdings h ON h.wallet_id = d.wallet_id AND bought_at <= d.t ASOF JOIN old_months b ON b.symbol = h.symbol AND d.t >= b.t ASOF LEFT JOIN score_stg g ON g.symbol = h.symbol AND d.t >= g.score_date) GROUP BY 1, 2 HAVING sum(CASE WHEN s IS NOT NULL THEN shares * c END) > 0"""
_m = ", ".join(METRICS)
STEPS["sl_rows"] = f"""SELECT symbol, 'annual' AS kind, period_end, {_m}, NULL::BIGINT AS quarters_used, 0 AS lane FROM wide_annual UNION ALL
  SELECT symbol, 'quarterly', period_end, {_m}, quarters_used, (row_number() OVER (PARTITION BY symbol ORDER BY period_end) - 1) % 4 FROM ttm"""
STEPS["sl_points"] = """SELECT symbol, kind, period_end AS period, coalesce(lag(period_end) OVER (PARTITION BY symbol, kind ORDER BY period_end), (period_end - CASE WHEN kind = 'annual' THEN INTERVAL 12 MONTH ELSE INTERVAL 3 MONTH END)::DATE) AS window_start FROM sl_rows
  UNION ALL SELECT symbol, 'now', DATE '9999-12-31', NULL FROM wide_annual GROUP BY symbol"""
STEPS["sl_series"] = f"""SELECT *, row_number() OVER (PARTITION BY symbol, kind, period ORDER BY period_end DESC) AS back FROM (
  SELECT p.kind, p.period_end AS period, r.* EXCLUDE (kind, lane) FROM sl_rows p JOIN sl_rows r ON r.symbol = p.symbol AND r.kind = p.kind AND r.lane = p.lane AND r.period_end <= p.period_end
  UNION ALL BY NAME SELECT 'now' AS kind, DATE '9999-12-31' AS period, * EXCLUDE (kind, lane) FROM sl_rows WHERE kind = 'annual')"""
_values = ", ".join(f"list({c} ORDER BY period_end) FILTER (WHERE back <= 5 AND {c} IS NOT NULL) AS {n}_values" for n, c in (("revenue", "totalrevenue"), ("eps", "dilutedeps"), ("ffops", "((netincome + depreciationandamortization) / nullif(dilutedaverageshares, 0))")))
_cash = ", ".join(f"sum({x}) FILTER (WHERE back <= 3 AND cashdividendspaid IS NOT NULL AND {c} IS NOT NULL) AS {n}_{c}" for c in ("freecashflow", "operatingcashflow") for n, x in (("paid_on", "abs(cashdividendspaid)"), ("sum_of", c)))
STEPS["sl_states"] = f"SELECT symbol, kind, period, {', '.join(f'max({c}) FILTER (WHERE back = 1) AS {c}' for c in [*METRICS, 'quarters_used', 'period_end'])}, count(*) AS statement_periods, count(cashdividendspaid) FILTER (WHERE back <= 3) AS payout_years, {_values}, {_cash} FROM sl_series GROUP BY 1, 2, 3"
STEPS["sl_record"] = """SELECT p.symbol, kind, period, list(amount ORDER BY pay_date) AS a, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g, sum(amount) FILTER (WHERE pay_date > period - 365) AS paid_1y
  FROM sl_points p JOIN (SELECT *, date_diff('day', lag(pay_date) OVER (PARTITION BY symbol ORDER BY pay_date), pay_date) AS gap FROM dividends) d ON d.symbol = p.symbol AND pay_date <= period GROUP BY 1, 2, 3"""
STEPS["sl_totals"] = """SELECT *, CASE WHEN py IS NOT NULL THEN list_transform(range(1, least(11, len(a) // py) + 1), lambda k: list_sum(a[(len(a) - k * py + 1) : (len(a) - (k - 1) * py)])) END AS t FROM (
  SELECT *, CASE WHEN g[len(g) // 2 + 1] > 0 THEN greatest(1, least(12, round(365.25 / g[len(g) // 2 + 1])))::BIGINT END AS py FROM sl_record)"""
STEPS["sl_paid"] = f"""SELECT symbol, kind, period, paid_1y, greatest(coalesce(len(t), 0) - 1, 0)::BIGINT AS totals_compared, coalesce(list_position(rose, false) - 1, len(rose), 0)::BIGINT AS streak, CASE WHEN len(t) > 1 THEN {_cagr("t[least(6, len(t))]", "t[1]", "(least(6, len(t)) - 1)")} END AS dividend_cagr
  FROM (SELECT *, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] > t[i + 1] * 1.001::DOUBLE) END AS rose FROM sl_totals)"""
STEPS["sl_priced"] = """SELECT p.*, c.t AS quoted_on, c.close AS price, c.adj_close AS adj_now, b.t AS quoted_before, b.adj_close AS adj_before FROM (SELECT * FROM sl_points WHERE kind <> 'now') p
  ASOF LEFT JOIN old_months c ON c.symbol = p.symbol AND p.period >= c.t ASOF LEFT JOIN old_months b ON b.symbol = p.symbol AND p.window_start >= b.t"""
_fields = "st.*, coalesce(d.streak, 0) AS streak, coalesce(d.totals_compared, 0) AS totals_compared, d.dividend_cagr"
STEPS["sl_now_base"] = f"SELECT {_fields}, s.name, s.sector, s.is_reit, s.market_cap, s.trailing_pe, s.dividend_yield_pct, s.five_year_avg_dividend_yield_pct, s.return_on_equity_pct FROM sl_states st JOIN securities s USING (symbol) LEFT JOIN sl_paid d USING (symbol, kind, period) WHERE st.kind = 'now'"
STEPS["sl_then_base"] = f"""SELECT {_fields}, coalesce(s.is_reit, false) AS is_reit, dilutedaverageshares * price AS market_cap, CASE WHEN dilutedeps > 0 THEN price / dilutedeps END AS trailing_pe, CASE WHEN paid_1y > 0 AND price > 0 THEN paid_1y / price * 100 END AS dividend_yield_pct,
  NULL::DOUBLE AS five_year_avg_dividend_yield_pct, CASE WHEN stockholdersequity > 0 THEN netincome / stockholdersequity * 100 END AS return_on_equity_pct, price, window_start, CASE WHEN quoted_before < quoted_on AND adj_before > 0 AND adj_now > 0 THEN (adj_now / adj_before - 1) * 100 END AS period_return
  FROM sl_states st JOIN sl_priced USING (symbol, kind, period) LEFT JOIN securities s USING (symbol) LEFT JOIN sl_paid d USING (symbol, kind, period)"""


def _list_cagr(v: str) -> str:
    return f"CASE WHEN len({v}) > 1 THEN {_cagr(f'{v}[1]', f'{v}[-1]', f'(len({v}) - 1)')} END"


_lively = f"""SELECT *, coalesce(dividend_yield_pct > 0 AND (dividend_yield_pct >= 0.25 OR coalesce(payout_pct >= 5, false)), false) AS pays_dividend, {_usable} AS usable, price_to_ffo_ AS price_to_ffo FROM (
  SELECT *, CASE WHEN is_reit THEN CASE WHEN sum_of_operatingcashflow > 0 THEN paid_on_operatingcashflow / sum_of_operatingcashflow * 100 END WHEN sum_of_freecashflow > 0 THEN paid_on_freecashflow / sum_of_freecashflow * 100 END AS payout_pct,
  market_cap / nullif(ffo_, 0) AS price_to_ffo_, ffo_ / nullif(dilutedaverageshares, 0) AS ffo_per_share, (totaldebt - coalesce(cashandcashequivalents, 0)) / nullif(ebitda, 0) AS net_debt_to_ebitda, CASE WHEN is_reit THEN ebitda ELSE ebit END / nullif(abs(interestexpense), 0) AS interest_coverage,
  totaldebt / nullif(totalassets, 0) AS debt_to_assets, {_list_cagr("revenue_values")} AS revenue_cagr, CASE WHEN is_reit THEN {_list_cagr("ffops_values")} ELSE {_list_cagr("eps_values")} END AS per_share_cagr, dividend_yield_pct / nullif(five_year_avg_dividend_yield_pct, 0) AS yield_vs_history,
  CASE WHEN is_reit THEN ffo_ ELSE freecashflow END / nullif(market_cap, 0) * 100 AS cash_yield, CASE WHEN is_reit THEN ebitda ELSE operatingincome END / nullif(totalrevenue, 0) * 100 AS margin, CASE WHEN is_reit THEN ffo_ / nullif(totalrevenue, 0) * 100 ELSE return_on_equity_pct END AS return_pct
  FROM (SELECT *, netincome + depreciationandamortization AS ffo_ FROM BASE))"""
_pay = lambda x: f"CASE WHEN pays_dividend THEN {x} END"
#: pillar: (metric's name, value, kind, of, score, weight)
_live_parts = {
    "Dividend safety": [("CASE WHEN is_reit THEN 'Payout / cash flow' ELSE 'Payout / free cash flow' END", _pay("payout_pct"), "'percent'", "payout_years", _pay(_by("payout_pct", (100, 70), (90, 40))), 0.55), ("'Years of consecutive raises'", _pay("streak::DOUBLE"), "'count'", "totals_compared", _pay(_between("streak", "0", "10")), 0.45)],
    "Balance sheet": [("'Net debt / EBITDA'", "net_debt_to_ebitda", "'multiple'", "NULL", _by("net_debt_to_ebitda", (8, 4.5), (4.5, 1)), 0.5), ("'Interest coverage'", "interest_coverage", "'multiple'", "NULL", _by("interest_coverage", (2, 5.5), (3, 15)), 0.3), ("'Debt / assets'", "debt_to_assets * 100", "'percent'", "NULL", _by("debt_to_assets", ("0.65::DOUBLE", "0.3::DOUBLE"), ("0.6::DOUBLE", "0.2::DOUBLE")), 0.2)],
    "Growth": [("'Revenue CAGR'", "revenue_cagr", "'percent'", "NULL", _between("revenue_cagr", "0", "12"), 0.35), ("CASE WHEN is_reit THEN 'FFO / share CAGR' ELSE 'EPS CAGR' END", "per_share_cagr", "'percent'", "NULL", _between("per_share_cagr", "0", "10"), 0.4), ("'Dividend CAGR'", _pay("dividend_cagr"), "'percent'", "NULL", _pay(_between("dividend_cagr", "0", "8")), 0.25)],
    "Profitability": [("CASE WHEN is_reit THEN 'EBITDA margin' ELSE 'Operating margin' END", "margin", "'percent'", "NULL", _by("margin", (40, 70), (5, 30)), 0.5), ("CASE WHEN is_reit THEN 'FFO margin' ELSE 'Return on equity' END", "return_pct", "'percent'", "NULL", _by("return_pct", (30, 65), (5, 25)), 0.5)],
    "Valuation": [("CASE WHEN is_reit THEN 'P / FFO' ELSE 'P / E (TTM)' END", "CASE WHEN is_reit THEN price_to_ffo ELSE trailing_pe END", "'multiple'", "NULL", f"CASE WHEN is_reit THEN {_between('price_to_ffo', '28', '13')} ELSE {_between('trailing_pe', '35', '12')} END", 0.6),
      ("CASE WHEN usable THEN 'Yield vs 5-year average' WHEN is_reit THEN 'FFO yield' ELSE 'Free cash flow yield' END", "CASE WHEN usable THEN yield_vs_history ELSE cash_yield END", "CASE WHEN usable THEN 'multiple' ELSE 'percent' END", "NULL", f"CASE WHEN usable THEN {_between('yield_vs_history', '0.7::DOUBLE', '1.3::DOUBLE')} ELSE {_between('cash_yield', '2', '8')} END", 0.4)],
}
for _when in ("now", "then"):
    STEPS[f"sl_{_when}_parts"] = _lively.replace("FROM BASE", f"FROM sl_{_when}_base")
    _rounded = ", ".join(f"round({_weighted([(p[4], p[5]) for p in ps])}) AS p{k}" for k, ps in enumerate(_live_parts.values()))
    _weights_sql = _weighted([(f"p{k}", w / 100) for k, w in enumerate(_weights.values())])
    STEPS[f"sl_{_when}"] = f"""SELECT *, {_grade("overall_score")} AS grade, CASE WHEN overall_score >= 75 THEN 'Strong' WHEN overall_score >= 60 THEN 'Solid' WHEN overall_score >= 45 THEN 'Mixed' WHEN overall_score >= 30 THEN 'Weak' WHEN overall_score IS NOT NULL THEN 'Poor' END AS band FROM (
      SELECT *, CASE WHEN coverage_pct >= 40 THEN round({_weights_sql}) END AS overall_score FROM (SELECT *, ({" + ".join(f"CASE WHEN p{k} IS NOT NULL THEN {w} ELSE 0 END" for k, w in enumerate(_weights.values()))})::DOUBLE AS coverage_pct FROM (SELECT *, {_rounded} FROM sl_{_when}_parts)))"""
STEPS["sl_details"] = " UNION ALL ".join(f"SELECT symbol, '{t}' AS pillar, p{k} AS pillar_score, {m} AS metric, {v} AS value, {kind} AS kind, {of}::BIGINT AS of, round({x}) AS score, {w}::DOUBLE AS weight FROM sl_now" for k, (t, ps) in enumerate(_live_parts.items()) for m, v, kind, of, x, w in ps)
_figures = [("FFO (last FY)", "EPS (last FY)", "ffo_", "dilutedeps", "money"), ("FFO / share", "Free cash flow", "ffo_per_share", "freecashflow", "money"), ("P / FFO", "P / E (TTM)", "price_to_ffo", "trailing_pe", "multiple"), ("Cash flow payout", "FCF payout", "payout_pct", "payout_pct", "percent")]
STEPS["sl_figures"] = " UNION ALL ".join(f"SELECT symbol, CASE WHEN is_reit THEN '{a}' ELSE '{b}' END AS figure, CASE WHEN is_reit THEN {x} ELSE {y} END AS value, '{k}' AS kind FROM sl_now" for a, b, x, y, k in _figures)
_hide = ", ".join(f"CASE WHEN price IS NOT NULL THEN {c} END AS {c}" for c in ("overall_score", "grade", "band", "coverage_pct"))
STEPS["sl_timeline"] = f"""SELECT symbol, kind AS period_type, period, {_hide}, CASE WHEN is_reit THEN 'reit' ELSE 'standard' END AS scoring_basis, statement_periods, quarters_used, statement_periods < 3 OR coalesce(quarters_used < 4, false) AS thin_history, price, window_start, period_return,
  CASE WHEN price IS NULL THEN 'no price history at this date' WHEN overall_score IS NULL THEN 'not enough reported data to grade' END AS unscored, {", ".join(f"CASE WHEN price IS NOT NULL THEN p{k} END AS p{k}" for k in range(5))} FROM sl_then"""
STEPS["sl_pillars"] = " UNION ALL ".join(f"SELECT symbol, period_type, period, '{t}' AS pillar, p{k} AS pillar_score FROM sl_timeline WHERE price IS NOT NULL" for k, t in enumerate(_live_parts))


@lru_cache(maxsize=1024)
def _words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", text))


def sql(select: str) -> str:
    """A query over the steps that it needs, in order."""
    need, todo = set(), [select]
    while todo:
        for name in STEPS.keys() & _words(todo.pop()) - need:
            need.add(name)
            todo.append(STEPS[name])
    steps = [f"{n} AS ({s})" for n, s in STEPS.items() if n in need]
    return (f"WITH {', '.join(steps)} " if steps else "") + select

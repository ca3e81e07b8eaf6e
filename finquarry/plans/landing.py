"""Queries that write the engine's tables to a landing zone in the shared folder, in old and new file versions, and read
them back through staging, sinks, payload flatteners and the stream.

Each entry is like those of the registry: the DataFrame, its columns and the twin's FROM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquarry.operators import portfolio
from finquarry.sources import landing, payloads, staging
from finquarry.sources.store import merge_batch, read_merged, shared_path
from finquarry.streaming.ingest import PRICES, ingest_stream, read_prices

OLD, NEW, CUT = "2024-02-01T00:00:00Z", "2024-02-02T00:00:00Z", "2024-01-15"
_CENTS = "(SELECT *, round(close * 100)::BIGINT AS c, (trade_date >= DATE '2024-01-15')::INT AS late FROM bars)"


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def name(prefix: str = "U") -> Column:
    return F.concat(F.lit(prefix), "symbol")


def _none() -> Column:
    """What a source writes for no value: an empty object."""
    return F.create_map().cast("map<string,string>")


def price_zone(t) -> str:
    """Two runs of price files: old ones of few columns with padded symbols, and newer ones that restate the later bars,
    with wrapped numbers, empty objects and times for dates."""
    raw = shared_path(t.spark, "landing")
    old = t.bars.select(name(" u").alias("symbol"), F.col("trade_date").cast("string").alias("trade_date"), cents("close").alias("close"))
    landing.append_landing(old, raw, "price", "r1", OLD)
    late = t.bars.filter(F.col("trade_date") >= CUT)
    new = late.select(name().alias("symbol"), F.concat(F.col("trade_date").cast("string"), F.lit("T00:00:00Z")).alias("trade_date"), (cents("close") + 1).alias("close"), F.struct(cents("close").alias("raw")).alias("adj_close"), _none().alias("volume"))
    landing.append_landing(new, raw, "price", "r2", NEW)
    return raw


def _landed(t, entity: str, *runs: DataFrame) -> DataFrame:
    raw = shared_path(t.spark, "landing")
    for k, df in enumerate(runs):
        landing.append_landing(df, raw, entity, f"r{k}", (OLD, NEW)[k])
    return landing.read_landing_or_empty(t.spark, raw, entity)


def rows_by_entity(t) -> DataFrame:
    raw = price_zone(t)
    count = lambda e: landing.read_landing_or_empty(t.spark, raw, e).agg(F.lit(e).alias("entity"), F.count("*").alias("rows"))
    return count("price").unionByName(count("split"))


def dividends_back(t) -> DataFrame:
    d = t.dividends.select("symbol", F.col("pay_date").cast("string").alias("pay_date"), cents("amount").alias("amount"))
    old = d.withColumn("amount", F.col("amount").cast("string")).withColumn("symbol", name())
    return staging.stg_dividends(_landed(t, "dividend", old, d.filter("symbol % 2 = 0").withColumns({"amount": F.struct((F.col("amount") + 100).alias("raw")), "symbol": name(" u")})))


def financial_runs(t) -> DataFrame:
    from finquarry.operators.statements import melt_statements
    from finquarry.sources import adapters as A

    long = melt_statements(A.statements_wide(t.spark, t.sf_dir)).withColumns({"value": cents("value"), "period_end": F.col("period_end").cast("string"), "period_type": F.upper("period_type")})
    again = long.filter("metric = 'totalrevenue'").withColumn("value", F.when(F.col("symbol") % 3 != 0, F.col("value") * 2))
    return _landed(t, "financial", long.withColumn("symbol", name()), again.withColumns({"symbol": name(), "metric": F.upper("metric")}))


def securities_back(t) -> DataFrame:
    s = t.securities_full.withColumns({"dividend_yield": F.col("dividend_yield_pct") / 100, "return_on_equity": F.struct((F.col("return_on_equity_pct") / 100).alias("raw")), "five_year_avg_dividend_yield": F.col("five_year_avg_dividend_yield_pct"), "website": F.lit(" "), "employees": _none(), "currency": F.when(F.col("symbol") % 2 == 0, "EUR")})
    cols = ["name", "sector", "industry", "market_cap", "forward_pe", "beta", "dividend_yield", "return_on_equity", "five_year_avg_dividend_yield", "website", "employees", "currency"]
    new = s.filter("symbol % 3 = 0").select(name().alias("symbol"), *cols).withColumn("name", F.concat("name", F.lit(" Inc")))
    return staging.stg_securities(_landed(t, "security", s.select(name(" u").alias("symbol"), *[c for c in cols if c != "beta"]), new))


def splits_back(t) -> DataFrame:
    u = t.bars.select("symbol").distinct()
    s = u.select(name().alias("symbol"), F.lit("2024-01-15").alias("split_date"), (F.col("symbol") % 4).alias("numerator"), F.when(F.col("symbol") % 5 == 0, 0).otherwise(2).alias("denominator"))
    return staging.stg_splits(_landed(t, "split", s))


def membership_back(t) -> DataFrame:
    raw = shared_path(t.spark, "landing")
    on = lambda d: t.membership.filter(F.col("observed_on") == d).select(name().alias("symbol"), "index_name", F.lit("list").alias("source")).distinct()
    landing.append_membership(on("2024-01-10"), raw, "a", "2024-01-10T05:00:00Z")
    landing.append_membership(on("2024-01-11"), raw, "b", "2024-01-11T05:00:00Z")
    on("2024-01-09").select("symbol", F.lit("2024-01-09").alias("observed_at")).write.json(f"{raw}/membership__old.jsonl")
    return staging.stg_index_membership(landing.read_landing(t.spark, raw, "membership"))


def scores_back(t) -> DataFrame:
    """Two days of scores; the first is written twice, and the second time stays."""
    path = shared_path(t.spark, "scores")
    s = t.timeline().groupBy("symbol").agg(F.max_by("overall_score", "period").alias("overall_score")).select(name().alias("symbol"), "overall_score")
    landing.export_score_history(s, path, "2024-01-01")
    landing.export_score_history(s.withColumn("overall_score", F.col("overall_score") + 1), path, "2024-01-01")
    landing.export_score_history(s, path, "2024-01-02")
    return staging.stg_score_history(t.spark.read.schema(landing.SCHEMAS["score_history"]).json(path))


def charts_back(t) -> DataFrame:
    b = t.bars.withColumn("c", F.when(F.col("volume") % 7 != 0, F.col("close")))
    day = F.struct(F.unix_seconds(F.col("trade_date").cast("timestamp")).alias("t"), "open", "high", "low", "c", F.when(F.col("volume") % 2 == 0, F.col("adj_close") / 2).alias("a"), F.when(F.col("volume") % 3 != 0, F.col("volume")).alias("v"))
    g = b.groupBy("symbol").agg(F.sort_array(F.collect_list(day)).alias("d"))
    field = lambda new, old: F.transform("d", lambda x: x[old]).alias(new)
    text = F.to_json(F.struct(field("timestamp", "t"), field("open", "open"), field("high", "high"), field("low", "low"), field("close", "c"), field("adjclose", "a"), field("volume", "v")))
    return payloads.flatten_chart_payload(g.select("symbol", text.alias("payload")))


def _events(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(symbol, payload): events as a JSON map by their time."""
    e = F.struct(F.col("at").cast("string"), F.struct(F.col("at").alias("date"), *[c.alias(k) for k, c in fields.items()]))
    return df.groupBy("symbol").agg(F.to_json(F.map_from_entries(F.collect_list(e))).alias("payload"))


def dividend_events_back(t) -> DataFrame:
    d = t.dividends.withColumn("at", F.unix_seconds(F.col("pay_date").cast("timestamp")))
    return payloads.flatten_dividend_events(_events(d, {"amount": F.when(F.dayofmonth("pay_date") != 13, F.col("amount")).otherwise(0.0)}))


def split_events_back(t) -> DataFrame:
    u = t.bars.select("symbol").distinct().withColumn("at", F.when(F.col("symbol") % 6 == 0, 0).otherwise(1_705_276_800 + F.col("symbol") * 86_400))
    return payloads.flatten_split_events(_events(u, {"numerator": F.col("symbol") % 4 * 1.0, "denominator": F.lit(2.0)}))


def timeseries_back(t) -> DataFrame:
    names = {"totalrevenue": "TotalRevenue", "netincome": "NetIncome", "ebitda": "EBITDA", "ebit": "EBIT", "totaldebt": "TotalDebt"}
    w = t.wide().filter("not (symbol % 5 = 0 and month(period_end) = 6)")
    kind = F.initcap("period_type")
    long = None
    for col, title in names.items():
        value = F.when(F.col("symbol") % 5 != 1, F.col(col)) if col in ("totalrevenue", "netincome") else F.col(col)
        one = w.select("symbol", F.concat(F.lower(kind), F.lit(title)).alias("metric"), F.col("period_end").cast("string").alias("as_of"), value.alias("value"))
        long = one if long is None else long.unionByName(one)
    return payloads.flatten_timeseries_payload(long)


def constituents_back(t) -> DataFrame:
    """Lists as CSV, as a piped file with a trailer and flags, and as fund holdings, out of the companies."""
    path, k = shared_path(t.spark, "constituents"), F.col("symbol")
    s = t.securities.withColumns({"ticker": F.concat(F.lit("c"), k.cast("string"), F.when(k % 10 == 0, ".b").otherwise("")), "company": F.concat(F.lit('A "quoted", one '), k.cast("string"))})
    s.filter("symbol % 2 = 0").select(F.when(k % 8 == 0, "not one").otherwise(F.col("ticker")).alias("Symbol"), "company").write.option("header", True).csv(f"{path}/list.csv")
    piped = s.filter("symbol % 3 = 0").select(F.upper("ticker").alias("Symbol"), "company", F.when(k % 9 == 0, "Y").otherwise("N").alias("Test Issue"), F.when(k % 5 == 0, "Y").otherwise("N").alias("ETF"))
    trailer = t.spark.createDataFrame([("File Creation Time: 0101202400:00", None, None, None)], ", ".join(f"`{c}` string" for c in piped.columns))
    piped.unionByName(trailer).write.option("header", True).option("sep", "|").csv(f"{path}/list.txt")
    fund = s.filter("symbol % 7 = 0").groupBy((k % 5).alias("n")).agg(F.struct(F.collect_list(F.struct(F.concat(F.lit(" "), "ticker").alias("ticker"))).alias("entity")).alias("fund"))
    fund.write.partitionBy("n").json(f"{path}/funds")  # a file a fund
    read = {"sp500": payloads.load_constituents_csv(t.spark, f"{path}/list.csv"), "nasdaq": payloads.load_constituents_pipe(t.spark, f"{path}/list.txt"), "fund": payloads.load_holdings_json(t.spark, f"{path}/funds")}
    out = None
    for index, df in read.items():
        one = df.select("symbol", F.lit(index).alias("index_name"))
        out = one if out is None else out.unionByName(one)
    return out


def index_lists(t) -> DataFrame:
    """Symbols of companies, some in several indexes, some unknown to the bars, some blank."""
    k = F.col("symbol")
    each = F.explode(F.filter(F.array(F.when(k % 2 == 0, "sp500"), F.when(k % 3 == 0, "nasdaq"), F.lit("wide")), lambda x: x.isNotNull()))
    return t.securities.select(F.when(k % 40 == 11, " ").when(k % 40 == 12, None).otherwise(F.concat(F.lit(" u"), k.cast("string"))).alias("symbol"), each.alias("index_name"))


def judged(t) -> DataFrame:
    return payloads.judge_universe(index_lists(t), t.bars.select(name().alias("symbol")))


def plan(t) -> DataFrame:
    """Staleness of every symbol of the universe against what the last run left."""
    state = t.bars.groupBy(name().alias("symbol")).agg(F.max("trade_date").alias("last_date"), F.max("symbol").alias("n"))
    state = state.filter("n % 4 <> 0").withColumn("refreshed_at", F.when(F.col("n") % 7 != 0, F.timestamp_seconds(F.lit(1_706_659_200) - F.col("n") * 7200)))
    return landing.extract_plan(judged(t).filter("symbol is not null").select("symbol", "tier"), state.drop("n"), "2024-01-31 00:00:00")


def report(t) -> DataFrame:
    counts = t.bars.select(F.lit("price").alias("entity")).unionByName(t.dividends.select(F.lit("dividend").alias("entity")))
    failures = t.bars.filter("symbol % 9 = 4").select("symbol")
    return landing.extract_run_report(counts, failures, 30)


def wallets_back(t) -> DataFrame:
    k = F.col("symbol")
    bought = F.when(k % 11 == 0, "2999-01-01").when(k % 11 == 1, "2024-02-30").otherwise(F.col("bought_at").cast("string"))
    item = F.concat_ws(":", F.concat(F.lit("u"), k.cast("string")), F.when(k % 7 == 0, "-1").otherwise(F.col("shares").cast("string")), F.when(k % 13 == 0, "-5").otherwise(F.coalesce(F.col("cost").cast("string"), F.lit(""))), bought)
    g = t.holdings.groupBy(F.floor(k / 25).cast("long").alias("wallet_id")).agg(F.sort_array(F.collect_list(F.struct("symbol", item.alias("item")))).alias("h"))
    spec = F.concat(F.array_join(F.transform("h", lambda x: x["item"]), ","), F.lit(",bad symbol:1,"), F.get("h", F.lit(0))["item"], F.lit("9"))
    return portfolio.parse_wallet_strings(g.select("wallet_id", spec.alias("spec")), "2024-06-30")


def merged_store(t) -> DataFrame:
    """Bars merged in two batches of which the second comes twice, read back from the folders."""
    path = shared_path(t.spark, "prices")
    b = t.bars.withColumn("symbol", name())
    first = b.filter("trade_date <= '2024-01-25'").withColumn("ingested_at", F.lit(OLD).cast("timestamp"))
    again = b.filter("trade_date >= '2024-01-15'").withColumns({"close": F.col("close") + 1, "ingested_at": F.lit(NEW).cast("timestamp")})
    for k, df in ((0, first), (1, again), (1, again.withColumn("close", F.lit(-1.0)))):
        merge_batch(df, path, ["symbol", "trade_date"], ["ingested_at"], "trade_date", k)
    return read_merged(t.spark, path, first.schema, ["2024-01"]).select("symbol", "trade_date", "close")


def streamed(t) -> DataFrame:
    raw, path, marks = price_zone(t), shared_path(t.spark, "streamed"), shared_path(t.spark, "stream-marks")
    for _ in range(2):  # a second start finds nothing new
        ingest_stream(t.spark, raw, path, marks).awaitTermination()
    return read_prices(t.spark, path)


_STAGED = f"(SELECT 'U' || symbol AS symbol, trade_date, (c + late)::DOUBLE AS close, CASE WHEN late = 1 THEN c::DOUBLE END AS adj_close, NULL::BIGINT AS volume FROM {_CENTS} WHERE c + late > 0)"
_FIN = "(SELECT symbol, 'annual' AS period_type, period_end, metric, round(value * 100)::BIGINT AS v FROM (UNPIVOT (SELECT symbol, period_end, {m} FROM wide_annual) ON {m} INTO NAME metric VALUE value))"
_UNI = """(SELECT *, CASE WHEN symbol IS NULL THEN 'no-symbol' WHEN symbol NOT IN (SELECT 'U' || symbol FROM bars) THEN 'no-price-bar' END AS reason, CASE WHEN list_contains(indexes, 'sp500') THEN 'deep' ELSE 'wide' END AS tier FROM (SELECT CASE WHEN symbol % 40 NOT IN (11, 12) THEN 'U' || symbol END AS symbol, list_sort(list_distinct(list(i))) AS indexes
  FROM (SELECT symbol, unnest(list_filter([CASE WHEN symbol % 2 = 0 THEN 'sp500' END, CASE WHEN symbol % 3 = 0 THEN 'nasdaq' END, 'wide'], lambda x: x IS NOT NULL)) AS i FROM securities) GROUP BY 1))"""


def entries(metrics: list[str]) -> dict:
    fin = _FIN.format(m=", ".join(metrics))
    again = f"SELECT symbol, period_type, period_end, metric, CASE WHEN symbol % 3 <> 0 THEN v * 2 END AS v, TIMESTAMP '2024-02-02' AS ingested_at FROM {fin} WHERE metric = 'totalrevenue'"
    versions = f"(SELECT 'U' || symbol AS symbol, period_type, period_end, metric, v::DOUBLE AS value, ingested_at FROM (SELECT *, TIMESTAMP '2024-02-01' AS ingested_at FROM {fin} UNION ALL {again}))"
    series = "(SELECT * FROM wide WHERE NOT (symbol % 5 = 0 AND month(period_end) = 6) AND symbol % 5 <> 1)"
    return {
        "read_landing": (lambda t: landing.read_landing(t.spark, price_zone(t), "price"), "symbol trade_date close _run_id", f"(SELECT ' u' || symbol AS symbol, trade_date::VARCHAR AS trade_date, c::VARCHAR AS close, 'r1' AS _run_id FROM {_CENTS} UNION ALL SELECT 'U' || symbol, trade_date || 'T00:00:00Z', (c + 1)::VARCHAR, 'r2' FROM {_CENTS} WHERE late = 1)"),
        "read_landing_or_empty": (rows_by_entity, "entity rows", f"(SELECT 'price' AS entity, sum(1 + late)::BIGINT AS rows FROM {_CENTS} UNION ALL SELECT 'split', 0)"),
        "stg_prices": (lambda t: staging.stg_prices(landing.read_landing(t.spark, price_zone(t), "price")), "symbol trade_date close~ adj_close~ volume", _STAGED),
        "ingest_stream": (streamed, "symbol trade_date close~ adj_close~ volume", _STAGED),
        "stored_merge": (merged_store, "symbol trade_date close~", "(SELECT 'U' || symbol AS symbol, trade_date, CASE WHEN trade_date >= DATE '2024-01-15' THEN close + 1 ELSE close END AS close FROM bars WHERE trade_date < DATE '2024-02-01')"),
        "stg_dividends": (dividends_back, "symbol pay_date amount~", "(SELECT 'U' || symbol AS symbol, pay_date, (c + CASE WHEN symbol % 2 = 0 THEN 100 ELSE 0 END)::DOUBLE AS amount FROM (SELECT *, round(amount * 100)::BIGINT AS c FROM dividends) WHERE c > 0 OR symbol % 2 = 0)"),
        "stg_financials_versions": (lambda t: staging.stg_financials_versions(financial_runs(t)), "symbol period_type period_end metric value~", versions),
        "stg_financials": (lambda t: staging.stg_financials(financial_runs(t)), "symbol period_type period_end metric value~", f"(SELECT symbol, period_type, period_end, metric, arg_max(value, ingested_at) AS value FROM {versions} WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4)"),
        "stg_securities": (securities_back, "symbol name sector currency employees market_cap~ forward_pe~ beta~ dividend_yield_pct~ return_on_equity_pct~ five_year_avg_dividend_yield_pct~", "(SELECT 'U' || symbol AS symbol, name || CASE WHEN symbol % 3 = 0 THEN ' Inc' ELSE '' END AS name, sector, CASE WHEN symbol % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, NULL::BIGINT AS employees, market_cap, forward_pe, CASE WHEN symbol % 3 = 0 THEN beta END AS beta, dividend_yield_pct, return_on_equity_pct, five_year_avg_dividend_yield_pct FROM securities_full)"),
        "stg_splits": (splits_back, "symbol split_date ratio~", "(SELECT DISTINCT 'U' || symbol AS symbol, DATE '2024-01-15' AS split_date, (symbol % 4) / 2.0 AS ratio FROM bars WHERE symbol % 5 <> 0 AND symbol % 4 NOT IN (0, 2))"),
        "stg_index_membership": (membership_back, "symbol index_name observed_on", "(SELECT DISTINCT 'U' || user_id AS symbol, CASE WHEN ts::DATE = DATE '2024-01-09' THEN 'sp500' ELSE event_type END AS index_name, ts::DATE AS observed_on FROM events WHERE ts::DATE BETWEEN DATE '2024-01-09' AND DATE '2024-01-11')"),
        "export_score_history": (scores_back, "symbol score_date overall_score~", "(SELECT 'U' || symbol AS symbol, d AS score_date, s + CASE WHEN d = DATE '2024-01-01' THEN 1 ELSE 0 END AS overall_score FROM (SELECT symbol, arg_max(overall_score, score_date) AS s FROM score_stg GROUP BY 1), (VALUES (DATE '2024-01-01'), (DATE '2024-01-02')) AS x(d))"),
        "flatten_chart_payload": (charts_back, "symbol trade_date open~ high~ low~ close~ adj_close~ volume", "(SELECT symbol, trade_date, open, high, low, close, CASE WHEN volume % 2 = 0 THEN adj_close / 2 ELSE close END AS adj_close, CASE WHEN volume % 3 <> 0 THEN volume ELSE 0 END AS volume FROM bars WHERE volume % 7 <> 0)"),
        "flatten_dividend_events": (dividend_events_back, "symbol pay_date amount~", "(SELECT * FROM dividends WHERE day(pay_date) <> 13)"),
        "flatten_split_events": (split_events_back, "symbol split_date ratio~", "(SELECT DISTINCT symbol, DATE '2024-01-15' + symbol::INT AS split_date, (symbol % 4) / 2.0 AS ratio FROM bars WHERE symbol % 6 <> 0 AND symbol % 4 <> 0)"),
        "flatten_timeseries_payload": (timeseries_back, "symbol period_type period_end metric value~", f"(SELECT symbol, period_type, period_end, unnest(['totalRevenue', 'netIncome', 'ebitda', 'ebit', 'totalDebt']) AS metric, unnest([totalrevenue, netincome, ebitda, ebit, totaldebt]) AS value FROM {series})"),
        "load_constituents": (constituents_back, "symbol index_name", """(SELECT upper('c' || symbol) || CASE WHEN symbol % 10 = 0 THEN '-B' ELSE '' END AS symbol, 'sp500' AS index_name FROM securities WHERE symbol % 2 = 0 AND symbol % 8 <> 0 UNION ALL SELECT 'C' || symbol || CASE WHEN symbol % 10 = 0 THEN '-B' ELSE '' END, 'nasdaq' FROM securities WHERE symbol % 3 = 0 AND symbol % 9 <> 0 AND symbol % 5 <> 0
          UNION ALL SELECT 'C' || symbol || CASE WHEN symbol % 10 = 0 THEN '.B' ELSE '' END, 'fund' FROM securities WHERE symbol % 7 = 0)"""),
        "build_universe": (lambda t: payloads.build_universe(index_lists(t), t.bars.select(name().alias("symbol"))).withColumn("indexes", F.array_join("indexes", " ")), "symbol indexes tier", f"(SELECT symbol, array_to_string(indexes, ' ') AS indexes, tier FROM {_UNI} WHERE reason IS NULL)"),
        "dropped_symbols": (lambda t: judged(t).filter("reason is not null").withColumn("indexes", F.array_join("indexes", " ")), "symbol indexes tier reason", f"(SELECT symbol, array_to_string(indexes, ' ') AS indexes, tier, reason FROM {_UNI} WHERE reason IS NOT NULL)"),
        "extract_plan": (plan, "symbol tier from_date security_due financial_due cold_start", f"""(SELECT u.symbol, tier, coalesce(last_date - 7, CASE WHEN tier = 'deep' THEN DATE '2018-01-31' ELSE DATE '2022-01-31' END) AS from_date, age IS NULL OR age >= CASE WHEN tier = 'deep' THEN 24 ELSE 168 END AS security_due, age IS NULL OR age >= 168 AS financial_due, last_date IS NULL AS cold_start FROM {_UNI} u
          LEFT JOIN (SELECT 'U' || symbol AS symbol, max(trade_date) AS last_date, CASE WHEN symbol % 7 <> 0 THEN symbol * 2.0 END AS age FROM bars WHERE symbol % 4 <> 0 GROUP BY symbol) s ON s.symbol = u.symbol WHERE u.symbol IS NOT NULL)"""),
        "extract_run_report": (report, "entity rows failed run_fails", "(SELECT *, failed > 10 AS run_fails FROM (SELECT 'price' AS entity, count(*) AS rows FROM bars UNION ALL SELECT 'dividend', count(*) FROM dividends), (SELECT count(DISTINCT symbol) AS failed FROM bars WHERE symbol % 9 = 4))"),
        "parse_wallet_strings": (wallets_back, "wallet_id symbol shares~ cost~ bought_at", "(SELECT symbol // 25 AS wallet_id, 'U' || symbol AS symbol, shares, CASE WHEN symbol % 13 <> 0 THEN cost END AS cost, CASE WHEN symbol % 11 > 1 THEN bought_at END AS bought_at FROM holdings WHERE symbol % 7 <> 0)"),
    }

"""Point-in-time history: index membership spells and bitemporal knowledge of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FACT = ["symbol", "period_type", "period_end", "metric"]


def index_membership_scd2(obs: DataFrame) -> DataFrame:
    """Spells of membership over each index's observation days; a spell ends at the last day it was seen, unless that
    is the index's latest."""
    o = obs.select("symbol", "index_name", "observed_on").distinct()
    days = o.select("index_name", "observed_on").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("index_name").orderBy("observed_on")))
    last = days.groupBy("index_name").agg(F.max("observed_on").alias("universe_last_refreshed_on"))
    w = Window.partitionBy("symbol", "index_name").orderBy("seq")
    s = o.join(days, ["index_name", "observed_on"]).withColumn("island", F.col("seq") - F.row_number().over(w))
    s = s.groupBy("symbol", "index_name", "island").agg(F.min("observed_on").alias("valid_from"), F.max("observed_on").alias("seen"), F.count("*").alias("observations")).join(last, "index_name")
    now = F.col("seen") == F.col("universe_last_refreshed_on")
    return s.select("symbol", "index_name", "valid_from", F.when(~now, F.col("seen")).alias("valid_to"), now.alias("is_current"), "observations", "universe_last_refreshed_on")


def membership_as_of(spells: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return spells.filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))).select("symbol", "index_name")


def financial_knowledge(obs: DataFrame, mode: str = "reference") -> DataFrame:
    """Versions of each fact with the half-open time they were known. 'reference' dates each value by its first sight,
    so a value that returns is no new version; 'observations' follows every change."""
    o = obs.select(*_FACT, "value", "ingested_at")
    seen = o.groupBy(*_FACT, "value").agg(F.min("ingested_at").alias("at")) if mode == "reference" else o.groupBy(*_FACT, F.col("ingested_at").alias("at")).agg(F.max("value").alias("value"))
    w = Window.partitionBy(*_FACT).orderBy("at")
    v = seen.withColumns({"before": F.lag("value").over(w), "n": F.row_number().over(w)})
    v = v.withColumn("new", F.when((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("before")), 1).otherwise(0))
    v = v.withColumn("version_seq", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = v.groupBy(*_FACT, "version_seq").agg(F.max("value").alias("value"), F.min("at").alias("known_from"))
    o = Window.partitionBy(*_FACT).orderBy("version_seq")
    return g.withColumns({"known_to": F.lead("known_from").over(o), "total_versions": F.count("*").over(Window.partitionBy(*_FACT))})


def knowledge_as_of(knowledge: DataFrame, at: str) -> DataFrame:
    t = F.lit(at).cast("timestamp")
    return knowledge.filter((F.col("known_from") <= t) & (F.col("known_to").isNull() | (F.col("known_to") > t))).select(*_FACT, "value")


def restatements(knowledge: DataFrame) -> DataFrame:
    w = Window.partitionBy(*_FACT).orderBy("version_seq")
    k = knowledge.filter("total_versions > 1").withColumns({"restated_from": F.lag("value").over(w), "first_known_at": F.lag("known_from").over(w)}).filter("version_seq > 1")
    change = F.when(F.col("restated_from") != 0, (F.col("value") - F.col("restated_from")) / F.abs("restated_from") * 100)
    return k.select(*_FACT, "version_seq", "restated_from", F.col("value").alias("restated_to"), "first_known_at", F.col("known_from").alias("restated_at"), change.alias("change_pct"), F.datediff("known_from", "first_known_at").cast("long").alias("days_before_restated"))

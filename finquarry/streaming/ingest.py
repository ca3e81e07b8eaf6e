"""Continuous ingest: landing files of prices, merged into a table of months batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from finquarry.sources.landing import SCHEMAS
from finquarry.sources.staging import stg_prices
from finquarry.sources.store import merge_batch, read_merged

#: The columns of the price table.
PRICES = "symbol string, trade_date date, open double, high double, low double, close double, adj_close double, volume long, ingested_at timestamp"


def upsert_prices(new: DataFrame, path: str, batch: int | None = None) -> bool:
    """Merge bars into the months that they touch, later ingests winning; a batch is merged once, however often it comes."""
    return merge_batch(new, path, ["symbol", "trade_date"], ["ingested_at"], "trade_date", batch)


def read_prices(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    return read_merged(spark, path, PRICES, months)


def ingest_stream(spark: SparkSession, raw_dir: str, path: str, checkpoint: str) -> StreamingQuery:
    """All price files not yet seen, then stop. The batch's id is its commit, so one that Spark runs again after a failure
    is not merged twice. Ends equal to the batch result."""
    raw = spark.readStream.schema(SCHEMAS["price"]).json(f"{raw_dir}/price__*.jsonl*")
    return raw.writeStream.foreachBatch(lambda df, k: upsert_prices(stg_prices(df), path, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

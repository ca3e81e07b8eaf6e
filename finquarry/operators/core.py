"""Operators that the rest is built of: latest-wins, as-of joins, top-k, month ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh(columns: list[str], name: str) -> str:
    """name, or a longer one that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def latest_wins(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the greatest order per key, as one partial aggregate rather than a sort per key. Of rows with equal
    order that with the greatest other values stays (columns of maps apart), so reruns agree."""
    rest, row = [c for c in df.columns if c not in keys], fresh(df.columns, "_r")
    ties = [c for c in rest if c not in order_cols and "map<" not in df.schema[c].dataType.simpleString()]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_cols, *ties)).alias(row))
    return best.select(*[F.col(c) if c in keys else F.col(f"{row}.{c}").alias(c) for c in df.columns])


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names, so that plans over it stay small; df itself if
    there is no such folder."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    n = fresh(df.columns, "_n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) <= k).drop(n)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it.

    Both sides are laid in one order per key and values are carried forward, so no pair of rows is expanded.
    """
    names = left.columns
    t, side, v = (fresh(names, c) for c in ("_t", "_side", "_v"))
    a = left.select(*names, F.col(left_on).alias(t), F.lit(1).alias(side), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias(v))
    b = right.select(*[F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(right_on).alias(t), F.lit(0).alias(side), F.struct(*values).alias(v))
    w = Window.partitionBy(key).orderBy(t, side).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn(v, F.last(v, ignorenulls=True).over(w)).filter(F.col(side) == 1)
    return out.select(*names, *[F.col(f"{v}.{c}").alias(c) for c in values])


def interval_as_of(df: DataFrame, start: str, end: str, at: str, inclusive_end: bool) -> DataFrame:
    """Rows whose interval holds the date `at`; a null end is open."""
    day = F.to_timestamp(F.lit(at))
    upper = F.col(end).isNull() | ((F.col(end) >= day) if inclusive_end else (F.col(end) > day))
    return df.filter((F.col(start) <= day) & upper)


def month_end_history(bars: DataFrame, since: str | None = None) -> DataFrame:
    """Last bar of each month: (symbol, t, close, adj_close); adj falls back to close; closes above 0 only."""
    bars = bars.filter("close > 0")
    if since:
        bars = bars.filter(F.col("trade_date") >= F.lit(since).cast("date"))
    last = bars.groupBy("symbol", F.trunc("trade_date", "MM").alias("month")).agg(F.max_by(F.struct("trade_date", "close", "adj_close"), "trade_date").alias("r"))
    return last.select("symbol", F.col("r.trade_date").alias("t"), F.col("r.close").alias("close"), F.coalesce("r.adj_close", "r.close").alias("adj_close"))


def downsample(df: DataFrame, key: str, order: str, stride: int) -> DataFrame:
    n, place = F.row_number().over(Window.partitionBy(key).orderBy(order)), fresh(df.columns, "_n")
    return df.withColumn(place, n).filter(((F.col(place) - 1) % stride) == 0).drop(place)

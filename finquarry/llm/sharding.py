"""Shards by jump consistent hashing: keys stay where they are as shards are appended, and rows get gapless places."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquarry.llm.common import fresh, sized, stage

#: Fixed value: the multiplier of the generator that decides the jumps.
STEP = np.uint64(2862933555777941757)
#: Rows of a slice of a shard that one task numbers, about; copies of one row that are made in one go, at most.
SLICE, COPIES = 4096, 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: the last jump of its pseudo-random walk below `shards`.

    The walk does not depend on `shards`, so one more shard takes a key into itself or leaves it. Steps are about
    ln(shards) a key; no ring or table is kept.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    k, at, to = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = to[live]
        k[live] = k[live] * STEP + np.uint64(1)
        to[live] = ((at[live] + 1) * (2.0**31 / ((k[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[to[live] < shards]
    return at


def shard_of(id_col: str, shards: int) -> Column:
    """Shard of an id of any type that casts to text; null counts as the empty text. Null ids share a shard."""

    def batch(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return F.pandas_udf(batch, "int")(_hash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _hash64(text: Column) -> Column:
    """The first 64 bits of a text's MD5, as a signed long."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def shard_rows(rows: DataFrame, id_col: str = "doc_id", shards: int = 16, order_cols: list[str] | None = None) -> DataFrame:
    """All rows with three more columns: shard int (0 to shards - 1), slot long (the row's place in its shard, gapless
    from 0) and grown_shard int (its shard if there were one more). A name that rows has already gets underscores.

    Rows lie in their shard by a hash of id and order_cols (all other columns by default), ties by id and order_cols,
    nulls first; rows that agree in these may change places. Repeated rows, null ids included, each get a place.
    Columns of maps can't be compared, so they must be cast first. An empty table gives an empty one.

    Equal rows are added up inside tasks before any shuffle, and shards are numbered in slices of their hash range,
    as many as the rows ask for, so neither a hot row nor a shard is one task's work.
    """
    names = rows.columns
    tie = [id_col, *(order_cols if order_cols is not None else [c for c in names if c != id_col])]
    shard, slot, grown = (fresh(names, c) for c in ("shard", "slot", "grown_shard"))
    made = [*names, shard, slot, grown]
    n, h, part, before, piece = (fresh(made, c) for c in ("_n", "_h", "_part", "_before", "_piece"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie]
    alike = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(n))
    placed = alike.withColumns({h: F.conv(F.substring(F.md5(F.concat_ws(":", *text)), 1, 15), 16, 10).cast("long"), shard: shard_of(id_col, shards), grown: shard_of(id_col, shards + 1)})
    placed = stage(placed, "shards")

    kinds, most = placed.agg(F.count(F.lit(1)), F.max(n)).first()
    bits = min(20, math.ceil(math.log2(max(1.0, kinds / (shards * SLICE)))))
    placed = placed.withColumn(part, F.shiftright(F.col(h), 60 - bits))
    # Slices are at most shards * 2**20, and a 4096th of the rows; wider than the broadcast bound they are shuffled.
    slices = placed.groupBy(shard, part).agg(F.sum(n).alias(before))
    past = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn(before, F.coalesce(F.sum(before).over(past), F.lit(0)))
    inside = Window.partitionBy(shard, part).orderBy(h, *tie, *[c for c in names if c not in tie]).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn(slot, F.coalesce(F.sum(n).over(inside), F.lit(0))).join(sized(slices, 64, min(kinds, shards << bits)), [shard, part])
    out = out.withColumn(slot, F.col(slot) + F.col(before))
    if most and most > 1:  # give each of equal rows its place, blocks of them at a time, dealt anew if there are many
        out = out.withColumn(piece, F.explode(F.sequence(F.lit(0), F.expr(f"(`{n}` - 1) div {COPIES}"))))
        if most > COPIES:
            out = out.repartition(F.col(h), F.col(piece))
        out = out.withColumn(piece, F.explode(F.sequence(F.col(piece) * COPIES, F.least(F.col(piece) * COPIES + COPIES, F.col(n)) - 1)))
        out = out.withColumn(slot, F.col(slot) + F.col(piece))
    return out.select(*names, shard, slot, grown)


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """The rows as Parquet, a folder a shard; each task writes what it holds, so a shard is many files."""
    placed.write.partitionBy(shard).parquet(path)


def moved(placed: DataFrame, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """The rows that an appended shard takes; all others stay where they are."""
    return placed.filter(F.col(shard) != F.col(grown))


def shard_query(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract columns of all documents: size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 of null is 0."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard_rows(rows, "doc_id", shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

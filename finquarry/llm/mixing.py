"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a word target; a document of it is wanted target/source_size times. The whole part is taken as
it is. The fractions are rounded by the pivotal method: two documents trade probability so that the words they
are expected to bring stay the same, until one probability is 0 or 1. Documents meet in buckets of bounded size;
each bucket leaves at most one open fraction, and the leftovers meet again in a reduction tree. A source's words
thus miss its target by less than its last open document. Equal rows are one unit of many copies: what they are wanted
for together is whole but for one fraction of one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, fresh, salted, sized, stage

WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "unit string, source string, size long, mult long, copies long, share double, draw double, grp long, open boolean"
#: A unit of more rows than this is spread over tasks when its rows are written out.
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sums: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sums (source, source_size, …), one row a source, with `target`: shares by weight that stop at cap times a
    source's size, what is over being dealt again by weight.

    Sources go by code point, null last; weights repeat along them. Places in that order come from a range sort and the
    row counts of its partitions, and the level is found by sums over the table, so sources may be many.
    """
    at = F.monotonically_increasing_id()
    order = F.asc_nulls_last("source")
    placed = stage(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", at), "mix-order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offset = 0, F.lit(0).cast("long")
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):  # a row a partition
        offset, before = F.when(part == r.part, F.lit(before)).otherwise(offset), before + r["count"]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(row + offset, F.lit(len(weights))) + 1).cast("int"))
    weighed = stage(placed.withColumn("weight", weight).drop("at"), "mix-weights")
    most = F.lit(float(cap)) * F.col("source_size")
    total, level = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while total:  # the level only rises, and each time more sources are full
        full = F.lit(level) * F.col("weight") >= most
        r = weighed.agg(F.sum(F.when(full, most)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        new = (total - (r.taken or 0.0)) / r.free if r.free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    drop_staged(placed)
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), most)).drop("weight")


def pivotal(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round shares in (0, 1) so that sum(size * share) stays as it is; at most one stays open.

    Sizes are positive. draw: a uniform number for each row. Each row keeps its expectation.
    """
    p, at = share.astype(float).copy(), -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if at < 0:
            at = j
            continue
        a, b = float(size[at]), float(size[j])
        up, down = min(1 - p[at], p[j] * b / a), min(p[at], (1 - p[j]) * b / a)
        if draw[j] * (up + down) < down:
            closes = up == 1 - p[at]
            p[at], p[j] = (1.0, p[j] - up * a / b) if closes else (p[at] + up, 0.0)
        else:
            closes = down == p[at]
            p[at], p[j] = (0.0, p[j] + down * a / b) if closes else (p[at] - down, 1.0)
        if closes:
            p[j] = min(max(p[j], 0.0), 1.0)
            for k in (at, j):
                if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                    p[k] = round(p[k])
            at = j if 0 < p[j] < 1 else -1
        elif not 1e-12 < p[at] < 1 - 1e-12:
            p[at], at = round(p[at]), -1
    return p


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: round, then close what is settled."""
    pdf = pdf.sort_values(["draw", "unit"], kind="stable").reset_index(drop=True)
    p = pivotal(pdf["size"].to_numpy(), pdf["share"].to_numpy(), pdf["draw"].to_numpy())
    is_open = (p > 0) & (p < 1)
    pdf["copies"] = pdf["copies"] + np.where(is_open, 0, np.round(p)).astype("int64")
    return pdf.assign(share=np.where(is_open, p, 0.0), open=is_open)


def _unit_of(i: Column, source: Column, size: Column, text: Column) -> Column:
    """A key of rows that are alike: id, source, number of words and a hash of the text; nulls are values."""
    return F.concat_ws("|", F.coalesce(i.cast("long").cast("string"), F.lit("-")), size, F.xxhash64(text), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))


def _id_of(unit: Column) -> Column:
    """The id of a unit's rows, out of its key: as a column of its own, groups in pandas would turn it into a float
    beside a null one, and ids over 2**53 would change."""
    i = F.substring_index(unit, "|", 1)
    return F.when(i != "-", i.cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, bucket_rows: int = 4000, fan_in: int = 64) -> DataFrame:
    """How often each document is taken: (unit, doc_id, source, size, mult, copies, source_size, target).

    One row for each unit, that is (id, source, size, text); mult counts its rows and copies is the number of times
    that all of them together are taken, spread evenly: each copies div mult times, the first copies mod mult once
    more. Null or empty text: size 0, and copies by an own coin, as it brings no words. Null source: a source of its
    own, last in order. Null ids are ids like others. Empty table: no row. Reruns agree: all draws are hashes of
    unit and seed, and buckets come from hashes too. Nothing that grows with documents or sources reaches the driver.
    """
    size = word_count(F.col(text_col))
    unit = docs.select(F.col(source_col).alias("source"), size.alias("size"), _unit_of(F.col(id_col), F.col(source_col), size, F.col(text_col)).alias("unit"))
    units = stage(unit.groupBy("unit").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("mult")), "mix-units")
    sums = units.groupBy("source").agg(F.coalesce(F.sum(F.col("size") * F.col("mult")), F.lit(0)).alias("source_size"), F.count("*").alias("n"))
    want = F.coalesce(F.least(F.lit(float(cap)), F.try_divide("target", "source_size")), F.lit(0.0))
    plan = water_fill(sums, weights, cap).withColumns({"want": want, "buckets": F.ceil(F.col("n") / bucket_rows).cast("long")}).drop("n")
    plans = sized(plan, 128)

    asked = F.col("mult") * F.col("want")
    draw = (F.xxhash64("unit", F.lit(seed)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    dealt = units.alias("u").join(plans.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source"))).select(
        "unit", "u.source", "size", "mult", F.floor(asked).cast("long").alias("whole"), (asked - F.floor(asked)).alias("share"), draw.alias("draw"),
        F.pmod(F.xxhash64("unit", F.lit(seed + 1)), F.greatest("buckets", F.lit(1))).alias("grp"),
    )
    coin = F.when(F.col("draw") < F.col("share"), 1).otherwise(0)
    base = dealt.select("unit", "source", "size", "mult", (F.col("whole") + F.when(F.col("size") == 0, coin).otherwise(0)).alias("copies"), F.when(F.col("size") == 0, 0.0).otherwise(F.col("share")).alias("share"), "draw", "grp", F.lit(False).alias("open"))
    level = stage(base.groupBy("source", "grp").applyInPandas(_settle, _UNIT), "mix-level")
    done, most = [level.filter(~F.col("open"))], plan.agg(F.max("buckets")).first()[0] or 1
    while most > 1:
        most = -(-most // fan_in)
        level = stage(level.filter("open").withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long")).groupBy("source", "grp").applyInPandas(_settle, _UNIT), "mix-level")
        done.append(level.filter(~F.col("open")))
    last = level.filter("open").withColumn("copies", F.col("copies") + F.when(F.col("draw") < F.col("share"), 1).otherwise(0))
    out = last
    for x in done:
        out = out.unionByName(x)
    drop_staged(units)
    return out.alias("d").join(plans.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("unit", _id_of(F.col("unit")).alias("doc_id"), "d.source", "size", "mult", "copies", "source_size", "target")


def _times(number: Column) -> Column:
    """How often the row with this number in its unit is taken."""
    return F.floor(F.col("copies") / F.col("mult")) + F.when(number <= F.pmod("copies", "mult"), 1).otherwise(0)


def mix_query(docs: DataFrame) -> DataFrame:
    """One row per document: size, its source's size and target, and the words taken from it."""
    m = mix_sources(docs).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("mult") - 1) / CHUNK).cast("int"))))
    large = F.col("mult") > CHUNK
    m = m.filter(~large).unionByName(m.filter(large).repartition("unit", "chunk"))
    first = F.col("chunk").cast("long") * CHUNK
    rows = m.withColumn("number", F.explode(F.sequence(first + 1, F.least(first + CHUNK, F.col("mult")))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("number"))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document repeated as often as it is taken, with all its columns."""
    id_col, text_col, source_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    m = mix_sources(docs, **options)
    names = [F.col(f"`{c}`") for c in docs.columns]
    row, unit, k = (fresh(docs.columns, c) for c in ("_row", "_unit", "_k"))
    keyed = docs.select(F.struct(*names).alias(row), _unit_of(F.col(id_col), F.col(source_col), word_count(F.col(text_col)), F.col(text_col)).alias("unit"))
    pick = stage(m.select("unit", "mult", "copies"), "mix-picked")
    repeated = salted(keyed, pick.filter("mult > 1"), ["unit"], [row], 96, "left")  # rows of a large unit stay where they are
    alone = repeated.filter("mult is null").drop("mult", "copies").join(pick.filter("mult = 1 and copies > 0"), "unit").withColumn("number", F.lit(1).cast("long"))
    several = repeated.filter("mult > 1 and copies > 0")
    if not pick.filter("mult > 1 and copies > 0").isEmpty():
        several = _numbered(several)
    else:
        several = several.withColumn("number", F.lit(1).cast("long"))
    taken = alone.unionByName(several.select(alone.columns)).withColumn("times", _times(F.col("number")))
    return taken.filter("times > 0").withColumn(k, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(f"{row}.*")


def _numbered(rows: DataFrame, salts: int = 64) -> DataFrame:
    """rows with `number`, from 1 on in each unit. A unit is split by salts, whose counts say where each begins."""
    rows = stage(rows.withColumn("mid", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("mid"), F.lit(salts)).cast("int")), "mix-several")
    counts = rows.groupBy("unit", "salt").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("unit", "salt", start.alias("start"))
    inside = F.row_number().over(Window.partitionBy("unit", "salt").orderBy("mid"))
    return rows.withColumn("inside", inside).join(sized(starts, 96), ["unit", "salt"]).withColumn("number", F.col("start") + F.col("inside"))

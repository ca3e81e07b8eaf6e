"""What several operators share: scratch tables, size-checked joins, words, streamed groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows times a row's width stay under this.
BROADCAST_BYTES = 32 << 20


#: Arrow batches hold at most about this many bytes: two copies of one are in memory for each task, in the JVM and in Python.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches are bounded by bytes where the session sets no bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables made by stage() that nothing will read again."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows prove it small; as it is otherwise (Spark then shuffles)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df


def joined(df: DataFrame, small: DataFrame, on: list[str], size: int, how: str = "inner") -> DataFrame:
    """df joined with small, which takes about `size` bytes in memory: broadcast if these are few, else sorted and merged.
    Spark's own estimate never decides: it takes files as they are compressed, and an explode for one row a row."""
    return df.join(F.broadcast(small) if size <= BROADCAST_BYTES else small.hint("merge"), on, how)


def salted(df: DataFrame, small: DataFrame, on: list[str], by: list[str], row_bytes: int, how: str = "inner", salts: int = 16, rows: int | None = None) -> DataFrame:
    """df joined with small, which has one row a key: broadcast if counted small; else keys are split by a hash of the
    columns `by`, so that a key with very many rows of df is dealt to several tasks."""
    size = row_bytes * (small.count() if rows is None else rows)
    if size <= BROADCAST_BYTES:
        return joined(df, small, on, size, how)
    salt = fresh(df.columns + small.columns, "_salt")
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return joined(dealt, small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, salt], salts * size, how).drop(salt)


def fresh(columns: list[str], name: str) -> str:
    """name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of key. A threshold on the hash, at twice the share asked
    for, comes first, so that tasks together send about 2 * most rows, not `most` each."""
    n = df.count()
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    near = df if n <= 2 * most else df.filter(h < int(2 * most / n * (1 << 40)))
    return near.orderBy(h, key).limit(most)


def crc_mod(col: str, n: int):
    """crc32 of an integer column as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def utf8(column) -> list[bytes]:
    """Values of an Arrow string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes: bytes.split() parts on exactly these six characters."""
    return text.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (shift, multiply, three times)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows that follow each other with equal keys, over batch borders. Keys hold no nulls."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        cols = [pdf[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if len(pdf) > 1 else np.array([], int)
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield _group(held, keys)
            held = []
        at = 0
        for c in cut:
            held.append(pdf.iloc[at:c])
            yield _group(held, keys)
            held, at = [], c
        held.append(pdf.iloc[at:])
    if held:
        yield _group(held, keys)


def _group(parts: list[pd.DataFrame], keys: list[str]) -> tuple[tuple, pd.DataFrame]:
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
    pdf = pdf.reset_index(drop=True)
    return tuple(pdf[k].iloc[0] for k in keys), pdf

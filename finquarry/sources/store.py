"""Tables in a shared folder: scratch paths, and a price table that batches merge into, each at most once.

A batch writes one folder, batch=<id>/month=<yyyy-MM>, in one job; Spark's _SUCCESS file in it is the commit. A month is
read from the last committed batch that has it, so readers never see half a batch, a batch that failed is written
anew, and a batch that comes again changes nothing. One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finquarry.operators.core import latest_wins


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a folder of our own only where none is set and Spark
    runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_files(spark: SparkSession, glob: str) -> bool:
    fs, p = _fs(spark, glob)
    return bool(fs.globStatus(p))


def _names(spark: SparkSession, glob: str) -> list[str]:
    fs, p = _fs(spark, glob)
    return [s.getPath().getName() for s in fs.globStatus(p) or []]


def committed(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches whose job ended, in order."""
    fs, p = _fs(spark, f"{path}/batch=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().removeprefix("batch=")) for s in fs.globStatus(p) or [])


def folders(spark: SparkSession, path: str, months: list[str] | None = None) -> dict[str, str]:
    """The folder that each month (of those asked for) is read from."""
    out = {}
    for batch in committed(spark, path):
        for name in _names(spark, f"{path}/batch={batch}/month=*"):
            out[name.removeprefix("month=")] = f"{path}/batch={batch}/{name}"
    return out if months is None else {m: f for m, f in out.items() if m in months}


def read_merged(spark: SparkSession, path: str, schema: StructType | str, months: list[str] | None = None) -> DataFrame:
    """The table's rows, or those of some months, as they stand; other months' files are not opened."""
    found = list(folders(spark, path, months).values())
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def merge_batch(new: DataFrame, path: str, keys: list[str], order: list[str], day: str, batch: int | None = None) -> bool:
    """Merge rows into the months of `day` that they touch; of rows with equal keys that with the greatest order stays.

    Returns whether the batch was written: one that is committed already is not, nor is one without rows. Without an id
    the next one is taken. Rows without a day are left out.
    """
    spark = new.sparkSession
    done = committed(spark, path)
    batch = (done[-1] + 1 if done else 0) if batch is None else batch
    if batch in done:
        return False
    new = new.filter(F.col(day).isNotNull())
    month = F.date_format(day, "yyyy-MM")
    months = [r[0] for r in new.select(month).distinct().collect()]  # months, not rows
    if not months:
        return False
    stored = read_merged(spark, path, new.schema, months)
    merged = latest_wins(stored.unionByName(new), keys, order)
    merged.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch={batch}")
    return True


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete committed months that a later batch replaced; returns how many. No reader of older states may be left."""
    now, gone = set(folders(spark, path).values()), 0
    for batch in committed(spark, path):
        for name in _names(spark, f"{path}/batch={batch}/month=*"):
            if (old := f"{path}/batch={batch}/{name}") not in now:
                fs, p = _fs(spark, old)
                gone += fs.delete(p, True)
    return gone

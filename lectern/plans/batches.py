"""Stored rows that grow by batches: path/<what>/batch=<n> beside path/written/batch=<n>, the keys that a batch has written or taken out.

A row counts if no later batch has written its key. A batch counts once its keys are written to the end; writing one again replaces it and touches no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the keys written since batch 0 up to which readers are sent them all; beyond, they are matched by a shuffle.
SEND_BYTES = 64 << 20


def done(spark: SparkSession, path: str) -> list[int]:
    """The batches that count, in order. A listing of one folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/written")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(x.getPath().getName().removeprefix("batch=")) for x in fs.listStatus(top) if whole(x.getPath()))


def read(spark: SparkSession, path: str, what: str, batches: list[int], columns: str | None = None) -> DataFrame:
    """What some batches hold. Folders of parts may be without any file, so their columns, partitions too, are to be named."""
    reader = spark.read.option("basePath", f"{path}/{what}")
    return (reader.schema(columns) if columns else reader).parquet(*(f"{path}/{what}/batch={n}" for n in batches))


def finish(keys: DataFrame, path: str, batch: int) -> None:
    """Makes a batch count: the last step of writing it."""
    keys.distinct().write.mode("overwrite").parquet(f"{path}/written/batch={batch}")


def current(spark: SparkSession, path: str, what: str, key: str, columns: str, only=lambda rows: rows) -> DataFrame:
    """The rows of what that count, with key, columns and batch; only chooses among them first, so that its filters reach the files."""
    batches = done(spark, path)
    kind = read(spark, path, "written", batches[:1]).schema[key].dataType.simpleString()
    found = only(read(spark, path, what, batches, f"{key} {kind}, {columns}, batch int"))
    if len(batches) < 2:
        return found
    later = read(spark, path, "written", batches[1:])
    changed = later.groupBy(key).agg(F.max("batch").alias("_last"))
    if int(later._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SEND_BYTES:
        changed = F.broadcast(changed)
    return found.join(changed, key, "left").filter("_last IS NULL OR batch >= _last").drop("_last")

"""What the operators of this subpackage share: worker set-up, checkpoints, table access and byte-level text rules."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in one Arrow batch: whole texts may be long, so batches are kept short.
BATCH_ROWS = 1000

#: The white space that ends a word or is stripped from a line: space and U+0009 to U+000D.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps Arrow batches short enough for long texts."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees that the session has a checkpoint folder.

    The folder is the session's spark.checkpoint.dir. A local session that names none gets a temporary one; on a cluster that would be a folder of one
    machine, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so that lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared checkpoint folder, and what removes it once it has been used."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared checkpoint folder, bucketed by a column, so that what is grouped by that column later meets it without another exchange of df."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    name = f"lectern_{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


#: Rows of one key that a join leaves to one task; keys with more are sent to every task. There are at most HOT_KEYS of these, whatever the data.
HOT_ROWS, HOT_KEYS = 200_000, 10_000


def skew_join(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right by key, where right has each key once, with n, the number of its rows in left, and left has so many rows in all.

    Keys with more rows than hot_rows, and than their share of HOT_KEYS keys, are broadcast with what right has for them, so that their rows stay where they are.
    """
    if rows <= hot_rows:
        return left.join(right.drop(n), key)
    much = F.col(n) > max(hot_rows, rows // HOT_KEYS)
    hot, cold = right.filter(much).drop(n), right.filter(~much).drop(n)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small table in one file would else be one task. Larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


#: Bytes of the texts in a sample of labelled rows: what the one task that learns holds.
SAMPLE_BYTES = 256 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable, sample: int, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label): the sample labelled rows with the smallest hash of their id, as far as their texts are at most sample_bytes together, one row at least.

    The ids are chosen first, among those that docs has, so that texts of no other rows travel.
    """
    ids = labels.filter(F.col(label).isin(0, 1) & usable(F.col("doc_id"))).selectExpr("cast(doc_id as long) doc_id", f"cast({label} as int) label")
    few = ids.join(docs.selectExpr("cast(doc_id as long) doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("label"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(few), "doc_id").orderBy(*order).limit(sample)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over the sample alone
    rows = rows.withColumn("upto", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(upto)).withColumn("nth", F.count(F.lit(1)).over(upto))
    return rows.filter((F.col("upto") <= sample_bytes) | (F.col("nth") == 1)).select("doc_id", "text", "label")


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, with A-Z in lower case; bytes.split() and lower() know ASCII alone."""
    return text.encode().lower().split() if text else []


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a plain DDL string; nothing here nests."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def planes(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    if not len(a):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def numbers(data: bytes, dtype) -> np.ndarray:
    """The numbers that planes has packed."""
    size = np.dtype(dtype).itemsize
    if not data:
        return np.empty(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def steps(ascending: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers, packed as their differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def climbed(data: bytes) -> np.ndarray:
    """The numbers that steps has packed."""
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


def give_back() -> None:
    """Returns freed memory of a worker to the system, which else stays with it from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

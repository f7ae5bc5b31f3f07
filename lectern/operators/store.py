"""Tables that keep what is written: rows in parts by hash, upserts and deletions that rewrite the parts they touch and no other, each batch once.

A row's part is a hash of one of its columns (for pages that of the document, whose pages change together), which never changes for a key. A write reads the parts of its
rows, merges, and replaces these folders. It is repeated without harm: until a batch is marked as applied, merging it again gives the same rows, and afterwards it is passed over.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_index import TextIndex

#: Parts of a table.
PARTS = 64


class Table(NamedTuple):
    """A table in a folder that all executors share."""

    path: str
    key: str
    by: str
    parts: int = PARTS

    def _part(self):
        return F.pmod(F.xxhash64(self.by), F.lit(self.parts)).cast("int")

    def _put(self, df: DataFrame, mode: str) -> None:
        # the parts of a write may be few or uneven: files follow their size
        out = df.withColumn("_part", self._part()).hint("rebalance", "_part").sortWithinPartitions("_part", self.key)
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{self.path}/rows")

    def create(self, df: DataFrame) -> None:
        df.limit(0).write.parquet(f"{self.path}/schema")  # rows may all go, their columns stay
        self._put(df, "append")

    def read(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        columns = spark.read.parquet(f"{self.path}/schema").schema
        rows = spark.read.schema(columns.add("_part", "integer")).parquet(f"{self.path}/rows")
        return (rows if parts is None else rows.filter(F.col("_part").isin(parts))).drop("_part")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Parts of the rows of a write; `parts` numbers at most."""
        return [r[0] for r in keys.select(self._part()).distinct().collect()]

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The stored rows of keys (key and `by` columns), from their parts alone."""
        return self.read(keys.sparkSession, self._touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _once(self, spark: SparkSession, batch: int | None, write: Callable[[], None]) -> bool:
        """Whether this call applied the batch; a batch None is always applied."""
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{batch}")
        fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if batch is not None and fs.exists(done):
            return False
        write()
        if batch is not None:
            fs.create(done, True).close()
        return True

    def upsert(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Rows of known keys take the place of what is stored, nulls too, columns that rows lack stay; rows of other keys are added. Of several rows of a key the greatest counts."""
        spark = rows.sparkSession

        def write() -> None:
            values = [c for c in rows.columns if c not in (self.key, self.by)]
            one = rows.groupBy(self.key, self.by).agg(F.max(F.struct(*(values or [F.lit(1)]))).alias("_new"))
            old = self.read(spark, self._touched(rows))
            kinds = dict(old.dtypes)
            value = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in (self.key, self.by) else F.when(F.col("n._new").isNotNull(), F.col(f"n._new.{c}").cast(kinds[c])).otherwise(F.col(f"o.{c}")) if c in values else F.col(f"o.{c}")
            merged = old.alias("o").join(one.alias("n"), F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full_outer")
            self._put(merged.select(*(value(c).alias(c) for c in old.columns)), "overwrite")

        return self._once(spark, batch, write)

    def delete(self, keys: DataFrame, batch: int | None = None) -> bool:
        """Takes out the rows of keys (key and `by` columns)."""
        spark = keys.sparkSession

        def write() -> None:
            parts = self._touched(keys)
            left = self.read(spark, parts).join(keys.select(self.key).distinct(), self.key, "left_anti")
            emptied = set(parts) - set(self._touched(left))
            self._put(left, "overwrite")
            for p in sorted(emptied):  # no row that is left would replace such a folder; `parts` of them at most
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/_part={p}")
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

        return self._once(spark, batch, write)


def write_pages(table: Table, index: TextIndex, rows: DataFrame, documents: DataFrame, batch: int) -> None:
    """What a write of pages leaves: the rows themselves, and the postings of their texts as they then are. The index follows the table, so a write that breaks off is mended by its repetition."""
    table.upsert(rows, batch)
    index.write(table.rows_of(rows), documents, batch)


def delete_pages(table: Table, index: TextIndex, keys: DataFrame, documents: DataFrame, batch: int) -> None:
    """Takes pages (page_id, document_id) out of both."""
    table.delete(keys, batch)
    index.write(table.rows_of(keys), documents, batch, removed=keys)


def follow(stream: DataFrame, table: Table, index: TextIndex, documents: DataFrame, checkpoint: str, first: int = 1):
    """A started streaming query that writes each micro-batch of pages to both, under its own number from `first` on."""

    def write(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            write_pages(table, index, rows, documents, first + number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""File listings, image lists and page images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.arrow import BYTES, short_batches


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, is_dir, mtime) of the entries of a directory, through the Hadoop file system, so on any store; a missing one is empty."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [(s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000.0) for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame(rows, "name string, is_dir boolean, mtime double").withColumn("mtime", F.col("mtime").cast("timestamp"))


def as_tables(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """A listing of root in which a stored table is one entry and no directory, whether it is one file or a folder of files: a folder x.parquet that holds visible entries, all of
    them Parquet files or partitions (column=value). Other folders with that name stay directories."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def holds_table(name: str) -> bool:
        inside = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root, name))]
        seen = [("=" in n if folder else n.endswith(".parquet")) for n, folder in inside if not n.startswith(("_", "."))]
        return bool(seen) and all(seen)

    names = [r.name for r in listed.filter(F.col("is_dir") & F.col("name").endswith(".parquet")).select("name").toLocalIterator()]
    tables = [n for n in names if holds_table(n)]
    return listed.withColumn("is_dir", F.col("is_dir") & ~F.col("name").isin(tables)) if tables else listed


def older_than(listed: DataFrame, hours: int, now: Column) -> DataFrame:
    """The directories (name, is_dir, mtime) of a listing that were last changed more than so many hours before now; without a time none is."""
    return listed.filter(F.col("is_dir") & (F.col("mtime") < now - F.expr(f"INTERVAL {hours} HOURS")))


def sweep(spark: SparkSession, root: str, orphans: DataFrame, dry_run: bool = False) -> int:
    """Deletes the named directories below root and returns how many there were; a dry run only counts."""
    if dry_run:
        return orphans.count()
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(bool(fs.delete(jvm.org.apache.hadoop.fs.Path(root, r.name), True)) for r in orphans.select("name").toLocalIterator())


def binary_files(spark: SparkSession, path: str, pattern: str = "*", encoded: bool = False) -> DataFrame:
    """path, modificationTime, length, content of files, and content in base64 if that is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("base64", F.base64("content")) if encoded else files


def image_number(path: Column) -> Column:
    """The number of a page image page-NNN.png; null for other files."""
    digits = F.regexp_extract(path, r"page-0*(\d+)\.png$", 1)
    return F.when(digits != "", digits.cast("int"))


def images(files: DataFrame) -> DataFrame:
    """Page images in the order of their numbers."""
    return files.withColumn("page_number", image_number(F.col("path"))).filter("page_number IS NOT NULL").orderBy("page_number")


def page_count(info: Column) -> Column:
    """The number of pages that a document tool reports; null if it reports none."""
    digits = F.regexp_extract(info, r"Pages:\s*(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def _frames(rows: Iterator[tuple], columns: list[str], most: int = BYTES) -> Iterator[pd.DataFrame]:
    """Rows with content as frames that are yielded as soon as their contents reach most bytes, so that a worker holds about so much, however many rows a file gives."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[columns.index("content")] or b"")
        if size >= most:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def extracted(files: DataFrame, extract: Callable[[bytes], Iterator[bytes]], page: int | None = None) -> DataFrame:
    """(path, page_number, content): the pages that an injected tool makes of each file, or the one page asked for."""
    short_batches(files.sparkSession)

    def run(batches):
        rows = ((p, k, img) for batch in batches for p, content in zip(batch["path"], batch["content"], strict=True) for k, img in enumerate(extract(bytes(content)), 1) if page is None or k == page)
        yield from _frames(rows, ["path", "page_number", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, content binary")


def converted(files: DataFrame, convert: Callable[[bytes], bytes]) -> DataFrame:
    """(path, content, error): files as an injected converter leaves them; its failures become error."""
    short_batches(files.sparkSession)

    def one(p, content):
        try:
            return p, convert(bytes(content)), None
        except Exception as e:  # noqa: BLE001  the tool is foreign code
            return p, None, f"{type(e).__name__}: {e}"

    def run(batches):
        rows = (one(p, content) for batch in batches for p, content in zip(batch["path"], batch["content"], strict=True))
        yield from _frames(rows, ["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")


def source_file(files: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, path): original.pdf if a document has it, else its original with another ending."""
    name = F.element_at(F.split("path", "/"), -1)
    ranked = files.filter(name.rlike(r"^original(\.[^.]+)?$")).withColumn("_r", F.struct((name != "original.pdf").alias("other"), "path"))
    return ranked.groupBy(document).agg(F.min("_r").alias("_r")).select(document, F.col("_r.path").alias("path"))

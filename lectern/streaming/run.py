"""Runs a stream over all that its source has and returns what it wrote: streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.keep import shared_folder


def table_stream(spark: SparkSession, path: str, files_each: int = 8) -> DataFrame:
    """A Parquet table as a stream of its files; a table that is one file is taken out of its folder by name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_each)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return stream.parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What the stream writes once its source is read to the end; append mode, exactly once by its own checkpoint."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")

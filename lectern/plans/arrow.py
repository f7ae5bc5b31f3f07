"""Arrow batches that stay small, whatever the texts and however many rows a task has."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch at most, about. What a batch becomes in Python, as lists of tokens, is many times its bytes, and a worker holds several batches.
ROWS, BYTES = 1000, 4 << 20


def short_batches(spark: SparkSession | None = None) -> None:
    """Sets the batches of a session, else of the active one, for the Python that its next plans run."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))

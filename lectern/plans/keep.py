"""Tables that several branches of a plan share, written once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for such tables: its checkpoint directory, else spark.checkpoint.dir. A local session may do without; on a cluster a folder of one machine would not do."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isEmpty():
        return at.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-kept-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: branches that read it agree, foreign calls in it are not repeated, and lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

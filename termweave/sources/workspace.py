"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None

#: Options of the Parquet writer for an index.
PACKED = {"compression": "zstd"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where none is set and the master is this machine alone."""
    global _own
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="termweave-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that Hadoop deletes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet and read again: computed once, with its lineage cut."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most this many rows, for columns with long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

"""Working tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder, removed when the application ends; a local one only in local mode without the setting, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-working")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/corpusmill/{spark.sparkContext.applicationId}/working-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: computed once, and not again when an executor is lost."""
    path = folder(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

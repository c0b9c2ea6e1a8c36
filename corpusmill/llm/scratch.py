"""Working files in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in local mode without the setting, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-scratch")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new shared folder, removed when the application ends."""
    path = f"{root(spark)}/corpusmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm)
    fs.deleteOnExit(jvm)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there and survives lost executors."""
    path = folder(df.sparkSession, name) + "/table"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


_stored: dict[int, str] = {}


def release(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    if path := _stored.get(id(df)):
        jvm = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        jvm.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with columns named c0, c1, ..., which clash with no working column, and the new names of some."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(x)}" for x in names]


def files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The data files directly in a folder, by name."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm):
        return []
    found = [x.getPath() for x in fs.listStatus(jvm)]
    return sorted(x.toString() for x in found if x.getName()[0] not in "._" and x.getName().endswith(suffix))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; for use in tasks and on the driver."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written_whole(uri: str) -> Iterator:
    """An output stream whose file appears under its name only when all is written; a repeated task replaces it."""
    fs, path = open_fs(uri)
    part = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(part, compression=None) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        with contextlib.suppress(Exception):
            fs.delete_file(part)
        raise

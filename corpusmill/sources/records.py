"""JSON in the shapes that prediction and training files come in, and resumable output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_objects(text: str) -> Iterator[dict]:
    """Objects of a JSON array, of JSON lines, or of concatenated JSON."""
    text = text.strip()
    if text.startswith("["):
        yield from json.loads(text)
        return
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        value, at = decoder.raw_decode(text, at)
        yield value
        while at < len(text) and text[at].isspace():
            at += 1


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, record): the objects of every file as JSON text, whatever the file's shape."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["path"], frame["value"]):
                try:
                    found = [json.dumps(x, ensure_ascii=False) for x in json_objects(text)]
                except json.JSONDecodeError as e:
                    raise ValueError(f"{name}, line {e.lineno}: {e.msg}") from None
                if found:
                    yield pd.DataFrame({"path": [name] * len(found), "row_no": range(1, len(found) + 1), "record": found})

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, "path string, row_no long, record string")


def dictionary_words(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased keys of a JSON object."""
    keys = F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("k")
    return spark.read.text(path, wholetext=True).select(keys).select(F.lower(F.trim("k")).alias("word")).where("word <> ''").distinct()


def run_remaining(todo: DataFrame, key: str, path: str, work) -> DataFrame:
    """Applies work to the rows whose key isn't in the output yet, appends, and returns the whole output: a stopped job goes on where it ended."""
    spark = todo.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        todo = todo.join(spark.read.parquet(path).select(key), key, "left_anti")
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)

"""Files of parallel corpora, vocabularies and results as tables, and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import xlsx
from .records import read_records

CELLS = "path string, row_no long, cells map<int,string>"
#: Headers that name a test sheet's serial number.
SERIAL = ["id", "s.no", "no"]


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells) of a workbook or of a folder's workbooks in the order of names, without lock files."""
    spark.dataSource.register(xlsx.XlsxRows)
    return spark.read.format("xlsx_rows").load(path)


def english_side(rows: DataFrame, header: str = "any", most: int = 30) -> DataFrame:
    """(path, has_header, side) of every sheet: which of columns 0 and 1 is English.

    header says what the first row must be to count as a header: "any" has
    'english' in a name, "short" in a name of less than 40 characters, "exact" is
    the word itself.  "always" takes the first row as a header in any case, with
    'english' in just one name, else 'source', else column 0.  Without a header the
    column with the greater share of ASCII characters in its first most texts is
    English, column 0 on a tie.
    """
    cell = lambda i: F.col("cells")[i]
    order = Window.partitionBy("path").orderBy("row_no")
    seen = rows.select("path", "row_no", *[cell(i).alias(f"t{i}") for i in (0, 1)], *[F.count(cell(i)).over(order).alias(f"k{i}") for i in (0, 1)])
    first = lambda i: F.max(F.when(F.col("row_no") == 1, F.lower(T.trim_space(F.col(f"t{i}"))))).alias(f"h{i}")
    near = lambda i: F.when(F.col(f"k{i}") <= most, F.col(f"t{i}"))
    sums = [F.sum(f(near(i))).alias(f"{n}{i}") for i in (0, 1) for n, f in (("a", T.ascii_chars), ("n", F.length))]
    one = seen.groupBy("path").agg(first(0), first(1), *sums)
    name = lambda i: F.coalesce(F.col(f"h{i}"), F.lit(""))
    says = lambda i, word: F.contains(name(i), F.lit(word))
    if header == "always":
        only = says(0, "english") != says(1, "english")
        side = F.when(only & says(0, "english"), 0).when(only, 1).when(says(0, "source"), 0).when(says(1, "source"), 1).otherwise(0)
        return one.select("path", F.lit(True).alias("has_header"), side.alias("side"))
    named = {"any": lambda i: says(i, "english"), "short": lambda i: says(i, "english") & (F.length(name(i)) < 40), "exact": lambda i: name(i) == "english"}[header]
    share = lambda i: F.when(F.col(f"n{i}") > 0, F.col(f"a{i}") / F.col(f"n{i}")).otherwise(0.0)
    side = F.when(named(0), 0).when(named(1), 1).when(share(0) >= share(1), 0).otherwise(1)
    return one.select("path", (named(0) | named(1)).alias("has_header"), side.alias("side"))


def sheet_pairs(rows: DataFrame, header: str = "any") -> DataFrame:
    """(path, row_no, english, target) of rows that have both, stripped."""
    met = rows.join(english_side(rows, header), "path").where(~F.col("has_header") | (F.col("row_no") > 1))
    text = lambda side: T.trim_space(F.element_at("cells", side))
    out = met.select("path", "row_no", text(F.col("side")).alias("english"), text(1 - F.col("side")).alias("target"))
    return out.where("english <> '' AND target <> ''")


def test_rows(rows: DataFrame) -> DataFrame:
    """(path, id, english) of a test sheet: the last column named english or sentence (else column 1) and the serial number's column (else 0). A row without a number gets the count of rows kept so far."""
    names = F.transform_values("cells", lambda _, v: F.lower(T.trim_space(v)))
    last = lambda f: F.array_max(F.map_keys(F.map_filter(names, f)))
    is_text = lambda _, v: F.contains(v, F.lit("english")) | F.contains(v, F.lit("sentence"))
    is_id = lambda _, v: F.contains(v, F.lit("s no")) | F.contains(v, F.lit("sno")) | v.isin(SERIAL)
    heads = rows.where("row_no = 1").select("path", F.coalesce(last(is_text), F.lit(1)).alias("_t"), F.coalesce(last(is_id), F.lit(0)).alias("_i"))
    kept = rows.where("row_no > 1").join(heads, "path").select("path", "row_no", F.element_at("cells", F.col("_i")).alias("_no"), T.trim_space(F.element_at("cells", F.col("_t"))).alias("english")).where("english <> ''")
    count = F.row_number().over(Window.partitionBy("path").orderBy("row_no"))
    return kept.select("path", F.coalesce(F.col("_no").try_cast("double").try_cast("bigint"), count.cast("bigint")).alias("id"), "english")


def column_role(name: Column, place: Column, n_columns: Column, languages: list[str]) -> Column:
    """source or target, guessed from a column's name, by place if there are two columns; else null."""
    low = F.lower(name)
    target = F.lit(False)
    for x in languages:
        target = target | F.contains(low, F.lit(x.lower()))
    return F.when(target, "target").when(F.contains(low, F.lit("en")) | F.contains(low, F.lit("source")), "source").when(n_columns == 2, F.when(place == 0, "source").otherwise("target"))


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of every sheet."""
    return rows.where(F.col("row_no") <= n)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def word_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, rank, target, probability) of a word vocabulary, rank being the stored place from 1; probability stays text."""
    entry = "map<string,struct<samples_used:int,total_pairs:int,candidates:array<struct<target:string,probability:string>>,note:string>>"
    words = _whole(spark, path).select(F.explode(F.from_json("value", entry)).alias("word", "e"))
    return words.select("word", F.posexplode("e.candidates").alias("rank", "c")).select("word", (F.col("rank") + 1).alias("rank"), "c.target", "c.probability")


def sentence_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, place, english, target) of an inverted index in JSON, a list of single words or an object; a word's last entry counts."""
    entry = "map<string,array<map<string,string>>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{entry}>")).otherwise(F.array(F.from_json("value", entry)))
    items = _whole(spark, path).select(F.posexplode(listed).alias("at", "m")).select("at", F.explode("m").alias("word", "pairs"))
    last = items.groupBy("word").agg(F.max_by("pairs", "at").alias("pairs"))
    return last.select("word", F.posexplode("pairs").alias("place", "p")).select("word", "place", F.explode("p").alias("english", "target"))


def field(record: str, *names: str) -> Column:
    """The text of the first of these fields that a JSON record has; a field that is there and null counts as empty."""
    found = [F.get_json_object(F.col(record), f"$.{n}") for n in names]
    has = F.json_object_keys(record)
    out = F.lit(None).cast("string")
    for name, value in reversed(list(zip(names, found))):
        out = F.when(F.array_contains(has, name), F.coalesce(value, F.lit(""))).otherwise(out)
    return out


def predictions(spark: SparkSession, path: str, predict: tuple[str, ...] = ("predict", "tagin", "prediction", "predicted_translation"), label: tuple[str, ...] = ("label", "original_label")) -> DataFrame:
    """(path, row_no, predict, label), stripped; absent fields are empty."""
    text = lambda names: T.trim_space(F.coalesce(field("record", *names), F.lit("")))
    return read_records(spark, path).select("path", "row_no", text(predict).alias("predict"), text(label).alias("label"))


def instruction_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, english, target) of instruction records: what follows the first empty line, and the output."""
    r = read_records(spark, path)
    out = r.select("path", "row_no", T.first_segment_rest(field("record", "instruction")).alias("english"), T.trim_space(field("record", "output")).alias("target"))
    return out.where("english <> '' AND target <> ''")


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(path, eval_loss, train_loss, epoch); nulls for files that are empty or aren't JSON."""
    m = _whole(spark, path).select("path", F.from_json("value", "eval_loss double, train_loss double, epoch double").alias("m"))
    return m.select("path", "m.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, file_name, formatting, ranking) of a dataset registry."""
    entries = F.explode(F.from_json("value", "map<string,struct<file_name:string,formatting:string,ranking:boolean>>")).alias("name", "e")
    return _whole(spark, path).select(entries).select("name", "e.*")


def existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that exists, on any file system that Spark reads."""
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def language_of_path(path: Column, languages: list[str]) -> Column:
    """The first language that a file's name holds, else the name up to the first _ or dot."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(*[F.when(F.contains(name, F.lit(x.lower())), x) for x in languages], F.regexp_extract(name, r"^[^_.]*", 0))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the raw text: split at line feeds alone, one empty line at the end dropped, carriage returns kept."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    parts = F.split(F.regexp_replace("t", r"\n\z", ""), "\n", -1)
    return files.where("t <> ''").select("path", F.posexplode(parts).alias("line_no", "line")).select("path", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def rewrite_records(records: DataFrame, nodes: tuple[str, ...] = ("chosen", "rejected"), role: str = "gpt") -> DataFrame:
    """The records with every node's sender replaced and n_fixed, n_ok, n_missing; fields that aren't known stay as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, row_no, record in zip(frame["path"], frame["row_no"], frame["record"]):
                value, counts = json.loads(record), {"fixed": 0, "ok": 0, "missing": 0}
                for name in nodes:
                    node = value.get(name) if isinstance(value, dict) else None
                    if not isinstance(node, dict):
                        counts["missing"] += 1
                        continue
                    counts["ok" if node.get("from") == role else "fixed"] += 1
                    node["from"] = role
                out.append((path, row_no, json.dumps(value, ensure_ascii=False), *counts.values()))
            yield pd.DataFrame(out, columns=["path", "row_no", "record", "n_fixed", "n_ok", "n_missing"])

    return records.select("path", "row_no", "record").mapInPandas(run, "path string, row_no long, record string, n_fixed long, n_ok long, n_missing long")


def write_records(records: DataFrame, path: str, place: str = "row_no", record: str = "record", kind: str = "lines") -> None:
    """Writes JSON texts in the order of a unique place. kind "lines" is one a line; "array" makes the part files, read in the order of their names, one JSON array."""
    out = records.select(place, record)
    if kind == "array":
        ends = out.agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.count(F.lit(1)).alias("_n"))
        if ends.first()["_n"] == 0:
            records.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
            return
        out = out.join(F.broadcast(ends), F.lit(True))
        opened = F.when(F.col(place) == F.col("_lo"), "[").otherwise("")
        out = out.withColumn(record, F.concat(opened, record, F.when(F.col(place) == F.col("_hi"), "]").otherwise(",")))
    out.repartitionByRange(place).sortWithinPartitions(place).select(F.col(record).alias("value")).write.text(path)


def submission_name(team: str, slot: Column, pair: Column) -> Column:
    return F.concat(F.lit(f"{team}_"), slot, F.lit("_"), pair, F.lit(".txt"))

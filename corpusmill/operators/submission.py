"""Ordered export and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Language file and language-pair token.
PAIRS = [("bodo", "en_to_bodo"), ("karbi", "en_to_mjw"), ("kokborok", "en_to_trp"), ("nagamese", "en_to_nag"), ("targin", "en_to_tgj")]
SLOTS = [("contrastive1", "submit_contrastive_1"), ("contrastive2", "submit_contrastive_2")]


def plan(spark) -> DataFrame:
    """(slot, lang, pair, source, out_dir): ten rows of parameters."""
    slots = spark.createDataFrame(SLOTS, "slot string, out_dir string")
    langs = spark.createDataFrame(PAIRS, "lang string, pair string")
    folder = F.when(F.col("slot") == "contrastive2", "sft_predictions").when(F.col("lang") == "bodo", "sft_test_predictions").otherwise("sft_add_predictions")
    return F.broadcast(slots).join(langs, F.lit(True)).select("slot", "lang", "pair", F.concat(folder, F.lit("/"), "lang", F.lit("_predicted.json")).alias("source"), "out_dir")


def contiguous(df: DataFrame, key: str) -> DataFrame:
    """(n, n_distinct, least, most, ok): whether ids are 1..n, by counts alone, without a global order."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("n_distinct"), F.min(key).alias("least"), F.max(key).alias("most"))
    return one.withColumn("ok", F.coalesce((F.col("n") == F.col("n_distinct")) & (F.col("least") == 1) & (F.col("most") == F.col("n")), F.col("n") == 0))


def test_id(number: Column, fallback: Column) -> Column:
    """The serial number as an integer (3.0 is 3), else the fallback."""
    return F.coalesce(number.try_cast("double").try_cast("bigint"), fallback)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), T.sanitize(F.coalesce(F.col(text), F.lit(""))).alias("line"))


def write_lines(df: DataFrame, key: str, text: str, path: str) -> int:
    """Writes one line per row in the order of ids 1..n; raises if ids aren't contiguous or a line is empty. Files are in order by name."""
    out = lines(df, key, text)
    check = contiguous(out, "id").first()
    if not check["ok"]:
        raise ValueError(f"{path}: ids aren't 1 to {check['n']}")
    if empty := out.where("line = ''").limit(1).collect():
        raise ValueError(f"{path}: empty line at id {empty[0]['id']}")
    out.repartitionByRange("id").sortWithinPartitions("id").select("line").write.text(path)
    return check["n"]


def verify_sources(predicted: DataFrame, official: DataFrame) -> DataFrame:
    """(id, ok): a prediction's source against the official one of that id; a missing id isn't ok."""
    a = predicted.select("id", T.sanitize(F.col("source")).alias("have"))
    b = official.select("id", T.sanitize(F.col("source")).alias("want"))
    return a.join(b, "id", "left").select("id", F.coalesce(F.col("have") == F.col("want"), F.lit(False)).alias("ok"))


def verify_lines(content: DataFrame, expected: DataFrame) -> DataFrame:
    """(line_no, ok, has_cr) of every expected line against line_no, line of what was read back."""
    met = expected.select(F.col("id").alias("line_no"), F.col("line").alias("want")).join(content, "line_no", "left")
    return met.select("line_no", F.coalesce(F.col("line") == F.col("want"), F.lit(False)).alias("ok"), F.coalesce(F.contains("line", F.lit("\r")), F.lit(False)).alias("has_cr"))


def shards(df: DataFrame, place: str, n: int) -> DataFrame:
    """Adds shard: contiguous parts of equal size, the last ones shorter."""
    size = df.agg(F.ceil(F.count(F.lit(1)) / n).alias("_size"))
    return df.join(F.broadcast(size), F.lit(True)).withColumn("shard", F.floor((F.col(place) - 1) / F.col("_size")).cast("long")).drop("_size")


def models_for(languages: DataFrame, models: DataFrame) -> DataFrame:
    """(lang, model, skipped) of every language: the last model listed for it, or none and skipped."""
    last = models.groupBy("lang").agg(F.max_by("model", "place").alias("model"))
    return languages.select("lang").join(F.broadcast(last), "lang", "left").select("lang", "model", F.col("model").isNull().alias("skipped"))

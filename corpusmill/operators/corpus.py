"""Parallel text: ingest checks, inverted vocabulary, lexicon, hints, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, turn, english, target) of every user turn and the assistant turn after it; pair_id is unique for conversations of up to 2**20 turns."""
    u = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("english"))
    a = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1048576 + F.col("turn")).alias("pair_id"), "turn", "english", "target")


def valid(english: str = "english", target: str = "target") -> Column:
    """Both cells have text."""
    return F.coalesce(T.trim_space(F.col(english)) != "", F.lit(False)) & F.coalesce(T.trim_space(F.col(target)) != "", F.lit(False))


def dictionary(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select(F.explode(T.unique_tokens(F.col(col))).alias("word")).distinct()


def postings(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The inverted index in rows (word, pair_id): a sentence counts once for a word. Rows, not lists, so that a frequent word can't fill a task."""
    return pairs.where(valid()).select("pair_id", F.explode(T.unique_tokens(F.col("english"))).alias("word")).join(words, "word", "left_semi").select("word", "pair_id")


def word_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("word").agg(F.count(F.lit(1)).alias("n_pairs"))


def eligible(index: DataFrame, least: int = 2) -> DataFrame:
    return word_counts(index).where(F.col("n_pairs") >= least)


def cooccurrence(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, target, n_both, n_word, n_target, p_bp): counts of pairs, and the Dice coefficient in 1/10000, floored.

    Both counts of single words come before the join, so only (word, target)
    occurrences of one pair at a time are made.
    """
    both = pairs.where(valid()).select("pair_id", T.unique_tokens(F.col("english")).alias("e"), T.unique_tokens(F.col("target")).alias("t"))
    e = both.select("pair_id", "t", F.explode("e").alias("word")).join(words, "word", "left_semi")
    n_word = e.groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
    n_target = both.select(F.explode("t").alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n_target"))
    met = e.select("word", F.explode("t").alias("target")).groupBy("word", "target").agg(F.count(F.lit(1)).alias("n_both"))
    out = met.join(n_word, "word").join(n_target, "target")
    return out.select("word", "target", "n_both", "n_word", "n_target", F.floor(20000 * F.col("n_both") / (F.col("n_word") + F.col("n_target"))).cast("long").alias("p_bp"))


def top_candidates(lexicon: DataFrame, k: int = 3, least_bp: int = 5000) -> DataFrame:
    """The k best targets of a word of at least least_bp, ranked by p_bp, then by target."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("p_bp"), "target"))
    return lexicon.where(F.col("p_bp") >= least_bp).withColumn("rank", rank).where(F.col("rank") <= k)


def clean_candidates(df: DataFrame, target: str, probability: Column) -> DataFrame:
    """Blank targets and probabilities that aren't numbers go; the rest are clipped to 0..1, in 1/10000, floored."""
    number = probability.try_cast("double")
    p = F.when(number.isNotNull(), F.floor(10000 * F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))).cast("long")
    name = T.trim_space(F.col(target))
    return df.withColumn("target", name).withColumn("p_bp", p).where((F.col("target") != "") & F.col("p_bp").isNotNull())


def percent(p_bp: Column) -> Column:
    """0.62 for 6234."""
    n = F.floor(p_bp / 100)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


#: The texts of a training prompt, around the language's name.
PROMPT_HEAD = ("Translate the following segment into ", ", without additional explanation.\n\n")
HINT_HEAD = ("Helpful ", " vocabulary for words in this sentence:\n")


def instructions(pairs: DataFrame, candidates: DataFrame, language: str) -> DataFrame:
    """(pair_id, n_hints, instruction): the request, a block of vocabulary hints in the order of the words, the sentence."""
    shown = candidates.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("target", F.lit(" ("), percent(F.col("p_bp")), F.lit(")")).alias("s")))).alias("c"))
    shown = shown.select("word", F.array_join(F.col("c.s"), " / ").alias("shown"))
    tokens = pairs.select("pair_id", F.posexplode(T.unique_tokens(F.col("english"))).alias("pos", "word"))
    # a sentence's words only, so the lists are bounded by a sentence
    lines = tokens.join(shown, "word").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "word", F.lit(": "), "shown").alias("s")))).alias("lines"))
    block = F.concat(F.lit(language.join(HINT_HEAD)), F.array_join(F.col("lines.s"), "\n"), F.lit("\n\n"))
    head = language.join(PROMPT_HEAD)
    joined = pairs.join(lines, "pair_id", "left")
    return joined.select("pair_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_hints"), F.concat(F.lit(head), F.when(F.col("lines").isNotNull(), block).otherwise(""), "english").alias("instruction"))


def hash_order(df: DataFrame, key: Column, seed: str = "42") -> DataFrame:
    """Adds place: the 1-based rank by md5 of seed and key, null keys first. Ranks are counted in 4096 buckets of the hash and offset by the buckets before, so no task sorts all rows."""
    h = F.coalesce(F.md5(F.concat(F.lit(seed + "|"), key.cast("string"))), F.lit(""))
    df = df.withColumn("_h", h).withColumn("_b", F.substr(h, F.lit(1), F.lit(3)))
    counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return df.withColumn("_i", inside).join(F.broadcast(offsets), "_b").withColumn("place", F.col("_i") + F.col("_before")).drop("_h", "_b", "_i", "_before")


def split(df: DataFrame, key: Column, ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """Adds split: train for round(n * ratio) rows (ties to even) by hash order, test for the rest."""
    n = df.agg(F.bround(F.count(F.lit(1)) * F.lit(ratio)).alias("_train"))  # one row
    return hash_order(df, key, seed).join(F.broadcast(n), F.lit(True)).withColumn("split", F.when(F.col("place") <= F.col("_train"), "train").otherwise("test")).drop("_train", "place")


def sample_per_key(df: DataFrame, key: str, item: Column, k: int = 10, seed: str = "42") -> DataFrame:
    """k rows of each key by hash order, all if there are fewer."""
    h = F.md5(F.concat(F.lit(seed + "-"), F.col(key), F.lit("|"), item.cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(h, item))).where(F.col("_r") <= k).drop("_r")


def vocabulary_of(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pair_id, pos, *vocabulary) of every distinct word of a sentence that the vocabulary holds; pos keeps the sentence's order."""
    return pairs.select("pair_id", F.posexplode(T.unique_tokens(F.col("english"))).alias("pos", "word")).join(vocabulary, "word")


def last_of(df: DataFrame, key: str, place: str) -> DataFrame:
    """One row of each key: the one with the greatest place. Null keys go."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(place, *[c for c in rest if c != place])).alias("_m"))
    return best.select(*[F.col(c) if c == key else F.col("_m")[c].alias(c) for c in df.columns])


def placed(df: DataFrame, key: str) -> DataFrame:
    """Adds place: the 1-based rank by an integer key, null keys first. Ranks are counted in 4096 ranges of the key and offset by the ranges before, so no task sorts all rows unless a range holds them all."""
    ends = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))  # one row
    df = df.join(F.broadcast(ends), F.lit(True))
    df = df.withColumn("_b", F.coalesce(F.floor((F.col(key) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * 4096), F.lit(-1)))
    counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return df.withColumn("_i", inside).join(F.broadcast(offsets), "_b").withColumn("place", F.col("_i") + F.col("_before")).drop("_b", "_i", "_before", "_lo", "_hi")


def zipped(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Rows of both sides at equal places in the order of their keys; the longer side is cut."""
    return placed(a, a_key).join(placed(b, b_key), "place")

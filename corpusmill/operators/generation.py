"""Batched generation with retries: the contract of a model call, with the model as a parameter."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import working
from . import corpus


def generate(df: DataFrame, key: str, prompt: str, model: Callable[[list[str], int], list[str]], accept: Callable[[str, str], bool] = lambda p, o: bool(o), tries: int = 6, batch: int = 128, against: str | None = None) -> DataFrame:
    """(key, output, attempts, status): prompts go to model(prompts, attempt) in batches; those whose output isn't accepted are tried again, tries times at most.

    accept sees the prompt, or the column against where that is given, and the output.
    """
    other = against or prompt

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                prompts, others = part[prompt].tolist(), part[other].tolist()
                out, attempts, open_ = [""] * len(part), [0] * len(part), list(range(len(part)))
                for attempt in range(tries):
                    if not open_:
                        break
                    for i, text in zip(open_, model([prompts[i] for i in open_], attempt)):
                        out[i], attempts[i] = text, attempt + 1
                    open_ = [i for i in open_ if not accept(others[i], out[i])]
                left = set(open_)
                yield pd.DataFrame({key: part[key].to_numpy(), "output": out, "attempts": attempts, "status": ["failed" if i in left else "ok" for i in range(len(part))]})

    return df.select(*dict.fromkeys([key, prompt, other])).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, output string, attempts long, status string")


def rejected(df: DataFrame, key: str, prompt: str, chosen: str, model: Callable[[list[str], int], list[str]], tries: int = 20) -> DataFrame:
    """(key, output, attempts, status): answers that differ from the chosen text, at a temperature that the model raises with the attempt; failed after tries."""
    return generate(df, key, prompt, model, lambda text, out: out != (text or "").strip(), tries, against=chosen)


def chat_prompt(*fields: str, record: str) -> Column:
    """The first of the fields that is there, else the record itself."""
    return F.coalesce(*[F.col(f) for f in fields], F.col(record).cast("string"))


#: What a call came to.
OK, BLOCKED, NETWORK, UNPARSED = "ok", "blocked", "neterr", "parse_err"
REPLY = "struct<candidates:array<struct<target:string,probability:string>>>"


def calls(df: DataFrame, key: str, prompt: str, send: Callable[[str], tuple[str, str]], tries: int = 3, wait: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, reply, status) of one call a row: send returns a status (ok, blocked, throttled or anything else for a failure) and a text.

    Failures and replies that aren't JSON are tried again after wait seconds, twice
    wait and so on, doubled where the service throttles; a blocked prompt isn't.
    """

    def model(prompts: list[str], attempt: int) -> list[str]:
        out = []
        for text in prompts:
            if attempt and wait:
                sleep(wait * attempt * (2 if throttled.pop(text, False) else 1))
            status, reply = send(text)
            throttled[text] = status == "throttled"
            out.append(json.dumps([status, reply]))
        return out

    def settled(_: str, output: str) -> bool:
        status, reply = json.loads(output)
        return status == BLOCKED or (status == OK and parses(reply))

    throttled: dict[str, bool] = {}
    got = generate(df, key, prompt, model, settled, tries)
    pair = F.from_json("output", "array<string>")
    status, reply = F.element_at(pair, 1), F.element_at(pair, 2)
    said = F.when(status == BLOCKED, BLOCKED).when(F.col("status") == "ok", OK).when(status == OK, UNPARSED).otherwise(NETWORK)
    return got.select(key, F.when(said == OK, reply).alias("reply"), said.alias("status"))


def parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def merge_candidates(replies: DataFrame, key: str, place: str, reply: str) -> DataFrame:
    """(key, candidates): the targets of a key's replies with the highest of their probabilities (clipped to 0..1, 4 digits), best first, ties by place of the reply and in it; what has no target or number is left out."""
    each = replies.select(key, F.col(place).alias("_p"), F.posexplode(F.from_json(reply, REPLY)["candidates"]).alias("_i", "_c"))
    number = F.col("_c.probability").try_cast("double")
    each = each.where(number.isNotNull()).select(key, "_p", "_i", T.trim_space(F.col("_c.target")).alias("target"), F.round(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), 4).alias("probability"))
    best = each.where("target <> '' and not isnan(probability)").groupBy(key, "target").agg(F.max("probability").alias("probability"), F.min(F.struct("_p", "_i")).alias("_at"))
    # a key has a bounded number of replies
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("_n"), "_at", "target", "probability")))
    return best.groupBy(key).agg(F.transform(ordered, lambda c: F.struct(c["target"].alias("target"), c["probability"].alias("probability"))).alias("candidates"))


def word_prompts(samples: DataFrame, language: str) -> Column:
    """The prompt of a word and its pairs (english, target), numbered in their order."""
    lines = F.transform("pairs", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". EN: "), x["english"], F.lit(f"\n   {language}: "), x["target"]))
    head = F.concat(F.lit(f'Which {language} words translate "'), F.col("word"), F.lit('" in these sentences?\n'))
    return F.concat(head, F.array_join(lines, "\n"), F.lit('\nAnswer with JSON: {"word": "'), F.col("word"), F.lit('", "candidates": [{"target": "...", "probability": 0.0}]}'))


def word_samples(index: DataFrame, pairs: DataFrame, k: int, rounds: int, language: str) -> DataFrame:
    """(word, round, place, prompt): for each round below rounds k pairs of a word by a seed of its own, equal samples once; as round rounds the first k pairs one by one."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round")
    drawn = F.md5(F.concat(F.lit("recover-"), F.col("round").cast("string"), F.lit("-"), "word", F.lit("|"), F.col("pair_id").cast("string")))
    order = Window.partitionBy("word", "round").orderBy(F.when(F.col("round") < rounds, drawn), "pair_id")
    # all rounds are ranked in one pass, a word's rounds by several tasks
    few = index.select("word", "pair_id", seeds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    few = few.join(pairs.select("pair_id", "english", "target"), "pair_id")
    alone = F.when(F.col("round") == rounds, F.col("rank")).otherwise(0)
    samples = few.groupBy("word", "round", alone.alias("place")).agg(F.array_sort(F.collect_list(F.struct("pair_id", "english", "target"))).alias("pairs"))
    ids = F.when(F.col("round") < rounds, F.col("pairs.pair_id")).otherwise(F.array(F.lit(-1).cast("long"), F.col("place").cast("long")))
    first = samples.groupBy("word", ids.alias("ids")).agg(F.min_by(F.struct("round", "place", "pairs"), "round").alias("s"))
    return first.select("word", "s.*").select("word", "round", "place", word_prompts(samples, language).alias("prompt"))


def recover_words(index: DataFrame, pairs: DataFrame, send: Callable[[str], tuple[str, str]], language: str, k: int = 10, rounds: int = 8, **options) -> DataFrame:
    """(word, samples_used, total_pairs, candidates, n_ok, n_blocked, n_failed) of every word of index (word, pair_id).

    Round by round, the words without an answer are asked with another sample of
    k pairs; those that no sample has answered are asked pair by pair.  A round
    is one table of calls in the working folder; the next one takes the words
    that are still open, so a call that was answered isn't made again.
    """
    asked = working.stored(word_samples(index, pairs, k, rounds, language).withColumn("call", F.concat_ws("|", "word", F.col("round").cast("string"), F.col("place").cast("string"))))
    made = None
    for turn in range(rounds + 1):
        now = asked.where(F.col("round") == turn)
        if made is not None:
            now = now.join(made.where(F.col("status") == OK).select("word"), "word", "left_anti")
        got = working.stored(now.join(calls(now, "call", "prompt", send, **options), "call").select("word", "round", "place", "reply", "status"))
        made = got if made is None else made.union(got)
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = made.groupBy("word").agg(is_(OK).alias("n_ok"), is_(BLOCKED).alias("n_blocked"), is_(NETWORK, UNPARSED).alias("n_failed"))
    found = merge_candidates(made.where(F.col("status") == OK), "word", "place", "reply")
    out = corpus.word_counts(index).join(counts, "word", "left").join(found, "word", "left")
    none = F.array().cast(found.schema["candidates"].dataType)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("word", F.least(F.lit(k), "n_pairs").cast("long").alias("samples_used"), F.col("n_pairs").alias("total_pairs"), F.coalesce("candidates", none).alias("candidates"), n("n_ok"), n("n_blocked"), n("n_failed"))

"""Machine-translation scores, reference-free quality signals, and repair of degenerate output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def quality_signals(df: DataFrame, hyp: str, src: str) -> DataFrame:
    """Adds the reference-free signals of a segment, in 1/10000, rounded."""
    h, s = F.col("_h"), F.col("_s")
    n, m = F.size(h), F.size(s)

    def distinct(k: int) -> Column:
        return F.when(n < k, 1.0).otherwise(F.size(F.array_distinct(F.col(f"_g{k}"))) / F.size(F.col(f"_g{k}")))

    df = df.withColumn("_h", T.qe_tokens(T.trim_space(F.col(hyp)))).withColumn("_s", T.qe_tokens(T.trim_space(F.col(src))))
    df = df.withColumn("_g2", T.ngrams(h, 2)).withColumn("_g3", T.ngrams(h, 3))
    df = df.withColumn("_low", F.array_distinct(F.transform(s, F.lower)))
    df = df.withColumn("_longest", F.aggregate(h, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)))
    d1 = F.size(F.array_distinct(h)) / n
    pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    dup = F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / n
    long = F.length("_longest")
    tri = T.char_ngrams(F.col("_longest"), 3)
    runaway = F.when(long <= 25, 0.0).otherwise(F.least(F.lit(1.0), (1.0 - F.size(F.array_distinct(tri)) / F.size(tri)) * (long / 60.0)))
    ratio = F.when(m > 0, n / m).otherwise(0.0)
    copy = F.size(F.filter(h, lambda t: F.array_contains(F.col("_low"), F.lower(t)))) / n
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = {"length_ratio": ratio, "distinct_1": d1, "distinct_2": distinct(2), "distinct_3": distinct(3), "dup_rate": dup, "runaway": runaway, "copy_rate": copy}
    df = df.withColumns({f"_{k}": F.when(n > 0, v).otherwise(0.0) for k, v in parts.items()})
    fluency = clamp(0.5 * F.col("_distinct_2") + 0.5 * F.col("_distinct_3") - 0.5 * F.col("_dup_rate") - F.col("_runaway"))
    r = F.col("_length_ratio")
    adequacy = F.when(m == 0, 0.5).when((r >= 0.6) & (r <= 1.6), 1.0).when(r < 0.6, clamp((r - 0.2) / (0.6 - 0.2))).otherwise(clamp((3.5 - r) / (3.5 - 1.6)))
    translated = 1.0 - clamp((F.col("_copy_rate") - 0.15) / (0.65 - 0.15))
    quality = F.when(n > 0, 100.0 * (0.40 * fluency + 0.30 * adequacy + 0.20 * translated + 0.10 * 1.0)).otherwise(0.0)
    whole = lambda x: F.floor(x * 10000 + 0.5).cast("long")
    out = {k: whole(F.col(f"_{k}")) for k in parts} | {
        "rep3_rate": whole(F.when(n > 0, 1.0 - F.col("_distinct_3")).otherwise(1.0)), "quality": whole(quality),
        "empty": (n == 0).cast("int"), "too_long": (r > 3.0).cast("int"), "too_short": (r < 0.3).cast("int"), "untranslated": (F.col("_copy_rate") > 0.6).cast("int"),
    }
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, *[v.alias(k) for k, v in out.items()])


def _repeats(n: int, collapse: bool):
    def first(t) -> int | None:
        kept, seen = 0, set()
        for i in range(len(t)):
            if collapse and i and t[i] == t[i - 1]:
                continue
            if i >= n - 1:
                before = len(seen)
                seen.add(tuple(t[i - n + 1 : i + 1]))
                if len(seen) == before:
                    return kept
            kept += 1
        return None

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        # only one text at a time is a list of Python strings
        return pa.array([first(t.as_py()) if t.is_valid else None for t in texts], pa.int64())

    return run


def repeat_at(tokens: Column, n: int = 3, collapse: bool = False) -> Column:
    """The 0-based token at which an n-gram first ends for the second time, or null; with collapse, immediate duplicates neither count as tokens nor end n-grams."""
    return _repeats(n, collapse)(tokens)


def first_repeat(df: DataFrame, key: str, tokens: str, n: int = 3) -> DataFrame:
    """(key, repeat_at) of the texts that repeat an n-gram."""
    return df.select(key, repeat_at(F.col(tokens), n).alias("repeat_at")).where("repeat_at is not null")


def decode_fix(df: DataFrame, text: str, ref_len: Column | None = None, n: int = 3, mult: float = 2.0, cap: int = 64, pad: int = 8, collapse: bool = False) -> DataFrame:
    """Adds fixed and changed: a text is cut at its first repeated n-gram or at the length cap, whichever comes first; others stay byte-identical.

    With collapse, immediate duplicates go in the same pass: the cap is on what
    is kept, repeated n-grams are those of the whole text.
    """
    df = df.withColumn("_all", T.indic_tokens(F.col(text)))
    df = df.withColumn("_t", F.filter("_all", lambda w, i: (i == 0) | (w != F.try_element_at("_all", i))) if collapse else F.col("_all"))
    size = F.size("_all") if ref_len is None else ref_len
    limit = F.floor(F.least(F.lit(float(cap)), F.greatest(size * mult, (size + pad).cast("double")))).cast("long")
    stop = F.least(F.coalesce(repeat_at(F.col("_all"), n, collapse), F.lit(2**31 - 1)), limit, F.size("_t").cast("long"))
    df = df.withColumn("_stop", stop)
    cut = F.col("_stop") < F.size("_all")
    fixed = F.when(cut, F.array_join(F.slice("_t", F.lit(1), F.col("_stop").cast("int")), " ")).otherwise(F.col(text))
    return df.withColumn("fixed", fixed).withColumn("changed", cut).drop("_all", "_t", "_stop")


def collapse_fix(df: DataFrame, text: str) -> DataFrame:
    """Adds collapsed: immediate duplicate tokens dropped; texts without any stay byte-identical."""
    # tokens and kept are columns: in a lambda the splitter would run again for every token
    df = df.withColumn("_t", T.indic_tokens(F.col(text)))
    df = df.withColumn("_kept", F.filter("_t", lambda w, i: (i == 0) | (w != F.try_element_at("_t", i))))
    collapsed = F.when(F.size("_kept") < F.size("_t"), F.array_join("_kept", " ")).otherwise(F.col(text))
    return df.withColumn("collapsed", collapsed).drop("_t", "_kept")


def take_shorter(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chosen, from_first) for keys in both: the text of fewer tokens, the first on a tie."""
    met = a.select(key, F.col(text).alias("a")).join(b.select(key, F.col(text).alias("b")), key)
    first = F.size(T.indic_tokens(F.col("a"))) <= F.size(T.indic_tokens(F.col("b")))
    return met.select(key, F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"), first.alias("from_first"))


#: Characters or tokens counted at a time, which bounds a task's working arrays whatever a batch holds; a longer segment is counted alone.
STEP = 1 << 18


def _sizes(column: pa.Array) -> np.ndarray:
    """Tokens of each list, or characters of each text; null has none."""
    length = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.utf8_length
    return length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _steps(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of rows of at most limit in all, or of one row."""
    ends, row = np.cumsum(sizes), 0
    while row < len(sizes):
        stop = int(np.searchsorted(ends, ends[row] - sizes[row] + limit, "right"))
        yield row, max(stop, row + 1)
        row = max(stop, row + 1)


def _codes_of(column: pa.Array) -> np.ndarray:
    """A number for each token of all lists, or character of all texts, the same for equal ones."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return pc.dictionary_encode(pc.list_flatten(column), null_encoding="encode").indices.to_numpy().astype(np.int64)
    return np.frombuffer("".join(column.drop_null().to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)


def _clipped(hyp: pa.Array, ref: pa.Array, orders: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order (matches, n-grams of the output, of the reference) of every segment of a step."""
    n_seg, both = len(hyp), pa.concat_arrays([hyp, ref])
    codes, size = _codes_of(both), _sizes(both)
    of = np.repeat(np.arange(2 * n_seg), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # tokens from here to the list's end
    grams, out = codes, []
    for n in range(1, orders + 1):
        at = np.flatnonzero(left >= n)
        if n > 1:  # an n-gram is the one before it and one more token
            longer = np.zeros(len(codes), np.int64)
            longer[at] = pd.factorize(grams[at] * (codes.max(initial=0) + 1) + codes[at + n - 1])[0]
            grams = longer
        wide = int(grams.max(initial=0)) + 1
        sides = [np.unique(of[x] % n_seg * wide + grams[x], return_counts=True) for x in (at[of[at] < n_seg], at[of[at] >= n_seg])]
        met, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
        matches = np.bincount(met // wide, np.minimum(sides[0][1][i], sides[1][1][j]), n_seg).astype(np.int64)
        total = np.maximum(size - n + 1, 0)
        out.append((matches, total[:n_seg], total[n_seg:]))
    return out


def _counted(batch: pa.RecordBatch, parts: list[tuple[str, str, int]], by: tuple[str, ...], guarded: bool, step: int) -> Iterator[pa.RecordBatch]:
    """(*by, n, matches, hyp_total, ref_total) of every segment of a batch, a step at a time."""
    before = 0
    for h, r, orders in parts:
        hyp, ref = batch.column(h), batch.column(r)
        for a, b in _steps(_sizes(hyp) + _sizes(ref), step):
            matches, of_hyp, of_ref = (np.concatenate(x) for x in zip(*_clipped(hyp.slice(a, b - a), ref.slice(a, b - a), orders)))
            number = np.repeat(np.arange(before + 1, before + orders + 1, dtype=np.int32), b - a)
            groups = [pa.concat_arrays([batch.column(c).slice(a, b - a)] * orders) for c in by]
            counts = [number, matches, np.where(of_ref > 0, of_hyp, 0) if guarded else of_hyp, of_ref]
            yield pa.RecordBatch.from_arrays([*groups, *map(pa.array, counts)], [*by, "n", "matches", "hyp_total", "ref_total"])
        before += orders


def clipped_matches(df: DataFrame, parts: list[tuple[str, str, int]], by: tuple[str, ...] = (), guarded: bool = False, step: int = STEP) -> DataFrame:
    """(*by, n, matches, hyp_total, ref_total) over the corpus: n-gram counts of each segment, clipped by the reference's, summed.

    parts names the columns of output and reference (token lists, or texts, of
    which characters count) and how many orders; n goes on from one part to the
    next.  guarded: a segment's order counts only if its reference has it.
    Clipping never leaves a segment, so all is counted in the task that holds
    it, segments of step tokens at a time, and a few numbers a segment are summed.
    """
    columns = list(dict.fromkeys(c for h, r, _ in parts for c in (h, r)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(batch, parts, by, guarded, step)

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    counts = df.select(*by, *columns).mapInArrow(run, fields + "n int, matches long, hyp_total long, ref_total long")
    return counts.groupBy(*by, "n").agg(*[F.sum(c).alias(c) for c in ("matches", "hyp_total", "ref_total")]).where("hyp_total + ref_total > 0")


def bleu(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Corpus BLEU-4 without smoothing from clipped_matches of orders 1 to 4, in 1/10000, rounded; 0 if an order has no match."""
    logs = F.sum(F.when(F.col("matches") > 0, F.log(F.col("matches") / F.col("hyp_total")))) / 4
    c, r = F.max(F.when(F.col("n") == 1, F.col("hyp_total"))), F.max(F.when(F.col("n") == 1, F.col("ref_total")))
    full = F.sum((F.col("matches") > 0).cast("int")) == 4
    one = stats.groupBy(*by).agg(logs.alias("l"), c.alias("c"), r.alias("r"), full.alias("full"))
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1.0 - F.col("r") / F.col("c")))
    return one.select(*by, F.when(F.col("full"), F.floor(1000000 * brevity * F.exp("l") + 0.5)).otherwise(0).cast("long").alias("bleu_e4"), F.col("c").alias("hyp_len"), F.col("r").alias("ref_len"))


def bleu_parts(stats: DataFrame) -> DataFrame:
    """(n, precision_e4, bp_e4, len_ratio_e4): the precision of every order beside brevity penalty and length ratio, in 1/10000, rounded."""
    whole = lambda x: F.floor(10000 * x + 0.5).cast("long")
    size = stats.where("n = 1").select(F.col("hyp_total").alias("c"), F.col("ref_total").alias("r"))  # one row
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1.0 - F.col("r") / F.col("c")))
    return stats.join(F.broadcast(size), F.lit(True)).select("n", whole(F.col("matches") / F.col("hyp_total")).alias("precision_e4"), whole(brevity).alias("bp_e4"), whole(F.col("c") / F.col("r")).alias("len_ratio_e4"))


def chrf_stats(df: DataFrame, hyp: str, ref: str, words: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """clipped_matches of character orders 1 to 6 and, as orders 7 on, of word orders 1 to words; a segment's order counts only if its reference has it."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sides = [("_h", text(hyp)), ("_r", text(ref))]
    df = df.select(*by, *[F.regexp_replace(t, T.SPACE, "").alias(s + "c") for s, t in sides], *[T.words_and_marks(t).alias(s + "w") for s, t in sides])
    return clipped_matches(df, [("_hc", "_rc", 6)] + ([("_hw", "_rw", words)] if words else []), by, guarded=True)


def chrf(stats: DataFrame, beta: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """F-score of precision and recall averaged over the orders that both sides have, in 1/10000, rounded."""
    has = (F.col("hyp_total") > 0) & (F.col("ref_total") > 0)
    p, r = F.avg(F.when(has, F.col("matches") / F.col("hyp_total"))), F.avg(F.when(has, F.col("matches") / F.col("ref_total")))
    b = beta * beta
    one = stats.groupBy(*by).agg(p.alias("p"), r.alias("r"))
    return one.select(*by, F.when(F.col("p") + F.col("r") > 0, F.floor(1000000 * (1 + b) * F.col("p") * F.col("r") / (b * F.col("p") + F.col("r")) + 0.5)).otherwise(0).cast("long").alias("chrf_e4"))


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    return np.array([number[w] for w in a], np.int64), np.array([number[w] for w in b], np.int64)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    x, y = _codes(list(a), list(b))
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == w)))])
    return int(row[-1])


def edits(a: list, b: list) -> int:
    """Word edit distance."""
    x, y = _codes(list(a), list(b))
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, w in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - step) + step
    return int(row[-1])


def _edits_of_many(rows: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Edit distances of equally long sequences, a row each, to one reference."""
    step = np.arange(len(ref) + 1, dtype=np.int32)
    row = np.tile(step, (len(rows), 1))
    for i in range(rows.shape[1]):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (rows[:, i : i + 1] != ref))
        first = np.full((len(rows), 1), i + 1, np.int32)
        row = np.minimum.accumulate(np.concatenate([first, best], axis=1) - step, axis=1) + step
    return row[:, -1]


def shifted_edits(hyp: list, ref: list, longest: int = 10, farthest: int = 50, block: int = 256) -> int:
    """Edits with block moves at one edit each: the move that lowers the distance most is made, until none does.

    A move takes up to longest words that the reference holds, at most farthest
    places away.  All moves of a round are measured, block of them at a time.
    """
    words, want = _codes(list(hyp), list(ref))
    places: dict[tuple, list[int]] = {}
    for j in range(len(want)):
        for n in range(1, min(longest, len(want) - j) + 1):
            places.setdefault(tuple(want[j : j + n].tolist()), []).append(j)
    now, shifts = edits(list(hyp), list(ref)), 0
    while now > 1:  # a move costs 1, so it can't pay at a distance of 1
        moves, plain = [], words.tolist()
        for i in range(len(plain)):
            for n in range(1, min(longest, len(plain) - i) + 1):
                at = places.get(tuple(plain[i : i + n]))
                if not at:
                    break
                moves += [(i, n, j) for j in at if i != j and abs(i - j) <= farthest and j <= len(plain) - n]
        best = None
        for a in range(0, len(moves), block):
            part = [plain[:i] + plain[i + n :] for i, n, _ in moves[a : a + block]]
            made = [rest[:j] + plain[i : i + n] + rest[j:] for rest, (i, n, j) in zip(part, moves[a : a + block])]
            distance = _edits_of_many(np.array(made, np.int64), want)
            k = int(distance.argmin())
            if best is None or distance[k] < best[0]:
                best = (int(distance[k]), np.array(made[k], np.int64))
        if best is None or best[0] + 1 >= now:
            break
        now, words, shifts = best[0], best[1], shifts + 1
    return now + shifts


def meteor(hyp: list, ref: list, stem: Callable[[str], str] | None = None, synonyms: dict[str, set[str]] | None = None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR of lower-cased words: equal words are matched first, then those of equal stem, then synonyms of a word of hyp.

    Each stage takes what the ones before left, from the right, and of several
    free words of ref the last. Stemmer and synonyms (by lower-cased word) are
    the caller's and go to every task; without them their stages are left out.
    """
    hyp, ref = [w.lower() for w in hyp], [w.lower() for w in ref]
    stages = [(lambda w: {w}, lambda w: w)]
    if stem:
        stages.append((lambda w: {stem(w)}, stem))
    if synonyms:
        stages.append((lambda w: {w, *synonyms.get(w, ())}, lambda w: w))
    pairs: list[tuple[int, int]] = []
    for wanted, key in stages:
        done, taken = {i for i, _ in pairs}, {j for _, j in pairs}
        free: dict[str, list[int]] = {}
        for j, w in enumerate(ref):
            if j not in taken:
                free.setdefault(key(w), []).append(j)
        for i in reversed(range(len(hyp))):
            places = [] if i in done else [free[k] for k in wanted(hyp[i]) if free.get(k)]
            if places:
                pairs.append((i, max(places, key=lambda x: x[-1]).pop()))
    pairs.sort()
    m = len(pairs)
    if not m:
        return 0.0
    p, r = m / len(hyp), m / len(ref)
    chunks = 1 + sum(1 for (a, b), (c, d) in zip(pairs, pairs[1:]) if (c, d) != (a + 1, b + 1))
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / m) ** beta)


def bootstrap_median(df: DataFrame, key: str, values: list[str], samples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: the median over resamples of the mean of each value; null if there are no rows.

    A row's weight in a resample is a Poisson(1) number drawn from seed and key,
    so the result doesn't depend on partitions; a task sends one sum a resample.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((samples, len(values) + 1))
        for frame in frames:
            x = np.column_stack([np.ones(len(frame)), frame[values].to_numpy(float)])
            for k, row in zip(frame["_k"], x):
                total += np.random.default_rng([seed, k % 2**64]).poisson(1.0, samples)[:, None] * row
        yield pd.DataFrame({"sample": range(samples), "_n": total[:, 0]} | {v: total[:, i] for i, v in enumerate(values, 1)})

    schema = "sample int, _n double, " + ", ".join(f"`{v}` double" for v in values)
    sums = df.select(F.xxhash64(key).alias("_k"), *values).mapInPandas(run, schema)
    means = sums.groupBy("sample").agg(F.sum("_n").alias("_n"), *[F.sum(v).alias(v) for v in values]).where("_n > 0")
    return means.agg(*[F.percentile(F.col(v) / F.col("_n"), 0.5).alias(v) for v in values])


def pair_measure(measure: Callable[[list, list], float], kind: str):
    """A vectorised column function of two token arrays; Arrow batches carry the segments, of which one at a time is lists of Python strings."""

    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.array([measure(x.as_py(), y.as_py()) for x, y in zip(a, b)], float if kind == "double" else np.int64))

    return run

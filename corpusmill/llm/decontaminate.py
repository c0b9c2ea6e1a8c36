"""Benchmark decontamination by a prefix-filtered set join.

Every window of consecutive item words (the whole item if it is shorter) is a
record, the set of its shingles of SHINGLE words.  Shingles are ordered by how
often they occur in all documents, rarest first; as a record must be contained
whole, its necessary prefix is its rarest shingle.  Prefixes are joined with the
shingles of the documents; where a hit would put the window gives the
positional and the length bound, and survivors are verified word by word.

The documents are read and tokenised once, whatever the size of the benchmark.
In that pass a Bloom filter of the benchmark's shingles (of BLOOM_BYTES at most;
a larger benchmark only makes it let more through) leaves the runs of words in
which every shingle that a window would need may be the benchmark's, and counts
the shingles that pass.  Rarity, prefixes, candidates, verification and spans
are Spark joins and aggregations on what was left.  The prefixes are broadcast
if they are measured to take BROADCAST_BYTES at most; beyond, they are joined
with SALT parts of every key, so that a frequent shingle is no task's alone.

Edge cases: null or empty text has no words and isn't hit; a null id stays
null; an item without words matches nothing; an item shorter than a window is
one window; equal items all count, repeated item_ids count once, a null item_id
hits words but isn't listed; item_ids may be of any type; empty tables give no
rows or no hits; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import ship
from . import scratch, vec

SHINGLE = 4
BLOOM_BYTES = 32 << 20
BROADCAST_BYTES = 32 << 20
SALT = 32
_ADDED = {"n_words": "long", "n_hit": "long", "hit_spans": "array<struct<start:int,stop:int>>", "item_ids": "array"}


def _words(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, vec.Rolling]]:
    """(first row, rows, lower-cased bytes, begin and end of each word, first word of each text, hashes of word ranges) of pieces of a column."""
    for row, n, data, offsets in vec.text_batches(column):
        data = vec.lower(data)
        starts, ends, first = vec.words(data, offsets, vec.ALNUM)
        yield row, n, data.tobytes(), starts, ends, first, vec.Rolling(vec.hash_words(data, starts, ends))


def _shingles(rolling: vec.Rolling, n: int) -> np.ndarray:
    """Hashes of the shingles of windows of n words, by their first word; windows of other lengths have others."""
    return vec.mix(rolling.windows(min(n, SHINGLE)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    return b" ".join(raw[p:q] for p, q in zip(starts[a:b].tolist(), ends[a:b].tolist())).decode("utf-8", "replace")


def windows(benchmark: DataFrame, window: int, item_col: str, item_text: str) -> DataFrame:
    """(item, n, words, hashes): every window of every item, its words joined by one space, and the hashes of its shingles."""
    ship(benchmark.sparkSession)
    chosen = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, raw, starts, ends, first, rolling in _words(batch.column(1)):
                of, sizes, texts, lists = [], [], [], []
                made = {size: _shingles(rolling, size).view(np.int64) for size in {min(window, x) for x in np.diff(first).tolist()} if size}
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    size = min(window, b - a)
                    for k in range(a, b - size + 1 if size else a):
                        of.append(row + i)
                        sizes.append(size)
                        texts.append(_joined(raw, starts, ends, k, k + size))
                        lists.append(made[size][k : k + size - min(size, SHINGLE) + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["item", "n", "words", "hashes"])

    return chosen.mapInArrow(run, f"item {chosen.schema['item'].dataType.simpleString()}, n int, words string, hashes array<long>")


class Bloom:
    """A blocked Bloom filter of 64-bit hashes: two bits in a block of 64."""

    def __init__(self, blocks: int):
        self.bits = np.zeros(blocks, np.uint64)

    @staticmethod
    def size(keys: int) -> int:
        """Blocks for that many keys, a power of two: 16 bits a key, BLOOM_BYTES at most."""
        return min(BLOOM_BYTES // 8, 1 << max(4, (max(keys, 1) * 16 // 64 - 1).bit_length()))

    @staticmethod
    def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, its two bits) of each hash."""
        one = np.uint64(1)
        return (h & np.uint64(blocks - 1)).astype(np.int64), one << (h >> np.uint64(58)) | one << (h >> np.uint64(52) & np.uint64(63))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        block, own = self.places(h, len(self.bits))
        return self.bits[block] & own == own


def _filter_of(records: DataFrame) -> Bloom:
    """The filter of all windows' shingles: a block a row is collected, BLOOM_BYTES of them at most."""
    keys = records.select(F.explode("hashes").alias("h"))
    bloom = Bloom(Bloom.size(keys.count()))
    blocks = len(bloom.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, own = Bloom.places(batch.column(0).to_numpy().view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(own.view(np.int64))], ["block", "bits"])

    got = keys.mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom.bits[got.column("block").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bloom


_RUN = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("words", pa.string()), ("hashes", pa.list_(pa.int64()))])
_COUNT = pa.struct([("h", pa.int64()), ("c", pa.int64())])


def _possible(docs: DataFrame, bloom: Bloom, sizes: list[int], text_col: str) -> DataFrame:
    """docs without the text column and: n_words; runs, ranges of words in which windows of n words may occur, with their shingles' hashes; counts of the shingles that pass the filter, one list a batch."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)
    place = docs.columns.index(text_col)
    kept = [f for f in docs.schema.fields if not f.name.startswith("_text")]

    def found(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, rolling: vec.Rolling) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(text of each run, runs, counts) of a batch's words."""
        bloom, texts, at, of_n, words, lists, seen = sent.value, [], [], [], [], [], []
        for n in sizes:
            s = min(n, SHINGLE)
            need, h = n - s + 1, _shingles(rolling, n)
            if not len(h):
                continue
            inside = np.ones(len(h), bool)  # shingles that lie in one text
            for k in range(1, s):
                inside[first[1:-1][(first[1:-1] >= k) & (first[1:-1] - k < len(h))] - k] = False
            hit = inside & bloom.may_hold(h)
            seen.append(h[hit])
            total = np.concatenate([[0], np.cumsum(hit)])
            begin = np.flatnonzero(total[need:] - total[:-need] == need)
            text = np.searchsorted(first, begin, "right") - 1
            begin = begin[begin + n <= first[text + 1]]  # the window lies in its text
            edge = np.bincount(begin, minlength=len(h) + 1) - np.bincount(begin + need, minlength=len(h) + 1)[: len(h) + 1]
            covered = np.cumsum(edge) > 0
            cut = np.zeros(len(h) + 1, bool)
            cut[first[first <= len(h)]] = True
            low = np.flatnonzero(covered & (cut | ~np.concatenate([[False], covered[:-1]])))
            high = np.flatnonzero(np.concatenate([[False], covered[:-1]]) & (cut | ~covered))
            for a, b in zip(low.tolist(), high.tolist()):
                t = int(np.searchsorted(first, a, "right")) - 1
                texts.append(t)
                at.append(a - int(first[t]))
                of_n.append(n)
                words.append(_joined(raw, starts, ends, a, b + s - 1))
                lists.append(h[a:b].view(np.int64))
        keys, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(np.array(texts, np.int64), kind="stable")
        pick = lambda x: [x[i] for i in order]
        runs = pa.StructArray.from_arrays([pa.array(pick(at), pa.int32()), pa.array(pick(of_n), pa.int32()), pa.array(pick(words), pa.string()), pa.array(pick(lists), pa.list_(pa.int64()))], fields=list(_RUN))
        return np.array(texts, np.int64)[order], runs, pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], fields=list(_COUNT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, raw, starts, ends, first, rolling in _words(batch.column(place)):
                texts, runs, counts = found(raw, starts, ends, first, rolling)
                part = batch.slice(row, n)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(n + 1)), pa.int32()), runs)
                once = pa.ListArray.from_arrays(pa.array(np.where(np.arange(n + 1) > 0, len(counts), 0), pa.int32()), counts)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(np.diff(first)), lists, once], [*(f.name for f in kept), "n_words", "runs", "counts"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.mapInArrow(run, fields + "n_words long, runs array<struct<at:int,n:int,words:string,hashes:array<long>>>, counts array<struct<h:long,c:long>>")


def _prefixes(records: DataFrame, counts: DataFrame) -> DataFrame:
    """(record, words, n, h, p): every record whose shingles all occur in documents, with the rarest one and its place."""
    single = records.groupBy("words").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    each = single.select("words", "n", F.posexplode("hashes").alias("p", "h")).join(counts, "h")
    least = each.groupBy("words", "n").agg(F.min(F.struct("c", "h", "p")).alias("m"), F.count(F.lit(1)).alias("k"))
    whole = least.where(F.col("k") == F.col("n") - F.least("n", F.lit(SHINGLE)) + 1)
    return scratch.stored(whole.select(F.monotonically_increasing_id().alias("record"), "words", "n", "m.h", "m.p"), "prefixes")


def occurrences(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(_row, start, stop, record): where the records occur, verified on the words."""
    runs = found.where(F.size("runs") > 0).select("_row", F.inline("runs")).withColumn("w", F.split("words", " "))
    back = F.col("n") - F.least("n", F.lit(SHINGLE))  # words that a window may begin before a shingle of it

    def around(h: Column, i: Column) -> Column:
        low = F.greatest(i - back, F.lit(0))
        return F.struct(h.alias("h"), i.alias("i"), (i - low).alias("before"), F.slice("w", low + 1, i - low + F.col("n")).alias("near"))

    hits = runs.select("_row", "at", "n", F.inline(F.transform("hashes", around)))
    size = prefixes.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    own = prefixes.withColumnsRenamed({"n": "_n", "h": "_h"})
    same = (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n"))
    if size <= BROADCAST_BYTES:
        met = hits.join(F.broadcast(own), same)
    else:
        own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = hits.withColumn("part", F.pmod(F.xxhash64("_row", "i"), F.lit(SALT)).cast("int")).join(own, same & (F.col("part") == F.col("_part")))
    # positional bound: the window begins in the run; length bound: it ends there
    met = met.where((F.col("before") >= F.col("p")) & (F.col("before") - F.col("p") + F.col("n") <= F.size("near")))
    met = met.where(F.array_join(F.slice("near", F.col("before") - F.col("p") + 1, F.col("n")), " ") == F.col("words"))
    start = F.col("at") + F.col("i") - F.col("p")
    return scratch.stored(met.select("_row", start.alias("start"), (start + F.col("n")).alias("stop"), "record"), "occurrences")


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """docs without columns that begin with _text and: _row, n_words, n_hit, hit_spans, item_ids. The columns of docs must not clash."""
    records = scratch.stored(windows(benchmark, window, item_col, item_text), "windows")
    sizes = sorted(x["n"] for x in records.select("n").distinct().collect())  # window of them at most
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    found = scratch.stored(_possible(numbered, _filter_of(records), sizes, text_col), "possible")
    counts = found.where(F.size("counts") > 0).select(F.inline("counts")).groupBy("h").agg(F.sum("c").alias("c"))
    prefixes = _prefixes(records, counts)
    hits = occurrences(found, prefixes)
    order = Window.partitionBy("_row").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("_row", "start", "stop").distinct().withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_row", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    # lists of one document's spans and items
    spans = spans.groupBy("_row").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("hit_spans"))
    owners = records.join(prefixes.select("record", "words"), "words").select("record", "item").distinct()
    items = hits.select("_row", "record").join(owners, "record").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = spans.join(items, "_row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(told.schema[c].dataType))
    return found.drop("runs", "counts").join(told, "_row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "hit_spans": none("hit_spans"), "item_ids": none("item_ids")})


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of docs and: n_words, n_hit (words inside an occurrence), hit_spans (merged word ranges), item_ids (items with occurrences, ascending, distinct).

    Input columns with these four names are replaced.
    """
    kept = [c for c in docs.columns if c not in _ADDED]
    plain, (body,) = scratch.numbered(docs.select(*kept), text_col)
    found = _searched(plain, benchmark, window, body, item_col, item_text)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *_ADDED)


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, min_words: int = 8, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, with all their columns, without those that hold a benchmark passage: with a hit range of min_words words or more, or occurrences of min_items items, a document goes."""
    plain, (body,) = scratch.numbered(docs, text_col)
    found = _searched(plain, benchmark, window, body, item_col, item_text)
    passage = F.exists("hit_spans", lambda x: x["stop"] - x["start"] >= min_words)
    return found.where(~passage & (F.size("item_ids") < min_items)).select(*plain.columns).toDF(*docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which words of which documents occur in windows of 8 words of benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("_text"))
    found = _searched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 8, "_text", "item_id", "text")
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    n_items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, rn, w, pos FROM (SELECT doc_id, rn, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM
  (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents))),
bench AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 8) AS n, list_aggregate(ws[i + 1 : i + 8], 'string_agg', ' ') AS gram FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 7, 1))) AS i FROM bench WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dl AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
grams AS (SELECT doc_id, rn, n, i, list_aggregate(ws[i + 1 : i + n], 'string_agg', ' ') AS gram FROM (SELECT doc_id, rn, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS i FROM dl, sizes)),
hits AS (SELECT g.doc_id, g.rn, g.i, g.n, w.item_id FROM grams g JOIN win w ON g.n = w.n AND g.gram = w.gram),
hw AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rn),
it AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY rn)
SELECT dl.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dl LEFT JOIN hw USING (rn) LEFT JOIN it USING (rn)
"""

"""Removal of long repeated word passages by De Bruijn compaction.

A window of k consecutive words is an edge of the De Bruijn graph of the
corpus; the windows of a document are a path.  An edge that occurs twice is a
repeated window.  One row per edge would be one row per word, so paths are
compacted where they arise: consecutive edges that share the same minimizer
(the least hash of their m-word pieces, at one place) make one segment, with
the minimizer as its key and a hash of its words as its content.  Equal windows
have equal minimizers, so repeated edges can only lie in segments whose
minimizer occurs again, which a Spark join finds:

* a minimizer that occurs once: its edges are unique;
* the words of all other segments are read again at their source coordinates
  (shard, row, word) and get a 128-bit digest: segments of equal digests are
  verified repeats as a whole, a nonbranching path with one row per occurrence;
* where a minimizer has several contents the path branches: the edges of each
  content are digested one by one, again from the source, and joined.

A path that runs round a cycle (words or phrases repeated one after another)
gives the same segment again and again; such a run is one row with the number
of its rounds, so a hot cycle costs a row per run and not one per round.

Source coordinates lead into a copy of the texts in the shared folder, a shard a
file.  Segments and spans go to the task of their shard, which reads it, so
texts are never shuffled.  Counts
are combined before each shuffle, joins on a frequent minimizer are split by
adaptive execution, and no group is gathered.

Edge cases: null or empty text has no words and stays without; texts shorter
than a window keep all words; repeated rows are separate occurrences of their
windows, so all their words go (if they have a window); null ids stay null; an
empty table gives no rows; input columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import ship
from . import scratch, vec

_RESULTS = {"n_words": "long", "n_removed": "long", "kept_text": "string"}
#: The lower half of a 64-bit word holds a place, the upper half decides which hash is least.
_PLACE = np.uint64(0xFFFFFFFF)


def segments(h: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, rounds, minimizer) of the segments of a batch's word hashes.

    Equal segments one after another are one row: windows are those of one round.
    """
    counts = np.maximum(np.diff(first) - k + 1, 0)
    at = vec.ragged(first[:-1], counts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    rolling = vec.Rolling(h)
    pieces = rolling.windows(m)
    least = vec.sliding_min((pieces & ~_PLACE) | np.arange(len(pieces), dtype=np.uint64), k - m + 1)
    chosen = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    start = at[head]
    document = np.searchsorted(first, start, "right") - 1
    key, content = pieces[chosen[head]], rolling.spans(start, start + size + k - 1)
    other = np.ones(len(head), bool)  # a document's segments follow one another without a gap
    other[1:] = (document[1:] != document[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])
    run = np.flatnonzero(other)
    rounds = np.diff(np.append(run, len(head)))
    return document[run], start[run] - first[document[run]], size[run], rounds, key[run]


def _shard_batches(uri: str, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    fs, path = scratch.open_fs(uri)
    with fs.open_input_file(path) as f:
        yield from pq.ParquetFile(f).iter_batches(batch_size=512, columns=columns)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by their first column, shard by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != shard[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _reread(batches: Iterator[pa.RecordBatch], names: list[str], text_col: str) -> Iterator[tuple[pa.Table, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """For pieces of the texts that rows (shard, row, ...; sorted) lead to: (those rows, the first word of each one's text, the words joined by one space, where each begins and ends)."""
    for shard, wanted in _by_shard(batches):
        of, base = wanted.column("row").to_numpy(), 0
        for texts in _shard_batches(names[shard], [text_col]):
            a, b = np.searchsorted(of, [base, base + texts.num_rows])
            rows, local = np.unique(of[a:b] - base, return_inverse=True)
            base += texts.num_rows
            if a == b:
                continue
            for row, n, data, offsets in vec.text_batches(texts.column(0).take(pa.array(rows))):
                starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
                raw, begin, end = vec.spaced(data, starts, ends)
                p, q = np.searchsorted(local, [row, row + n])
                yield wanted.slice(a + p, q - p), first[local[p:q] - row], raw.tobytes(), begin, end


def _digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """128 bits of each byte range, as two columns."""
    found = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())])
    halves = np.frombuffer(found, np.int64).reshape(-1, 2)
    return [pa.array(halves[:, 0]), pa.array(halves[:, 1])]


def _by_source(df: DataFrame, shards: int) -> DataFrame:
    """Every shard's rows in one task, sorted."""
    return df.repartitionById(max(shards, 1), F.col("shard")).sortWithinPartitions("shard", "row", "start")


def repeated_spans(spark, names, window: int, piece: int, text_col: str) -> DataFrame:
    """(shard, row, start, n): runs of n repeated windows, by source coordinates."""
    shards = len(names.value)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                base = 0
                for texts in _shard_batches(names.value[shard], [text_col]):
                    for row, n, data, offsets in vec.text_batches(texts.column(0)):
                        starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
                        document, start, size, rounds, key = segments(vec.hash_words(data, starts, ends), first, window, piece)
                        columns = [pa.array(np.full(len(start), shard, np.int32)), pa.array((document + base + row).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(rounds.astype(np.int32)), _long(key)]
                        yield pa.RecordBatch.from_arrays(columns, ["shard", "row", "start", "n", "rounds", "key"])
                    base += texts.num_rows

    numbers = spark.range(0, shards, 1, max(shards, 1))
    cuts = scratch.stored(numbers.mapInArrow(cut, "shard int, row int, start int, n int, rounds int, key long"), "segments")
    # keys to be joined are stored, so that both sides of a join are plain shuffles, which adaptive execution splits at a frequent key
    again = scratch.stored(cuts.groupBy("key").agg(F.sum("rounds").alias("c")).where("c > 1").select("key"), "again")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, raw, begin, end in _reread(batches, names.value, text_col):
            a = at + part.column("start").to_numpy()
            digests = _digests(raw, begin[a], end[a + part.column("n").to_numpy() + window - 2])
            yield pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in part.columns), *digests], [*part.schema.names, "d1", "d2"])

    met = _by_source(cuts.join(again, "key", "left_semi").select(*cuts.columns), shards)
    met = scratch.stored(met.mapInArrow(verify, "shard int, row int, start int, n int, rounds int, key long, d1 long, d2 long"), "repeated")
    scratch.release(cuts)
    contents = met.groupBy("key", "d1", "d2").agg(F.sum("rounds").alias("c"), F.min(F.struct("shard", "row", "start", "n")).alias("at"))
    contents = scratch.stored(contents, "contents")
    branching = scratch.stored(contents.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "branching")
    lone = contents.where("c = 1").select("key", "d1", "d2")  # contents of which no other segment is a repeat as a whole
    whole = met.join(lone, ["key", "d1", "d2"], "left_anti")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, raw, begin, end in _reread(batches, names.value, text_col):
            shard, row, start, size, key, c = (part.column(x).to_numpy() for x in ("shard", "row", "start", "n", "key", "c"))
            place = vec.ragged(start.astype(np.int64), size.astype(np.int64))
            of = np.repeat(np.arange(len(start)), size)
            for i in range(0, len(of), 1 << 18):
                one, where = of[i : i + (1 << 18)], place[i : i + (1 << 18)]
                a = at[one] + where
                columns = [pa.array(key[one]), *_digests(raw, begin[a], end[a + window - 1]), pa.array(shard[one]), pa.array(row[one]), pa.array(where.astype(np.int32)), pa.array(c[one])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "d1", "d2", "shard", "row", "start", "c"])

    wanted = contents.join(branching, "key", "left_semi").select("at.shard", "at.row", "at.start", "at.n", "key", "c")
    edges = scratch.stored(_by_source(wanted, shards).mapInArrow(expand, "key long, d1 long, d2 long, shard int, row int, start int, c long"), "edges")
    twice = edges.groupBy("key", "d1", "d2").agg(F.sum("c").alias("k")).where("k > 1").select("key", "d1", "d2")
    single = edges.where("c = 1").join(twice, ["key", "d1", "d2"], "left_semi").select("shard", "row", "start", F.lit(1).alias("n"))
    return whole.select("shard", "row", "start", (F.col("n") * F.col("rounds")).alias("n")).union(single)


def remove_repeats(docs: DataFrame, window: int = 35, piece: int = 10, text_col: str = "text") -> DataFrame:
    """All columns of docs and: n_words, n_removed, kept_text (the kept words joined by one space).

    A word is removed if a window of that many words covers it whose word
    sequence also starts anywhere else.
    """
    kept = [c for c in docs.columns if c not in _RESULTS]
    plain, (body,) = scratch.numbered(docs.select(*kept), text_col)
    return _removed(plain, window, piece, body).toDF(*kept, *_RESULTS)


def _removed(docs: DataFrame, window: int, piece: int, text_col: str) -> DataFrame:
    """remove_repeats of docs whose columns don't clash with the results."""
    spark = docs.sparkSession
    ship(spark)
    copy = scratch.folder(spark, "texts") + "/table"
    docs.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(copy)
    found = scratch.files(spark, copy, ".parquet")
    names = spark.sparkContext.broadcast(found)
    spans = repeated_spans(spark, names, window, piece, text_col)
    stubs = spark.range(len(found)).select(F.col("id").cast("int").alias("shard"), F.lit(-1).alias("row"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    back = _by_source(spans.union(stubs), len(found))
    target = to_arrow_schema(docs.schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in _by_shard(batches):
            of, start, size = (own.column(x).to_numpy() for x in ("row", "start", "n"))
            base = 0
            for batch in _shard_batches(names.value[shard], None):
                text = batch.schema.get_field_index(text_col)
                for row, n, data, offsets in vec.text_batches(batch.column(text)):
                    starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
                    a, b = np.searchsorted(of, [base + row, base + row + n])
                    begin = first[of[a:b] - base - row] + start[a:b]
                    edge = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(begin + size[a:b] + window - 1, minlength=len(starts) + 1)
                    kept = np.flatnonzero(np.cumsum(edge[: len(starts)]) == 0)
                    left = np.searchsorted(kept, first)
                    part = batch.slice(row, n)
                    columns = [part.column(f.name).cast(f.type) for f in target]
                    columns += [pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(left)), _joined(data, starts[kept], ends[kept], left)]
                    yield pa.RecordBatch.from_arrays(columns, [*target.names, *_RESULTS])
                base += batch.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return back.mapInArrow(remove, fields + "".join(f", {k} {v}" for k, v in _RESULTS.items()))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each text's words joined by one space."""
    size = ends - starts + 1
    size[first[1:][np.diff(first) > 0] - 1] -= 1  # no space after a text's last word
    stop = np.cumsum(size)
    out = np.append(data, np.uint8(32))[vec.ragged(starts, size)]
    spaced = size > ends - starts
    out[stop[spaced] - 1] = 32
    at = np.concatenate([[0], stop])[first].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(at), pa.py_buffer(out)])


def without_repeats(docs: DataFrame, window: int = 35, piece: int = 10, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, with all their columns, with repeated passages removed from their texts; texts without any stay as they are, documents of which nothing is left go."""
    plain, (body,) = scratch.numbered(docs, text_col)
    found = _removed(plain, window, piece, body)
    cut = F.col("n_removed") > 0
    out = found.where(~cut | (F.col("n_removed") < F.col("n_words")))
    out = out.withColumn(body, F.when(cut, F.col("kept_text")).otherwise(F.col(body)))
    if chars_col in docs.columns:
        chars = f"c{docs.columns.index(chars_col)}"
        out = out.withColumn(chars, F.when(cut, F.length(body).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars)))
    return out.select(*plain.columns).toDF(*docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the words that windows of 35 words found elsewhere cover."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rn, i, hash(list_aggregate(ws[i + 1 : i + 35], 'string_agg', ' ')) AS gram FROM (SELECT rn, ws, unnest(range(greatest(len(ws) - 34, 0))) AS i FROM d)),
r AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
hit AS (SELECT DISTINCT rn, p FROM (SELECT rn, unnest(range(i, i + 35)) AS p FROM g JOIN r USING (gram))),
w AS (SELECT rn, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
k AS (SELECT w.rn, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM w ANTI JOIN hit ON w.rn = hit.rn AND w.p = hit.p GROUP BY w.rn)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rn)
"""

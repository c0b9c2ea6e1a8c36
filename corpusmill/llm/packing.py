"""Best-fit packing of documents into training sequences.

Bounded-space online best-fit: a task reads its partition as a stream, keeps a
fixed number of open sequences, and puts each piece into the open sequence that
it fills most.  Open sequences are found through a bitset keyed by free space,
so a placement costs one bit search, whatever the number of open sequences.
When a piece fits none and all places are taken, the fullest closes first.  No
shuffle: each task packs what it reads, and its memory holds a batch of texts
and the open sequences' free space.  What is left open at a task's end is what
more tasks cost; so small input partitions are read together, TASK_BYTES of
files a task, and the layout of the files hardly matters.

Edge cases: null or empty text gives one piece that holds the end id alone; ids
of any type are passed on and a null id stays null; repeated rows are packed once each; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import tokens, vec

#: Bytes of input files that a task packs at least, if there are so many: a thousand sequences or more.
TASK_BYTES = 4 << 20


class OpenBins:
    """Open sequences by free space. place() gives the sequence and the offset of a piece."""

    def __init__(self, capacity: int, most: int, first_number: int = 0):
        self.capacity, self.most, self.next = capacity, most, first_number
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = 0

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - space


def together(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """docs in partitions of about task_bytes or more by Spark's estimate, without a shuffle."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.coalesce(max(1, min(-(-size // task_bytes), 1 << 30)))


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, open_bins: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document's ids are the tokenizer's, then end_id; only documents of more
    than max_tokens ids are cut.  A sequence_id names the task's partition in
    its upper bits, so a repeated task gives the same rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        bins = OpenBins(max_tokens, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for row, n, data, offsets in vec.text_batches(batch.column(1)):
                ids, first = encoder.encode(data, offsets)
                # the end id goes after each document's ids
                begin = first + np.arange(n + 1)
                flat = np.full(len(ids) + n, end_id, "<u4")
                own = np.ones(len(flat), bool)
                own[begin[1:] - 1] = False
                flat[own] = ids
                total = np.diff(begin)
                pieces = -(-total // max_tokens)
                number = vec.ragged(np.zeros(n, np.int64), pieces)
                of = np.repeat(np.arange(n), pieces)
                start = number * max_tokens
                length = np.minimum(total[of] - start, max_tokens)
                placed = np.array([bins.place(x) for x in length.tolist()], np.int64).reshape(-1, 2)
                ends = np.append(begin[of] + start, len(flat)) * 4
                binary = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                names = batch.column(0).slice(row, n).take(pa.array(of))
                columns = [names, pa.array(number, pa.int32()), pa.array(start), pa.array(length), binary, pa.array(placed[:, 0]), pa.array(placed[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return together(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, fields)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens of the word-level BPE tokenizer."""
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

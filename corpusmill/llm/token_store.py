"""Token ids in binary shards with constant-time access by document key.

A shard file holds, in ascending key order, the raw ids of its documents (2
bytes each if the vocabulary allows, else 4, little-endian), then the index:

    payload | offsets u64[n+1] | keys i64[n] | key is null u8[n]
    | level bits u64[...] | bits set before each u32[...]
    | slot -> document u32[k] | slot -> fingerprint u32[k]
    | footer JSON | footer length u32 | magic

The index is a minimal perfect hash of the distinct keys (levels of bit
vectors: a key alone on its bit gets the bit's rank as its slot, the others go
to the next level).  A slot stores the key's fingerprint, which refuses an
absent key but for one chance in 2**32 (the stored key then does), and the
first of the key's documents; repeated keys lie side by side.  Access by key
reads a few numbers by range, whatever the shard's size.  ``manifest.json`` lists the shards with key
ranges and the ids before each, so a reader opens one shard for a key.

Edge cases: null text is empty (the end id alone); documents with a null key
come first and can be read in order, not by key; equal keys keep one entry
each, ordered by a hash of the text; an empty table gives a manifest without
shards; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from . import scratch, tokens, vec

MAGIC = b"CMTOKEN1"
_LEVELS = 64


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return vec.mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 1000) >> np.uint64(32)).astype("<u4")


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(words of 64 bits of each level, all levels' words, slot of each key) for distinct keys."""
    sizes, words, slots, done = [], [], np.zeros(len(keys), np.int64), 0
    rest = np.arange(len(keys))
    for level in range(_LEVELS):
        if not len(rest):
            break
        size = -(-2 * len(rest) // 64)
        at = (_level_hash(keys[rest], level) % np.uint64(size * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=size * 64) == 1
        mine = alone[at]
        slots[rest[mine]] = done + (np.cumsum(alone) - 1)[at[mine]]
        done += int(mine.sum())
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        rest = rest[~mine]
    if len(rest):
        raise ValueError("keys must be distinct")
    return sizes, np.concatenate(words) if words else np.zeros(0, "<u8"), slots


class Shard:
    """Reads one shard: single keys by range, all of them with the index in memory."""

    def __init__(self, uri: str):
        fs, path = scratch.open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(12, end - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        length = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(self.file.read_at(length, end - 12 - length))
        self.loaded: dict[str, np.ndarray] = {}

    def section(self, name: str) -> np.ndarray:
        """A whole section of the index."""
        if name not in self.loaded:
            at, size, kind = self.meta[name]
            self.loaded[name] = np.frombuffer(self.file.read_at(size, at), kind)
        return self.loaded[name]

    def number(self, name: str, i: int, n: int = 1) -> list[int]:
        """n numbers of a section from place i on, read by range."""
        at, size, kind = self.meta[name]
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(min(n * width, size - i * width), at + i * width), kind).tolist()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        words, ranks = self.section("levels"), self.section("ranks").astype(np.int64)
        out, rest, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.meta["sizes"]):
            if not len(rest):
                break
            bit = (_level_hash(keys[rest], level) % np.uint64(size * 64)).astype(np.int64)
            word, place = base + bit // 64, (bit % 64).astype(np.uint64)
            found = words[word]
            hit = (found >> place & np.uint64(1)).astype(bool)
            below = found & ((np.uint64(1) << place) - np.uint64(1))
            out[rest[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            rest, base = rest[~hit], base + size
        return out

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, or -1, by the index: slot, fingerprint and document."""
        out, at, prints = np.full(len(keys), -1, np.int64), self.slots(keys), self.section("prints")
        known = np.flatnonzero((at >= 0) & (at < len(prints)))
        known = known[prints[at[known]] == _fingerprint(keys[known])]
        out[known] = self.section("document")[at[known]]
        return out

    def slot(self, key: int) -> int:
        """The slot of one key, or -1, by one word of each level that is tried."""
        one, base = np.array([key], np.int64), 0
        for level, size in enumerate(self.meta["sizes"]):
            bit = int(_level_hash(one, level)[0]) % (size * 64)
            (word,) = self.number("levels", base + bit // 64)
            if word >> bit % 64 & 1:
                return self.number("ranks", base + bit // 64)[0] + (word & (1 << bit % 64) - 1).bit_count()
            base += size
        return -1

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first .. last-1."""
        kind = np.dtype(self.meta["dtype"])
        (a,), (b,) = ((self.section("offsets")[i : i + 1].tolist() if "offsets" in self.loaded else self.number("offsets", i)) for i in (first, last))
        return np.frombuffer(self.file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with that key."""
        slot = self.slot(key)
        if slot < 0 or self.number("prints", slot) != _fingerprint(np.array([key], np.int64)).tolist():
            return []
        (first,), last = self.number("document", slot), -1
        out: list[np.ndarray] = []
        while last < 0:
            at = first + len(out)
            near = self.number("keys", at, 16)
            same = next((i for i, x in enumerate(near) if x != key), len(near))
            last = at + same if same < 16 else -1
            out += [self.ids(i, i + 1) for i in range(at, at + same)]
        return out


class TokenStore:
    """Keyed access to all shards of a folder."""

    def __init__(self, folder: str):
        fs, path = scratch.open_fs(f"{folder}/manifest.json")
        with fs.open_input_stream(path) as f:
            self.manifest = json.loads(f.read())
        self.folder, self.keyed, self.opened = folder, [x for x in self.manifest if x["last"] is not None], {}

    def get(self, key: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        i = bisect.bisect_left([x["last"] for x in self.keyed], key)
        while i < len(self.keyed) and self.keyed[i]["first"] <= key:
            name = self.keyed[i]["name"]
            if name not in self.opened:
                self.opened[name] = Shard(f"{self.folder}/{name}")
            out += self.opened[name].get(key)
            i += 1
        return out


def _finish(out, position: int, dtype: str, lengths: list[np.ndarray], keys: list[pa.Array]) -> tuple[int, int, int | None, int | None]:
    """Writes the index; (documents, ids, least key, largest key)."""
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
    column = pa.chunked_array(keys).combine_chunks()
    null = np.asarray(column.is_null()).astype(np.uint8)
    values = np.asarray(column.fill_null(0)).astype("<i8")
    real = np.flatnonzero(null == 0)
    new = real[np.concatenate([[True], np.diff(values[real]) != 0])] if len(real) else real
    sizes, words, slots = build_mph(values[new])
    document, prints = np.zeros(len(new), "<u4"), np.zeros(len(new), "<u4")
    document[slots], prints[slots] = new, _fingerprint(values[new])
    ones = np.bitwise_count(words).astype("<u4")
    meta: dict = {"dtype": dtype, "sizes": sizes}
    pad = -position % 8
    out.write(b"\0" * pad)
    position += pad
    for name, part in (("offsets", offsets), ("keys", values), ("null", null), ("levels", words), ("ranks", np.cumsum(ones, dtype="<u4") - ones), ("document", document), ("prints", prints)):
        meta[name] = [position, part.nbytes, part.dtype.str]
        out.write(part.tobytes())
        position += part.nbytes
    footer = json.dumps(meta).encode()
    out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
    return len(values), int(offsets[-1]), int(values[real[0]]) if len(real) else None, int(values[real[-1]]) if len(real) else None


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes shards and manifest.json to folder; returns the manifest, one entry a shard.

    Documents are dealt by ranges of the key (equal keys further by a hash of
    the text, so that one key can't fill a task) and sorted; shard files appear
    under their final name when whole, and a repeated task writes the same.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        dtype = "<u2" if max(encoder.size, end_id + 1) <= 65536 else "<u4"
        batches = (x for x in batches if x.num_rows)
        head = next(batches, None)
        if head is None:
            return
        number = TaskContext.get().partitionId()
        name, position, lengths, keys = f"shard-{number:06d}.ids", 0, [], []
        with scratch.written_whole(f"{folder}/{name}") as out:
            for batch in (b for part in ([head], batches) for b in part):
                for row, n, data, offsets in vec.text_batches(batch.column(1)):
                    ids, first = encoder.encode(data, offsets)
                    begin = first + np.arange(n + 1)
                    flat = np.full(len(ids) + n, end_id, dtype)
                    own = np.ones(len(flat), bool)
                    own[begin[1:] - 1] = False
                    flat[own] = ids
                    out.write(flat.tobytes())
                    position += flat.nbytes
                    lengths.append(np.diff(begin))
                    keys.append(batch.column(0).slice(row, n))
            documents, total, least, most = _finish(out, position, dtype, lengths, keys)
        yield pa.RecordBatch.from_pylist([{"number": number, "name": name, "documents": documents, "ids": total, "first": least, "last": most}], schema=entry)

    entry = pa.schema([("number", pa.int64()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    found = rows.mapInArrow(run, "number long, name string, documents long, ids long, first long, last long").collect()
    manifest, before = [], 0
    for x in sorted(found, key=lambda x: x["number"]):
        manifest.append({"name": x["name"], "documents": x["documents"], "ids": x["ids"], "first": x["first"], "last": x["last"], "before": before})
        before += x["ids"]
    with scratch.written_whole(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict], block: int = 4 << 20) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    Every key is looked up in its shard's index; one that doesn't lead to the
    key's first document is an error.
    """
    ship(spark)
    entries = spark.sparkContext.broadcast(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                entry = entries.value[i]
                shard = Shard(f"{folder}/{entry['name']}")
                bounds, keys, null = shard.section("offsets").astype(np.int64), shard.section("keys"), shard.section("null")
                n, real = len(keys), np.flatnonzero(null == 0)
                new = real[np.diff(keys[real], prepend=~keys[real[:1]]) != 0]
                wrong = np.flatnonzero(shard.first(keys[new]) != new)
                if len(wrong) or len(new) != len(shard.section("document")):
                    raise ValueError(f"{entry['name']}: the index doesn't lead to {len(wrong)} of {len(new)} keys")
                row = 0
                while row < n:
                    stop = min(n, max(row + 1, int(np.searchsorted(bounds, bounds[row] + block, "right")) - 1))
                    flat = shard.ids(row, stop).astype("<u4")
                    ends = ((bounds[row : stop + 1] - bounds[row]) * 4).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                    names = pa.array(keys[row:stop], mask=null[row:stop].astype(bool))
                    start = bounds[row:stop] + entry["before"]
                    yield pa.RecordBatch.from_arrays([names, pa.array(start), pa.array(np.diff(bounds[row : stop + 1])), binary], ["doc_id", "start", "n_tokens", "ids"])
                    row = stop

    n = len(manifest)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    """Writes the byte-level BPE ids of all documents and reads the shards back."""
    import public_tokenizers

    folder = scratch.folder(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

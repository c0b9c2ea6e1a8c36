"""SimHash near-duplicate groups by pivot distance tables.

A fingerprint's distances to a set of reference fingerprints bound its distance
to any other: |d(x, p) - d(y, p)| <= d(x, y).  The table of a fingerprint is
computed once and stored: its distances to REFERENCES pseudo-random references,
and for each of 64 references of a single bit how its distance to that differs
from its distance to zero.  Pairs whose tables differ by more than the radius
in any coordinate are discarded; the survivors are verified by their exact
Hamming distance.

Pairs are met without a cross join: the single-bit coordinates of two
fingerprints within the radius differ in as many places as the fingerprints do,
so in some blocks of coordinates the tables are equal (with 5 blocks and radius
3, in two).  Equal blocks of stored coordinates are the key of a cell, in which
the tables' distances to the pseudo-random references thin out the pairs.  A
cell of more than CELL fingerprints is split into sub-cells such that every
pair still meets in one, so no task gathers a large cell.  A task returns links
as stars, at most one row for each fingerprint and cell, and components come
from rounds of large-star and small-star over tables in the shared folder.

Edge cases: null or empty text has fingerprint zero, linked like any other; a
null id is kept and takes part, but never names a component (component_id is
null if all ids of a component are); equal fingerprints are one node, so
repeated rows cost nothing; an empty table gives no rows; other columns are
ignored by near_duplicates and passed on by one_of_each, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import scratch, vec

#: Fingerprints of a cell that one task compares; larger cells are split.
CELL = 4096
#: Links in a file of the tables between rounds of components (16 bytes each); a round sizes its table by the one before, which is at least half as large.
LINKS_A_FILE = 1_000_000
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Pseudo-random references, a byte of a pivot table each.
REFERENCES = 16
_RANDOM = vec.mix(np.arange(1, REFERENCES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SINGLE = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Bit i of a byte in byte i of a 64-bit word: adds eight counters at once.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of byte ranges of data."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + _P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            stripes = length[long] // 32
            v = [np.full(len(long), x, np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            for s in range(int(stripes.max())):
                on = np.flatnonzero(stripes > s)
                at = start[long[on]] + 32 * s
                for k in range(4):
                    v[k][on] = _round(v[k][on], eight[at + 8 * k])
            merged = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                merged = (merged ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            h[long] = merged
        h += length.astype(np.uint64)
        at, rest = start + length // 32 * 32, length % 32
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), eight[at[on] + 8 * k]), 27) * _P1 + _P4
        at, rest = at + rest // 8 * 8, rest % 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ four[at[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at, rest = at + rest // 4 * 4, rest % 4
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _rotl(h[on] ^ data[at[on] + k].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Fingerprints of the texts of a batch."""
    data = vec.lower(data)
    starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
    n, counts = len(offsets) - 1, np.diff(first)
    if not len(starts):
        return np.zeros(n, np.uint64)
    spaced, begin, end = vec.spaced(data, starts, ends)
    many = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    head = vec.ragged(first[:-1], many)
    tail = np.minimum(head + shingle - 1, np.repeat(first[1:] - 1, many))
    start = begin[head]
    h = xxh64(spaced, start, end[tail] - start)
    # counts of set bits, in blocks of at most 255 shingles
    at = np.cumsum(many) - many
    blocks = -(-many // 255)
    block_at = np.repeat(at, blocks) + vec.ragged(np.zeros(n, np.int64), blocks) * 255
    full = np.flatnonzero(many)
    doc_block = (np.cumsum(blocks) - blocks)[full]
    octets, bits = h.view(np.uint8).reshape(-1, 8), np.zeros((n, 64), bool)
    for k in range(8):
        part = np.add.reduceat(_SPREAD[octets[:, k]], block_at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(part.astype(np.int64), doc_block, axis=0)
        bits[full, 8 * k : 8 * k + 8] = 2 * ones > many[full, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, the columns more, and fp: the fingerprint's 64 bits as a long."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *more)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, offsets in vec.text_batches(batch.column(0)):
                part = batch.slice(row, n)
                fp = pa.array(fingerprints_of(data, offsets, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], fp], [*part.schema.names[1:], "fp"])

    return chosen.mapInArrow(run, fields + ", fp long")


def pivot_tables(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([n, 64] distances to the single-bit references less that to zero, plus 1; [n, REFERENCES] distances to the pseudo-random ones)."""
    near = np.bitwise_count(fp[:, None] ^ _SINGLE).astype(np.int16) - np.bitwise_count(fp)[:, None] + 1
    return near.astype(np.uint8), np.bitwise_count(fp[:, None] ^ _RANDOM)


def pivots(nodes: DataFrame) -> DataFrame:
    """nodes (column fp, distinct) with their pivot tables, stored: near (64 bytes) and far (REFERENCES bytes in longs)."""
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            near, far = pivot_tables(batch.column("fp").to_numpy().view(np.uint64))
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(64)), pa.py_buffer(np.ascontiguousarray(near))])
            longs = np.ascontiguousarray(far).view(np.int64).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, binary, *(pa.array(longs[:, i]) for i in range(longs.shape[1]))], [*batch.schema.names, "near", *_FAR])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return scratch.stored(nodes.mapInArrow(run, f"{fields}, near binary, " + ", ".join(f"{x} long" for x in _FAR)), "pivots")


_FAR = [f"far{i}" for i in range(REFERENCES // 8)]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links u-v, for all nodes but the least ones."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows i, j those within the radius: by the pivot table first, then exactly."""
    for k in range(table.shape[1]):
        keep = np.abs(table[i, k] - table[j, k]) <= radius
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[keep], j[keep]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes one component of the rows of each pair; label is each row's root, that never is a later row."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _large_cell(fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """A row of its component for each row of one cell: rows by the first coordinate, each block against those within the radius in it.

    Pairs that earlier blocks have connected are left out, and the pairs of a block are dropped after it.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    label = np.arange(len(fp))
    for a in range(0, len(fp), 256):
        b = min(a + 256, len(fp))
        stop = int(np.searchsorted(table[:, 0], table[b - 1, 0] + radius, "right"))
        close = np.abs(table[a:b, 1, None] - table[None, a:stop, 1]) <= radius
        close &= label[a:b, None] != label[None, a:stop]
        i, j = np.nonzero(np.triu(close, 1))
        _unite(label, *_near(fp, table[:, 2:], i + a, j + a, radius))
    root = np.empty_like(label)
    root[order] = order[label]
    return root


def _cell_links(cell: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links between rows of the same cell, by their pivot tables; rows come sorted by cell."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.diff(edge)
    keep = np.repeat(size > 1, size)
    fp, table, size = fp[keep], table[keep].astype(np.int16), size[size > 1]
    if not len(size):
        return fp[:0], fp[:0]
    label = np.arange(len(fp))
    begin = np.cumsum(size) - size
    small = size <= 48
    left = np.repeat(np.where(small, size, 0), size) - (np.arange(len(fp)) - np.repeat(begin, size))  # rows of the cell from here on
    for step in range(1, int(size[small].max()) if small.any() else 0):
        i = np.flatnonzero(left > step)
        i = i[label[i] != label[i + step]]
        _unite(label, *_near(fp, table, i, i + step, radius))
    for a, n in zip(begin[~small].tolist(), size[~small].tolist()):
        label[a : a + n] = a + _large_cell(fp[a : a + n], table[a : a + n], radius)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return stars(fp[moved], fp[label[moved]])


def block_keys(blocks: int, equal: int) -> list[Column]:
    """For each choice of equal blocks a hash of the coordinates of near in them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [F.substring("near", a + 1, b - a) for a, b in zip(edges[:-1], edges[1:])]
    return [F.xxhash64(F.lit(i), *c) for i, c in enumerate(combinations(block, equal))]


def links(tables: DataFrame, radius: int = 3, blocks: int = 5, equal: int = 2) -> DataFrame:
    """Stars (a, b) that connect fingerprints within radius, from their stored pivot tables (pivots).

    Complete if blocks - radius >= equal; with fewer spare blocks, links whose
    differing bits touch too many blocks are missed.
    """
    keyed = tables.select("fp", *_FAR, F.explode(F.array(*block_keys(blocks, equal))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    dealt = keyed.join(hot, "key", "left").select("fp", *_FAR, "key", "parts", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cell = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    met = dealt.select(cell.alias("cell"), "fp", *_FAR).repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(stop: int | None) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            part, held[:] = rows[:stop], [rows[stop:]] if stop else []
            table = np.ascontiguousarray(part[:, 2:]).view(np.uint8).reshape(len(part), REFERENCES)
            a, b = _cell_links(part[:, 0], part[:, 1].view(np.uint64), table, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
                if sum(map(len, held)) >= 200_000:
                    cell = np.concatenate([x[:, 0] for x in held])
                    if last := int(np.searchsorted(cell, cell[-1])):
                        yield from out(last)
        if held:
            yield from out(None)

    return met.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node a of the edges but the least of a component, and the least, b."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = scratch.stored(ordered, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        files = -(-mark[0] // LINKS_A_FILE)
        older, now = now, scratch.stored(small.select("x.*").where("a <> b").distinct().coalesce(files), "edges")
        scratch.release(older)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5, equal: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least id that links reach), one row per document."""
    own = scratch.stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = pivots(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    star = components(links(nodes, radius, blocks, equal))
    linked = star.select(F.col("a").alias("fp"), F.col("b").alias("top")).union(star.select("b", "b").distinct())
    tops = linked.join(nodes, "fp").groupBy("top").agg(F.min("least").alias("component"))
    known = nodes.join(linked.join(tops, "top").select("fp", "component"), "fp", "left")
    known = scratch.stored(known.select("fp", "n", F.coalesce("component", "least").alias("component_id")), "components")
    # fewer than 10,000 fingerprints can have more than a ten-thousandth of the rows each: those are broadcast, so that no task gets a hot one
    most = max(CELL, own.count() // 10_000)
    hot = F.broadcast(known.where(F.col("n") > most).drop("n"))
    found = own.join(hot, "fp").unionByName(own.join(hot, "fp", "left_anti").join(known.where(F.col("n") <= most).drop("n"), "fp"))
    return found.select("doc_id", "fp", "component_id")


def _shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Distinct hashes of the word shingles of each text, as lists."""
    for row, n, data, offsets in vec.text_batches(column):
        data = vec.lower(data)
        starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
        rolling = vec.Rolling(vec.hash_words(data, starts, ends))
        lists = []
        for i in range(n):
            head = np.arange(first[i], max(first[i + 1] - shingle + 1, first[i] + (first[i + 1] > first[i])))
            lists.append(np.unique(rolling.spans(head, np.minimum(head + shingle, first[i + 1]))).view(np.int64))
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        yield row, n, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def band_keys(flat: np.ndarray, offsets: np.ndarray, bands: int = 24, rows: int = 4) -> np.ndarray:
    """[texts, bands] keys of sets of hashes: each a hash of the least elements of the set in rows random orders.

    Two sets of Jaccard similarity J have equal keys in a given band with
    probability J ** rows, whatever their sizes: at 0.8, in none of 24 bands of
    4 with 3 in a million.
    """
    seeds = vec.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, rows, 2)
    full = np.flatnonzero(np.diff(offsets))
    out = vec.mix(np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(offsets) - 1, 1)))
    if len(full):
        at = offsets[:-1][full]
        for b in range(bands):
            key = out[full, b]
            for turn, times in seeds[b]:
                key = vec.mix(key ^ np.minimum.reduceat((flat ^ turn) * (times | np.uint64(1)), at))
            out[full, b] = key
    return out


def sketches(docs: DataFrame, shingle: int, key: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _text_key, fp (of 3-word shingles) and bands: keys of the set of shingles."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), key.alias("_text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, offsets in vec.text_batches(batch.column(0)):
                part = batch.slice(row, n)
                fp = pa.array(fingerprints_of(data, offsets).view(np.int64))
                lists = [sets for _, _, sets in _shingle_sets(part.column(0), shingle)]
                keys = np.concatenate([band_keys(x.values.to_numpy().view(np.uint64), x.offsets.to_numpy()) for x in lists])
                at = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(keys.shape[1]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], fp, pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64).ravel()))], ["doc_id", "_text_key", "fp", "bands"])

    return chosen.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, _text_key string, fp long, bands array<long>")


def band_links(sketched: DataFrame) -> DataFrame:
    """Stars (a, b) that connect the fingerprints of texts with an equal band key."""
    keyed = sketched.select("fp", "bands").distinct().select("fp", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("key", "b")
    return keyed.join(met, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


class Leaders:
    """Sets seen so far that no earlier one is similar to, found through the least part of each set.

    Two sets with a Jaccard similarity of at least s share an element among
    the first n - ceil(s * n) + 1 of each in any fixed order; here, by value.
    """

    def __init__(self, similarity: float):
        self.similarity, self.sets, self.index, self.empty = similarity, [], {}, False

    def _first(self, x: np.ndarray) -> list[int]:
        return x[: len(x) - int(np.ceil(self.similarity * len(x) - 1e-9)) + 1].tolist()

    def similar(self, x: np.ndarray) -> bool:
        """Whether x (distinct, ascending) is similar to a leader."""
        if not len(x):
            return self.empty
        for i in dict.fromkeys(i for v in self._first(x) for i in self.index.get(v, ())):
            y = self.sets[i]
            if min(len(x), len(y)) >= self.similarity * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= self.similarity * (len(x) + len(y) - common):
                    return True
        return False

    def add(self, x: np.ndarray) -> None:
        """Makes x a leader."""
        if not len(x):
            self.empty = True
            return
        for v in self._first(x):
            self.index.setdefault(v, []).append(len(self.sets))
        self.sets.append(x)

    def covers(self, x: np.ndarray) -> bool:
        """Whether x is similar to a leader; if not, x becomes one."""
        if self.similar(x):
            return True
        self.add(x)
        return False


#: Kinds of rows of judged(): known to stay; judged in order, to stay if no earlier one is similar; held against those that stay.
STAYS, IN_ORDER, LATER = 0, 1, 2


def judged(sets: DataFrame, cell: Column, kind: Column, similarity: float) -> DataFrame:
    """(_text_key, gone) of the rows of a cell that aren't known to stay, by kind, least and key. Rows stream; only leaders are held."""
    rows = sets.select(cell.alias("cell"), kind.alias("kind"), "least", "key", "sets").repartition("cell").sortWithinPartitions("cell", "kind", "least", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders, before = None, None, None
        for batch in batches:
            cells, kinds, keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            told, gone = [], []
            for i, (c, kind, key) in enumerate(zip(cells, kinds, keys)):
                if c != now:
                    now, leaders, before = c, Leaders(similarity), None
                if key == before:
                    continue
                before, x = key, flat[at[i] : at[i + 1]]
                if kind == STAYS:
                    leaders.add(x)
                    continue
                told.append(key)
                gone.append(leaders.covers(x) if kind == IN_ORDER else leaders.similar(x))
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.string()), pa.array(gone, pa.bool_())], ["_text_key", "gone"])

    return rows.mapInArrow(run, "_text_key string, gone boolean")


def covered(sets: DataFrame, similarity: float) -> DataFrame:
    """_text_key of the rows (key, top, least, sets) that go: in each group top, by least and key, those similar to an earlier one that stays.

    A group of more than CELL rows is judged in rounds, with the same result:
    its first rows, CELL at most, in order by one task; then all later ones
    against those that stay, in parts.  The later ones that remain make up the
    group of the next round.  Rows of equal least are of one round.
    """
    sizes = sets.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    dealt = sets.join(sizes, "top")
    found = scratch.stored(judged(dealt.where(F.col("n") <= CELL), F.col("top"), F.lit(IN_ORDER), similarity), "covered")
    gone = found.where("gone").select("_text_key")
    if not sizes.where(F.col("n") > CELL).limit(1).count():
        return gone
    left = scratch.stored(dealt.where(F.col("n") > CELL).drop("n"), "left")
    halves = F.percentile_approx("least", [0.5**k for k in range(25)], 100_000)
    while left.limit(1).count():
        turn = F.greatest(F.ceil(F.log2(F.col("n") / CELL)), F.lit(0)).cast("int")
        cuts = left.groupBy("top").agg(F.count(F.lit(1)).alias("n"), halves.alias("halves"))
        cuts = scratch.stored(cuts.select("top", F.ceil(F.col("n") / CELL).cast("int").alias("parts"), F.element_at("halves", F.least(turn, F.lit(24)) + 1).alias("cut")), "cuts")
        near = left.join(cuts, "top")
        head, later = near.where("least <= cut"), near.where("least > cut")
        first = scratch.stored(judged(head, F.col("top"), F.lit(IN_ORDER), similarity), "covered")
        stay = head.join(first.where("not gone"), F.col("key") == F.col("_text_key"), "left_semi")
        part = F.pmod(F.xxhash64("key"), "parts").cast("int")
        both = stay.withColumns({"kind": F.lit(STAYS), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).union(later.withColumns({"kind": F.lit(LATER), "part": part}))
        second = scratch.stored(judged(both, F.xxhash64("top", "part"), F.col("kind"), similarity), "covered")
        gone = gone.union(first.union(second).where("gone").select("_text_key"))
        remain = later.join(second.where("not gone"), F.col("key") == F.col("_text_key"), "left_semi")
        left = scratch.stored(remain.select(*left.columns), "left")
    return gone


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 3, blocks: int = 5, equal: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: one document of each group stays, with the least id.

    Groups of candidates are the components of two kinds of links: SimHash
    fingerprints (of 3-word shingles) within radius, and texts with an equal
    band key of their word shingles.  The latter miss a pair of similarity 0.8
    with 3 in a million, whatever the edit or the length, and a closer one more
    rarely.  In a group, documents come by id, and one goes if its set of word
    shingles has a Jaccard similarity of at least similarity to that of one
    before it that stays; so no document goes without a verified near copy that
    stays, whatever the size of the group (covered).  Equal texts count as one;
    of repeated rows one stays; a null id counts as the largest.
    """
    names, last = docs.columns, F.lit(2**63 - 1)
    docs, (ident, body) = scratch.numbered(docs, id_col, text_col)
    key = F.md5(F.coalesce(F.col(body), F.lit("")))
    own = scratch.stored(sketches(docs, shingle, key, ident, body), "fingerprints")
    texts = own.groupBy("_text_key", "fp").agg(F.min("doc_id").alias("least"))
    star = components(links(pivots(texts.select("fp").distinct()), radius, blocks, equal).union(band_links(own)))
    linked = star.select(F.col("a").alias("fp"), F.col("b").alias("top")).union(star.select("b", "b").distinct())
    alike = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("fp")
    linked = linked.union(alike.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("top")))
    grouped = texts.join(linked, "fp").select("_text_key", "top", F.coalesce("least", last).alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, sets in _shingle_sets(batch.column(0), shingle):
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], sets], ["key", "top", "least", "sets"])

    told = docs.select(F.col(body).alias("_text"), F.coalesce(F.col(ident), last).alias("_id"), key.alias("_key"))
    one = told.join(grouped, (told["_key"] == grouped["_text_key"]) & (told["_id"] == grouped["least"]))
    sets = scratch.stored(one.select("_text", "_text_key", "top", "least").mapInArrow(run, "key string, top long, least long, sets array<long>"), "sets")
    gone = covered(sets, similarity)
    stay = texts.join(gone, "_text_key", "left_anti").select(F.col("_text_key").alias("_k"), F.col("least").alias("_l"))
    keyed = docs.withColumn("_key", key)
    kept = keyed.join(stay, (keyed["_key"] == stay["_k"]) & keyed[ident].eqNullSafe(stay["_l"])).select(keyed["*"])
    if own.groupBy("doc_id", "_text_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([ident, "_key"])
    return kept.select(*docs.columns).toDF(*names)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Vectorised text kernels shared by the operators of this subpackage.

A batch is a byte buffer with document offsets (the layout of an Arrow string
column), so one numpy pass serves thousands of documents.  Nothing here knows
about Spark; memory is bounded by the bytes of a batch, and ``text_batches``
cuts a record batch into pieces of a given number of bytes, a longer document
making a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Fixed constants of the hash functions: changing one changes every hash.
_MUL_WORDS, _SIZE, _STEP = 0xD6E8_FEB8_6659_FD93, U64(0xA24B_AED4_963E_E407), U64(0x9E37_79B9_7F4A_7C15)
#: The lower 0 to 8 bytes of a 64-bit word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Byte ranges longer than this are taken one at a time.
_LONG = 256


def class_table(spec: bytes) -> np.ndarray:
    """256 booleans, true for the bytes in spec."""
    out = np.zeros(256, bool)
    out[np.frombuffer(spec, np.uint8)] = True
    return out


#: Bytes of words that end at ASCII white space: [^\x20\x09-\x0D].
NOT_SPACE = ~class_table(b" \t\n\x0b\x0c\r")
#: After lower-casing A-Z: digits, a-z and everything that isn't ASCII.
ALNUM = class_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_batches(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) of pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop - row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and where each document's words begin among them."""
    inside = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(pow(base, have, 2**64))
        have += take
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, 1 << max(10, int(n - 1).bit_length()))
    return _POWERS[base]


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as a number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: 8 bytes at a time through a finaliser, long ranges by XXH3. Equality is judged by same_bytes."""
    size = ends - starts
    eight = _eights(data)
    h = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) ^ size.astype(U64) * _SIZE)
    on, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(on):
        part = eight[starts[on] + k] & _KEEP[np.minimum(size[on] - k, 8)]
        h[on] = mix((h[on] ^ part) + _STEP)
        k += 8
        on = on[size[on] > k]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the byte ranges of a and b of the same sizes are equal."""
    x, y = _eights(a), _eights(b)
    ok = ((x[a_start] ^ y[b_start]) & _KEEP[np.minimum(size, 8)]) == 0
    on, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(on):
        ok[on] &= ((x[a_start[on] + k] ^ y[b_start[on] + k]) & _KEEP[np.minimum(size[on] - k, 8)]) == 0
        k += 8
        on = on[size[on] > k]
    for i in np.flatnonzero(size > _LONG).tolist():
        ok[i] = np.array_equal(a[a_start[i] : a_start[i] + size[i]], b[b_start[i] : b_start[i] + size[i]])
    return ok


class Rolling:
    """Hashes of any range of a sequence of 64-bit items, by prefix sums."""

    _base = _MUL_WORDS
    _inverse = pow(_MUL_WORDS, -1, 2**64)

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(items * _powers(self._base, n + 1)[:n], out=self.sums[1:])
        self.back = _powers(self._inverse, n + 1)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        """Of every range of that size, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n] + U64(size))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, an index of each, the place of every value among them)."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = values.argsort()
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], order[new], place


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start .. start+length-1 of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.arange(total) + np.repeat(shift, lengths)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words with one space after each, where each begins and ends there)."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    out = np.append(data, np.uint8(32))[ragged(starts, size)]
    out[stop - 1] = 32
    return out, stop - size, stop - 1


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of values[i:i+size] for every i, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out

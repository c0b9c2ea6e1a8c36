"""Token ids of whole texts, by the tokenizers library, with each distinct piece of text encoded once.

A text is cut where no token can cross: before white space (byte-level BPE) or
at white space (a tokenizer that drops it).  The library encodes each distinct
piece; the ids of a text are its pieces' ids in order, which equals encoding
the text at once.  Pieces are found by hash and compared by their bytes.
Tokenizers of other kinds, texts that hold the string of an added token, and
texts with white space outside ASCII in byte-level mode, are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from . import vec

#: Pieces that a Python worker remembers at most; beyond it starts anew. Results don't depend on it.
REMEMBERED = 1_000_000
#: UTF-8 of the white space outside ASCII.
_WIDE_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec["model"]["type"] != "BPE" or any(x.get("normalized") for x in spec.get("added_tokens", [])):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "spaced"
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if set(steps) <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed":
        return "words"
    return "whole"


class Encoder:
    """Encodes batches of texts; keeps the ids of pieces it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(path)
        self.whole = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        if self.kind == "spaced":
            self.whole += _WIDE_SPACE
        self.size = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.bytes, self.byte_at, self.byte_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids begin: one more than texts)."""
        raw = data.tobytes()
        if self.kind == "whole":
            return self._whole(raw, offsets)
        if any(x in raw for x in self.whole):
            held = np.array([any(x in raw[a:b] for x in self.whole) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
            if held.any():
                return self._mixed(data, offsets, held)
        if self.kind == "words":
            starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
        else:
            space = ~vec.NOT_SPACE[data]
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            first = np.searchsorted(starts, offsets)
        found = self._pieces(data, raw, starts, ends - starts, vec.hash_words(data, starts, ends), first)
        return found or self._whole(raw, offsets)

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = offsets.tolist()
        flat, lengths = self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])])
        return flat, np.concatenate([[0], np.cumsum(lengths)])

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, total = [], [0]
        edges = [0, *(np.flatnonzero(np.diff(wide)) + 1).tolist(), len(wide)]
        for a, b in zip(edges[:-1], edges[1:]):
            piece, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            ids, first = self._whole(piece.tobytes(), own) if wide[a] else self.encode(piece, own)
            parts.append(ids)
            total.extend((first[1:] + total[-1]).tolist())
        return np.concatenate(parts), np.array(total)

    def _pieces(self, data: np.ndarray, raw: bytes, starts: np.ndarray, size: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by pieces; None if two different pieces have the same hash."""
        keys, one, place = vec.distinct(hashes)
        twin = one[place]
        if not (np.array_equal(size, size[twin]) and vec.same_bytes(data, starts, data, starts[twin], size).all()):
            return None
        at = np.searchsorted(self.known, keys)
        here = np.zeros(len(keys), bool)
        inside = at < len(self.known)
        here[inside] = self.known[at[inside]] == keys[inside]
        old, held = one[here], at[here]
        if not (np.array_equal(size[old], self.byte_size[held]) and vec.same_bytes(data, starts[old], self.bytes, self.byte_at[held], size[old]).all()):
            return None
        if not here.all():
            if len(self.known) + len(keys) > REMEMBERED:
                self._forget()
                here[:] = False
            new = one[~here]
            flat, lengths = self._library([raw[a : a + n].decode("utf-8", "replace") for a, n in zip(starts[new].tolist(), size[new].tolist())])
            into = np.searchsorted(self.known, keys[~here])
            added = (keys[~here], np.cumsum(lengths) - lengths + len(self.flat), lengths, np.cumsum(size[new]) - size[new] + len(self.bytes), size[new])
            self.known, self.at, self.length, self.byte_at, self.byte_size = (np.insert(x, into, y) for x, y in zip((self.known, self.at, self.length, self.byte_at, self.byte_size), added))
            self.flat, self.bytes = np.concatenate([self.flat, flat]), np.concatenate([self.bytes, data[vec.ragged(starts[new], size[new])]])
            at = np.searchsorted(self.known, keys)
        lengths = self.length[at][place]
        ids = self.flat[vec.ragged(self.at[at][place], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Quality classifier: support vectors over naive Bayes log-count ratios.

Features are indicators: pairs of neighbouring bytes, words, word pairs, and
1- to 3-grams of word shapes (which kinds of characters a word has, whether it
repeats the word before).  Each indicator is scaled by its log-count ratio of
the classes, and a linear hinge-loss model is fitted to the scaled indicators
by dual coordinate descent.  Margins are turned into probabilities by a
logistic fit on margins of rows that a model hasn't seen.

The model is fitted on a bounded sample of labelled rows (MOST_ROWS), whole texts
of any length: their indicators (SIZE a text at most) are found where the texts
are, one task fits, and the model (two tables of 4 bytes a feature, 5 MB in all)
comes back and is sent to the executors; scoring is a map over whole texts.

Edge cases: null or empty text has no indicators and gets the intercept's
score; texts of any length are scored whole; a null id counts as held out;
repeated rows get equal scores; without labelled rows of both classes every
score is the share of label 1 (0.5 without any); an empty table gives no rows;
other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import ship
from . import labelled, vec

#: Labelled rows to fit on, by class: documented bound of the sample.
MOST_ROWS = {0: 1000, 1: 3000}
_PAIRS, _WORDS, _SHAPES = 1 << 16, 1 << 18, 1 << 18
SIZE = _PAIRS + _WORDS + _SHAPES
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 16


def codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Of each text of a batch, its features, repeats included."""
    starts, ends, first = vec.words(data, offsets, vec.NOT_SPACE)
    if len(starts):
        h = vec.hash_words(data, starts, ends)
        kinds = np.bitwise_or.reduceat(_KIND[data], starts) & np.uint8(31)  # of the word and the white space after it, which has no kind
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        shape = kinds.astype(np.uint64) | (same.astype(np.uint64) << np.uint64(5))
        two = np.concatenate([shape[1:], np.zeros(1, np.uint64)])
        three = np.concatenate([shape[2:], np.zeros(min(2, len(shape)), np.uint64)])
        pair = vec.mix(h + np.concatenate([h[1:], np.zeros(1, np.uint64)]) * np.uint64(0x9E3779B97F4A7C15))
        at_word = (_PAIRS + (h & np.uint64(_WORDS - 1))).astype(np.int64)
        at_pair = (_PAIRS + (pair & np.uint64(_WORDS - 1))).astype(np.int64)
        base = np.uint64(_PAIRS + _WORDS)
        mask = np.uint64(_SHAPES - 1)
        at_one = (base + (vec.mix(shape + np.uint64(1)) & mask)).astype(np.int64)
        at_two = (base + (vec.mix((shape << np.uint64(6) | two) + np.uint64(1 << 20)) & mask)).astype(np.int64)
        at_three = (base + (vec.mix((shape << np.uint64(12) | two << np.uint64(6) | three) + np.uint64(1 << 40)) & mask)).astype(np.int64)
    wide = data.astype(np.int64)
    for i in range(len(offsets) - 1):
        a, b, p, q = offsets[i], offsets[i + 1], first[i], first[i + 1]
        parts = [wide[a : b - 1] << 8 | wide[a + 1 : b]] if b > a + 1 else []
        if q > p:
            parts += [at_word[p:q], at_one[p:q], at_pair[p : q - 1], at_two[p : q - 1], at_three[p : max(q - 2, p)]]
        yield np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Distinct:
    """The distinct values of arrays of features, by a mark for each feature."""

    def __init__(self):
        self.mark = np.zeros(SIZE, np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        order = np.arange(len(x), dtype=np.int32)
        self.mark[x] = order
        return x[self.mark[x] == order].astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # weight times log-count ratio of each feature
    square: np.ndarray  # the ratio's square
    bias: float
    a: float
    b: float

    def margin(self, features: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[features].sum(dtype=np.float64))) or 1.0
        return float(self.weight[features].sum(dtype=np.float64)) / norm + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts of a batch."""
        distinct = Distinct()
        rows = [distinct(x) for x in codes(data, offsets)]
        size = np.array([len(x) for x in rows])
        full, flat = np.flatnonzero(size), np.concatenate(rows)
        margin = np.zeros(len(rows))
        if len(full):
            at = (np.cumsum(size) - size)[full]
            norm = np.sqrt(np.add.reduceat(self.square[flat].astype(np.float64), at))
            margin[full] = np.add.reduceat(self.weight[flat].astype(np.float64), at) / np.where(norm > 0, norm, 1.0)
        return 1 / (1 + np.exp(-np.clip(self.a * (margin + self.bias) + self.b, -30, 30)))


def descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: float, rounds: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights of scaled indicators, bias): min |w|^2 / 2 + c * sum of hinge losses, one dual variable at a time."""
    random = np.random.default_rng(seed)
    sign = np.where(y == 1, 1.0, -1.0)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scale = lambda v: (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)
    values = [scale(ratio[f]) for f in rows]  # every row has length 1, and 1 for the bias
    for _ in range(rounds):
        largest = 0.0
        for i in random.permutation(len(rows)):
            grad = sign[i] * (float(values[i] @ w[rows[i]]) + bias) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), c)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3 * c:
            break
    return w, bias


def _ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(SIZE, smooth), np.full(SIZE, smooth)]
    for f, label in zip(rows, y.tolist()):
        counts[label][f] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, rounds: int = 12) -> Model:
    """A model of the distinct features of texts and their labels 0 and 1."""
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fold = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):  # margins of rows that the model hasn't seen
        own = np.flatnonzero(fold != k)
        if len(set(y[own].tolist())) < 2:
            continue
        part = _model([rows[i] for i in own], y[own], c, rounds)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    model = _model(rows, y, c, rounds)
    model.a, model.b = labelled.platt(margins, y)
    return model


def _model(rows: list[np.ndarray], y: np.ndarray, c: float, rounds: int) -> Model:
    ratio = _ratio(rows, y)
    w, bias = descend(rows, ratio, y, c, rounds)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)


def indicators(rows: DataFrame) -> DataFrame:
    """(_id, y, features) of (_id, text, y): each text's distinct features."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for batch in batches:
            for row, n, data, offsets in vec.text_batches(batch.column(1)):
                part = batch.slice(row, n)
                found = pa.array([distinct(x) for x in codes(data, offsets)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), found], ["_id", "y", "features"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "text", "y").mapInArrow(run, f"_id {kind}, y int, features array<int>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: dict[int, int] = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most most[y] labelled rows of each class that aren't held out; the classes' true shares set the scores' level."""
    rows, totals = labelled.sample(docs, labels, label_col, most, id_col, text_col)

    def run(table: pa.Table) -> Model:
        y, lists = table.column("y").to_numpy().astype(np.int64), table.column("features").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        model, n = fit([flat[a:b] for a, b in zip(at[:-1], at[1:])], y), np.bincount(y, minlength=2)
        if n.all():
            model.b += float(np.log((totals[1] / totals[0]) / (n[1] / n[0])))
        return model

    return labelled.fitted(indicators(rows), run)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and: held_out, score, predicted."""
    return labelled.score(docs, model, threshold, id_col, text_col, 4 << 20)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs, with all their columns, without those that the classifier rejects."""
    return labelled.accepted(docs, train(docs, labels, **options), threshold, options.get("text_col", "text"), 4 << 20)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")

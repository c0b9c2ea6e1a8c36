"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is its own embedding (hashed) and the mean of its character
trigrams' embeddings (hashed).  A text is cut into overlapping windows of WINDOW
words, STRIDE apart, all of which are scored; a GRU reads each window in both
directions, attention pools its states, and the text's score is its most toxic
window's.  The network is written and trained in numpy: only the window that
decides a text's score learns from its label (a text is toxic if any window
is), with Adam.

Fitting takes a bounded sample of labelled rows (MOST_ROWS), whole texts of any
length, in one task; the parameters (about 10 MB) come back and are sent to the
executors, and scoring is a map over whole texts: the words of a batch are
embedded and projected once each, a window's step is a table lookup.

Edge cases: null or empty text is one empty window, scored like any other;
texts of any length are scored whole; a null id counts as held out; repeated
rows get equal scores; without labelled rows of both classes every score is the
share of label 1 (0 without any); an empty table gives no rows; other columns
pass through, those named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled, vec

#: Labelled rows to fit on, by class: documented bound of the sample.
MOST_ROWS = {0: 1500, 1: 1000}
WINDOW, STRIDE = 48, 40
WORDS, GRAMS, DIM, HIDDEN = 1 << 16, 1 << 13, 16, 8
_CHUNK = 2048
#: Windows of a text with label 0 that a round of training reads; of a longer one every round takes other windows.
ROUND_WINDOWS = 128


def unique_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word of a batch among its distinct words, first word of each text; of the distinct words: bucket, trigrams one after another, where they begin)."""
    data = vec.lower(data)
    starts, ends, first = vec.words(data, offsets, vec.ALNUM)
    keys, one, place = vec.distinct(vec.hash_words(data, starts, ends))
    size = ends[one] - starts[one]
    # each word between two marks, so that it has as many trigrams as bytes
    bounded = np.zeros(int((size + 2).sum()), np.uint64)
    begin = np.cumsum(size + 2) - (size + 2)
    bounded[vec.ragged(begin + 1, size)] = data[vec.ragged(starts[one], size)]
    at = vec.ragged(begin, size)
    grams = bounded[at] | bounded[at + 1] << np.uint64(8) | bounded[at + 2] << np.uint64(16) if len(at) else at.astype(np.uint64)
    return place, first, (keys & np.uint64(WORDS - 1)).astype(np.int64), (vec.mix(grams) & np.uint64(GRAMS - 1)).astype(np.int64), np.cumsum(size) - size


def windows_of(place: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each window, none beyond a text's end; the text of each window)."""
    counts = np.diff(first)
    many = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(counts)), many)
    at = vec.ragged(np.zeros(len(counts), np.int64), many) * STRIDE
    index = first[:-1][of][:, None] + at[:, None] + np.arange(WINDOW)
    inside = index < first[1:][of][:, None]
    index = np.where(inside, index, 0)
    return np.where(inside, place[index] if len(place) else none, none), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters p; both directions lie side by side in the first axis of the recurrent ones."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        small = lambda *shape: random.normal(0, 1, shape).astype(np.float32)
        self.p = {
            "word": 0.1 * small(WORDS, DIM), "gram": 0.3 * small(GRAMS, DIM),
            "wx": small(2, DIM, 3 * HIDDEN) / np.float32(np.sqrt(DIM)), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "uh": small(2, HIDDEN, 3 * HIDDEN) / np.float32(np.sqrt(HIDDEN)),
            "v": 0.3 * small(2 * HIDDEN), "u": 0.3 * small(2 * HIDDEN), "b": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def embed(self, bucket: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Inputs of distinct words."""
        out = self.p["word"][bucket].copy()
        if len(bucket):
            size = np.diff(np.append(begin, len(grams)))[:, None]
            out += np.add.reduceat(self.p["gram"][grams], begin, axis=0) / size.astype(np.float32)
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """[2, words + 1, 3 * HIDDEN]: the gates' inputs; the last row is for no word."""
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        out[:, :-1] = x @ self.p["wx"] + self.p["bx"]
        return out

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows [B, T]; with keep, also what backward needs."""
        n, steps = index.shape
        none = gates.shape[1] - 1
        mask = (index != none).astype(np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        uh = self.p["uh"]
        saved = []
        for t in range(steps):
            m = np.stack([mask[:, t], mask[:, steps - 1 - t]])[:, :, None]
            x = np.stack([gates[0][index[:, t]], gates[1][index[:, steps - 1 - t]]])
            r = np.matmul(h, uh)
            zr = _sigmoid(x[:, :, : 2 * HIDDEN] + r[:, :, : 2 * HIDDEN])
            z, reset = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            cand = np.tanh(x[:, :, 2 * HIDDEN :] + reset * r[:, :, 2 * HIDDEN :])
            new = h + m * (1 - z) * (cand - h)
            if keep:
                saved.append((m, h, z, reset, cand, r[:, :, 2 * HIDDEN :]))
            h = new
            states[t, :, :HIDDEN] = h[0]
            states[steps - 1 - t, :, HIDDEN:] = h[1]
        energy = states @ self.p["v"]
        energy = np.where(mask.T > 0, energy, -1e9)
        weight = np.exp(energy - energy.max(axis=0)) * mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ self.p["u"] + self.p["b"]
        return (logit, (mask, states, weight, pooled, saved, index)) if keep else logit

    def backward(self, held, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of all but the embeddings and projections, gradient of the gates' inputs [2, B, T, 3 * HIDDEN])."""
        mask, states, weight, pooled, saved, index = held
        n, steps = index.shape
        grad = {"u": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True), "uh": np.zeros_like(self.p["uh"])}
        d_pooled = d_logit[:, None] * self.p["u"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["v"] = np.einsum("tb,tbh->h", d_energy, states)
        d_states += d_energy[:, :, None] * self.p["v"]
        d_gates = np.zeros((2, n, steps, 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        uh_t = self.p["uh"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            m, h, z, reset, cand, rec = saved[t]
            d_h = d_h + np.stack([d_states[t, :, :HIDDEN], d_states[steps - 1 - t, :, HIDDEN:]])
            d_cand = d_h * m * (1 - z) * (1 - cand * cand)
            d_z = -d_h * m * (cand - h) * z * (1 - z)
            d_reset = d_cand * rec * reset * (1 - reset)
            d_rec = np.concatenate([d_z, d_reset, d_cand * reset], axis=2)
            d_x = np.concatenate([d_z, d_reset, d_cand], axis=2)
            d_gates[0, :, t], d_gates[1, :, steps - 1 - t] = d_x[0], d_x[1]
            grad["uh"] += np.matmul(h.transpose(0, 2, 1), d_rec)
            d_h = d_h * (1 - m * (1 - z)) + np.matmul(d_rec, uh_t)
        return grad, d_gates

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text of a batch, its most toxic window's logit."""
        place, first, bucket, grams, begin = unique_words(data, offsets)
        gates = self.project(self.embed(bucket, grams, begin))
        out = np.full(len(offsets) - 1, -np.inf, np.float32)
        # windows of some texts at a time
        many = np.cumsum(np.maximum(1, -(-(np.diff(first) - WINDOW) // STRIDE) + 1))
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + 8 * _CHUNK, "right")))
            index, of = windows_of(place, first[a : b + 1], len(bucket))
            for i in range(0, len(index), _CHUNK):
                np.maximum.at(out, a + of[i : i + _CHUNK], self.forward(gates, index[i : i + _CHUNK]))
            a = b
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.logits(data, offsets).astype(np.float64) + self.shift, -30, 30))


def fit(texts: list[str], y: np.ndarray, weights: dict[int, float], rounds: int = 12, rate: float = 0.02, batch: int = 64, seed: int = 7) -> Network:
    """Trains on whole texts: in each round, every text's windows are scored, and the highest learns.

    Any window of a text with label 0 has label 0, so a round may take a part
    of a long one's windows (ROUND_WINDOWS); the parts take turns.
    """
    net = Network(seed)
    y = np.asarray(y, np.float32)
    if len(set(y.tolist())) < 2:
        for k in net.p:
            net.p[k][...] = 0
        share = float(y.mean()) if len(y) else 0.0
        net.p["b"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    pieces = list(vec.text_batches(pa.array(texts, pa.large_string()), 1 << 60))
    _, n, data, offsets = pieces[0]
    place, first, bucket, grams, begin = unique_words(data, offsets)
    gram_size = np.diff(np.append(begin, len(grams)))
    index, of = windows_of(place, first, len(bucket))
    of_at = np.searchsorted(of, np.arange(n + 1))
    parts = np.where(y == 1, 1, -(-np.diff(of_at) // ROUND_WINDOWS))
    random = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    sample_weight = np.where(y == 1, weights[1], weights[0]).astype(np.float32)
    step = 0
    for round_ in range(rounds):
        order = random.permutation(n)
        for a in range(0, n, batch):
            own = order[a : a + batch]
            begin_at = of_at[own] + round_ % parts[own]
            many = -(-(of_at[own + 1] - begin_at) // parts[own])
            text = np.repeat(np.arange(len(own)), many)
            rows = begin_at[text] + vec.ragged(np.zeros(len(own), np.int64), many) * parts[own][text]
            # only the batch's words are embedded
            used, local = np.unique(index[rows], return_inverse=True)
            local = local.reshape(len(rows), WINDOW)
            if used[-1] == len(bucket):
                used = used[:-1]
            at = vec.ragged(begin[used], gram_size[used])
            own_begin = np.cumsum(gram_size[used]) - gram_size[used]
            x = net.embed(bucket[used], grams[at], own_begin)
            gates = net.project(x)
            logit = np.concatenate([net.forward(gates, local[i : i + _CHUNK]) for i in range(0, len(rows), _CHUNK)])
            best = np.lexsort((logit, text))[np.searchsorted(text, np.arange(len(own)), "right") - 1]
            top, held = net.forward(gates, local[best], keep=True)
            d_logit = (_sigmoid(top) - y[own]) * sample_weight[own] / len(own)
            grad, d_gates = net.backward(held, d_logit.astype(np.float32))
            total = np.zeros((2, len(used) + 1, 3 * HIDDEN), np.float32)
            for k in (0, 1):
                np.add.at(total[k], local[best], d_gates[k])
            total = total[:, :-1]
            grad["bx"] = total.sum(axis=1, keepdims=True)
            grad["wx"] = np.matmul(x.T, total)
            d_x = np.matmul(total, net.p["wx"].transpose(0, 2, 1)).sum(axis=0)
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], bucket[used], d_x)
            touched = np.repeat(np.arange(len(used)), gram_size[used])
            np.add.at(grad["gram"], grams[at], (d_x / np.maximum(gram_size[used], 1)[:, None])[touched])
            step += 1
            slow = rate * (0.5 if round_ >= rounds * 2 // 3 else 1.0) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                m, v = moments[k]
                if k in ("word", "gram"):  # only the rows that have a gradient move
                    on = np.flatnonzero(np.abs(g).sum(axis=1))
                    m[on] = 0.9 * m[on] + 0.1 * g[on]
                    v[on] = 0.999 * v[on] + 0.001 * g[on] ** 2
                    net.p[k][on] -= slow * m[on] / (np.sqrt(v[on]) + 1e-8)
                else:
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= slow * m / (np.sqrt(v) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: dict[int, int] = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", **options) -> Network:
    """Fits on at most most[y] labelled rows of each class that aren't held out; the classes' true shares set the scores' level."""
    rows, totals = labelled.sample(docs, labels, label_col, most, id_col, text_col)

    def run(table: pa.Table) -> Network:
        y = table.column("y").to_numpy().astype(np.int64)
        net, n = fit(table.column("text").to_pylist(), y, {0: 1.0, 1: 1.0}, **options), np.bincount(y, minlength=2)
        if n.all():
            net.shift = float(np.log((totals[1] / totals[0]) / (n[1] / n[0])))
        return net

    return labelled.fitted(rows, run)


def score(docs: DataFrame, model: Network, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and: held_out, score, predicted."""
    return labelled.score(docs, model, threshold, id_col, text_col, 2 << 20)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")

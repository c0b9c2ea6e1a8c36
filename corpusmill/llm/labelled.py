"""What both classifiers share: a bounded sample of labelled rows without held-out ones, fitting in a task, scoring."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import ship
from . import scratch, vec

_ADDED = ["held_out", "score", "predicted"]


def held_out(ident: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """((_id, text, y) of at most most[y] rows of each class, rows of each class that they were chosen from), held-out rows left out.

    Rows are chosen by a hash of their id, so the sample doesn't depend on the
    order of the tables, nor on the length of the texts; of an id's rows the
    least text and the greater label count.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("_id")))
    known = scratch.stored(known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi"), "labelled")
    totals = {x["y"]: x["n"] for x in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y, n in most.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    # at most sum(most) rows of 12 bytes: broadcast
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen.groupBy("_id").agg(F.max("y").alias("y"))), F.col("_doc") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), totals


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]):
    """What fit makes of all rows of a bounded sample, in the order of _id: in one task, so that the driver gets the model alone."""
    ship(rows.sparkSession)
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([x.cast(schema) for x in batches], schema)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(table))]}, pa.schema([("model", pa.binary())]))

    found = rows.repartition(1).sortWithinPartitions("_id").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(schema.empty_table())


def _scored(docs: DataFrame, model, text_col: str, limit: int) -> DataFrame:
    """docs and score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for row, n, data, offsets in vec.text_batches(batch.column(text), limit):
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns, pa.array(model.score(data, offsets))], [*names, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.mapInArrow(run, fields + "score double")


def score(docs: DataFrame, model, threshold: float, id_col: str, text_col: str, limit: int) -> DataFrame:
    """All columns of docs and: held_out, score, predicted; input columns with these names are replaced."""
    kept = [c for c in docs.columns if c not in _ADDED]
    plain, (ident, body) = scratch.numbered(docs.select(*kept), id_col, text_col)
    out = _scored(plain, model, body, limit)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], held_out(F.col(ident)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, threshold: float, text_col: str, limit: int) -> DataFrame:
    """docs, with all their columns, of at least that score."""
    plain, (body,) = scratch.numbered(docs, text_col)
    return _scored(plain, model, body, limit).where(F.col("score") >= threshold).select(*plain.columns).toDF(*docs.columns)


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    rank = pd.Series(score).rank().to_numpy()
    n1 = int(y.sum())
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(n1 * (len(y) - n1), 1))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits y, by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(w[0]), float(w[1])

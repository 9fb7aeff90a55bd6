"""Quality classifier: a factorisation machine (Rendle, 2010) over hashed words and structure statistics.

No metadata is used: of the columns of documents only n_chars would be allowed, and it is the length of the text,
which the structure statistics hold already.

The score of a document is a bias, a weight for each of its features and, for each pair of features, the inner
product of their low-rank vectors. The pairs are summed in linear time: for each rank, half of the squared sum
less the sum of squares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestay.llm.common import by_place, held_out, list_array, text_slices, with_field
from lodestay.llm.hashing import STRUCTURE, SparseRows, document_rows

#: Labelled rows that training takes at most (those of the smallest hashed ids), hashed-word buckets, rank, passes.
SAMPLE, BUCKETS, RANK, EPOCHS = 12_000, 1 << 13, 6, 12


@dataclass
class FactorisationMachine:
    weight: np.ndarray
    factor: np.ndarray

    def _parts(self, rows: SparseRows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xv = self.factor[rows.column] * rows.value[:, None]
        at = rows.start[:-1]
        sums = np.add.reduceat(xv, at)
        linear = np.add.reduceat(self.weight[rows.column] * rows.value, at)
        pairs = 0.5 * (sums**2 - np.add.reduceat(xv**2, at)).sum(1)
        return linear + pairs, sums, xv

    def scores(self, rows: SparseRows) -> np.ndarray:
        """Probabilities of label 1; every row has its structure features, so no row is empty."""
        if len(rows.start) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._parts(rows)[0].astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, rows: SparseRows, labels: np.ndarray, columns: int, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the logistic loss, both labels weighing the same."""
        random = np.random.default_rng(seed)
        model = cls(np.zeros(columns, np.float32), random.normal(0, 0.05, (columns, rank)).astype(np.float32))
        n = len(labels)
        if n == 0:
            return model
        square_w, square_v = np.full(columns, 1e-3, np.float32), np.full((columns, rank), 1e-3, np.float32)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for _ in range(epochs):
            order = random.permutation(n)
            for lo in range(0, n, 256):
                pick = np.sort(order[lo : lo + 256])
                lengths = rows.start[pick + 1] - rows.start[pick]
                start = np.concatenate([[0], np.cumsum(lengths)])
                take = np.repeat(rows.start[pick] - start[:-1], lengths) + np.arange(start[-1])
                part = SparseRows(start, rows.column[take], rows.value[take])
                score, sums, xv = model._parts(part)
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[pick]) * importance[pick] / len(pick)
                slope = np.repeat(error, lengths) * part.value
                used, where = np.unique(part.column, return_inverse=True)
                grad_w = np.bincount(where, slope, len(used)).astype(np.float32) + 1e-5 * model.weight[used]
                pairwise = slope[:, None] * (np.repeat(sums, lengths, 0) - xv)
                grad_v = np.stack([np.bincount(where, pairwise[:, f], len(used)) for f in range(rank)], 1).astype(np.float32)
                grad_v += 1e-5 * model.factor[used]
                square_w[used] += grad_w**2
                square_v[used] += grad_v**2
                model.weight[used] -= 0.1 * grad_w / np.sqrt(square_w[used])
                model.factor[used] -= 0.05 * grad_v / np.sqrt(square_v[used])
        return model


def _features(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = document_rows(part.column(1), buckets)
                lengths = np.diff(rows.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), list_array(rows.column, lengths), list_array(rows.value, lengths)], ["doc_id", "label", "columns", "values"])

    return run


def _score(model, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores = model.value.scores(document_rows(part.column(1), buckets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all their columns as they are; null texts count as empty."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at, plain = docs.columns.index("text"), by_place(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[at]):
                scores = model.value.scores(document_rows(part.column(at), BUCKETS))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "score"])

    found = plain.mapInArrow(run, with_field(plain.schema, "score", T.DoubleType()))
    return found.where(F.col("score") >= least).drop("score").toDF(*docs.columns)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows that are not held out.

    Labels other than 0 and 1 and null ids are left out; an id with labels of both kinds is too. The sample's ids
    are bounded and go to every task; features come back as short sparse rows, the texts never leave the tasks.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    chosen = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    found = texts.mapInArrow(_features(BUCKETS), "doc_id long, label int, columns array<int>, values array<float>").toArrow()
    found = found.sort_by("doc_id")  # so that training meets them in one order however the tasks ended
    columns, values = found.column("columns").combine_chunks(), found.column("values").combine_chunks()
    start = np.concatenate([[0], np.cumsum(columns.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    rows = SparseRows(start, columns.flatten().to_numpy(), values.flatten().to_numpy())
    return FactorisationMachine.fit(rows, found.column("label").to_numpy().astype(np.float32), BUCKETS + len(STRUCTURE))


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Only the text is an input of a score; null counts as empty, and an empty text is scored by its structure
    features. Without any label all scores are near 0.5. Further columns of both tables are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model, BUCKETS), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

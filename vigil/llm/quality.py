"""Document quality by a regularised quadratic discriminant.

A document becomes a vector of transformed statistics of its whole text. Each class has the
mean and the covariance of its labelled rows, shrunk towards the pooled covariance and its
diagonal; the score is the difference of the two Gaussian log densities, from Mahalanobis
distances through the Cholesky factors, which are computed once. A logistic curve fitted on
a bounded sample of training rows turns the difference into a probability.

The texts are read once: the statistics are stored, and the class sums (a vector and a
matrix for each class) and the scores come from the stored rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import fold, materialize
from vigil.llm.labels import least_hashes, logistic, sigmoid, training_labels

FOLDS, HELD = 5, 0
KEEP = 0.3  # least score of a document that is kept
SHRINK = 0.1  # towards the pooled covariance
RIDGE = 0.05  # towards the diagonal, then of its mean
CALIBRATION_ROWS = 20_000  # bounded sample for the logistic curve

SIGN_RUN = re.compile(r"([^\w\s])\1")
BYTE_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sign, 6 beyond ASCII
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58], BYTE_CLASS[[32, *range(9, 14)]] = 1, 2, 3, 4
BYTE_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
BYTE_CLASS[128:] = 6
STATISTICS = (
    "words", "word_length", "upper", "digits", "signs", "common_sign", "distinct", "repeated", "most_common",
    "sign_runs", "stops", "capitals", "lines", "repeated_lines", "pipes",
)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, finite for any text; shares on a logarithmic scale."""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    kinds = np.bincount(BYTE_CLASS, weights=data, minlength=7)
    inked = max(1.0, float(kinds.sum() - kinds[4]))
    words = text.split()
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    shares = [
        kinds[2] / inked, kinds[3] / inked, kinds[5] / inked,
        float(data[BYTE_CLASS == 5].max()) / inked,
        1 - len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(0, max(counts.values(), default=0) - 1) / n,
        len(SIGN_RUN.findall(text)) / n,
        text.count(".") / (n + 5),  # a few words say little about these
        sum(map(str.istitle, words)) / (n + 5),
        len(lines) / (n + 5),
        1 - len(set(lines)) / max(1, len(lines)),
        text.count("|") / n,
    ]
    return [np.log1p(len(words)), np.log(max(1.0, inked / n)), *np.log(np.maximum(shares, 0) + 0.01)]


STATISTICS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())),
])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every row (a null text is empty), stored."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    return materialize(docs.select("doc_id", "text").mapInArrow(compute, STATISTICS_SCHEMA), "quality-statistics")


class Discriminant:
    """Class means and Cholesky factors of the shrunk covariances."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray,
                 shrink: float = SHRINK, ridge: float = RIDGE):
        total = counts.sum()
        self.means = sums / np.maximum(counts, 1)[:, None]
        scatter = [products[c] - counts[c] * np.outer(self.means[c], self.means[c]) for c in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / max(1.0, total - 2)
        self.factors, self.log_dets = [], []
        for c in (0, 1):
            own = scatter[c] / max(1.0, counts[c] - 1)
            mixed = (1 - shrink) * own + shrink * pooled
            diagonal = np.diag(mixed)
            shrunk = (1 - ridge) * mixed + ridge * np.diag(0.5 * diagonal + 0.5 * max(diagonal.mean(), 1e-3))
            factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(len(shrunk)))
            self.factors.append(np.linalg.inv(factor))
            self.log_dets.append(2 * np.log(np.diag(factor)).sum())
        self.prior = np.log((counts[1] + 1) / (counts[0] + 1))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the prior, on a signed logarithmic scale."""
        density = [
            -0.5 * ((x - self.means[c]) @ self.factors[c].T) ** 2 @ np.ones(x.shape[1]) - 0.5 * self.log_dets[c]
            for c in (0, 1)
        ]
        gap = density[1] - density[0] + self.prior
        return np.sign(gap) * np.log1p(np.abs(gap))


def _matrix(column) -> np.ndarray:
    values = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def class_sums(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products of the statistics by class, over all rows (x, y)."""
    k = len(STATISTICS)
    width = 1 + k + k * k

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(2 * width, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"]
        )

    total = np.zeros(2 * width)
    sums = labelled.select("x", "y").mapInArrow(add, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # a few hundred cells
        total[r["cell"]] = r["v"]
    total = total.reshape(2, width)
    return total[:, 0], total[:, 1 : k + 1], total[:, k + 1 :].reshape(2, k, k)


def fit(stats: DataFrame, labels: DataFrame, sample: int = CALIBRATION_ROWS) -> tuple[Discriminant, np.ndarray]:
    """The discriminant from all training rows, and the logistic curve from at most ``sample`` of them."""
    labelled = materialize(
        stats.join(training_labels(labels, "quality", FOLDS, HELD), "doc_id").select("doc_id", "x", "y"), "quality-labelled"
    )
    model = Discriminant(*class_sums(labelled))
    drawn = least_hashes(labelled, sample, "doc_id", "x").select("x", "y").collect()
    if len({r["y"] for r in drawn}) < 2:
        return model, np.array([0.0, 4.0 if not drawn or drawn[0]["y"] else -4.0])
    z = model.difference(np.array([r["x"] for r in drawn]))
    return model, logistic(z[:, None], np.array([r["y"] for r in drawn], dtype=float), ridge=1e-4)


SCORE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
])


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: better), predicted (1: score of ``keep`` or more).

    Labels are used of rows outside the held-out fold only. Null and empty texts get a score
    like any other, very long ones are read whole; repeated rows come out each, with one score;
    of several labels of a doc_id the largest counts; an empty table gives no rows, other
    columns are ignored. Without labels of both classes every score is the known class's.
    """
    stats = document_statistics(docs)
    model, curve = fit(stats, labels)
    return _scored(stats, model, curve, keep)


def _scored(stats: DataFrame, model: Discriminant, curve: np.ndarray, keep: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sigmoid(curve[0] * model.difference(_matrix(batch.column("x"))) + curve[1]) if batch.num_rows else np.empty(0)
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fold(i, FOLDS) == HELD for i in ids], pa.bool_()),
                 pa.array(p), pa.array((p >= keep).astype(np.int32))], names=SCORE_SCHEMA.names,
            )

    return stats.mapInArrow(score, SCORE_SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is ``keep`` or more, unchanged.

    The model is fitted as in :func:`score_quality`; then each text is scored where it is
    read, so no text is shuffled. Null and empty texts are judged as texts of no words, very
    long ones whole, rows without doc_id like any row, repeated rows alike; all columns are
    kept, whatever their names; an empty table stays empty.
    """
    model, curve = fit(document_statistics(docs), labels)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py() or "") for t in batch.column("text")])
                yield batch.filter(pa.array(sigmoid(curve[0] * model.difference(x) + curve[1]) >= keep))

    return docs.mapInArrow(chosen, docs.schema)

"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics, transformed towards normal shape, have a mean and a
covariance per class. Covariances are shrunk towards their pooled diagonal.
The score is the logistic of the difference of the classes' Mahalanobis log
densities, computed from cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slim, tune
from .docstats import Doc

#: Share of a class covariance that its shrinkage target gets, and the least variance of a feature.
SHRINK, FLOOR = 0.2, 0.002
#: The log density ratio is divided by this before the logistic: neighbouring features are not independent.
TEMPER = 4.0


def features(text: str) -> list[float]:
    """Transformed statistics of a text; all are finite, an empty text's too."""
    d = Doc(text)
    n, chars, letters, lines = max(1, d.n_words), max(1, d.n_chars), max(1, d.n_letters), max(1, len(d.lines))
    return [
        np.log1p(d.n_words), np.log1p(d.word_chars / n), np.sqrt(d.n_symbols / n), np.sqrt(1 - d.n_wordlike / n), np.sqrt(d.n_upper / letters), np.sqrt(d.n_digits / chars),
        np.sqrt(min(3.0, d.n_shouts / n)), np.sqrt(d.n_dup_lines / lines), np.sqrt(d.n_repeat_words / n), d.n_distinct / n, np.log1p(d.n_words / lines), np.sqrt(d.n_top_word / n),
        np.sqrt(d.n_sentence_ends / n), d.n_letters / chars,
    ]


#: What features are taken from before they are squared and summed: those of a plain text, so that sums lose no digits.
CENTER = np.array(features("They walked along the river until the light had gone, and nobody spoke of it again.\n" * 3))
SIZE = len(CENTER)


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: prior, mean, Cholesky factor, its inverse (also triangular) and its log determinant per class."""

    priors: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for the rows of ``x``."""
        logs = []
        for c in (0, 1):
            z = self.inverses[c] @ (x - self.means[c]).T
            logs.append(np.log(self.priors[c]) - 0.5 * (z * z).sum(0) - self.log_dets[c])
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPER, -50, 50)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """From each class's count, sum of features and sum of their outer products (of features less ``CENTER``).

    A class without rows takes the pooled mean and covariance, so a model can
    be fitted to any labels, none included.
    """
    total = max(1.0, counts.sum())
    pooled_mean = sums.sum(0) / total
    pooled = squares.sum(0) / total - np.outer(pooled_mean, pooled_mean)
    means, covs = [], []
    for c in (0, 1):
        mean = sums[c] / counts[c] if counts[c] else pooled_mean
        means.append(mean + CENTER)
        covs.append(squares[c] / counts[c] - np.outer(mean, mean) if counts[c] else pooled)
    within = sum(max(1.0, counts[c]) * np.diag(covs[c]) for c in (0, 1)) / max(2.0, total)
    factors = [np.linalg.cholesky((1 - shrink) * covs[c] + shrink * np.diag(within) + FLOOR * np.eye(SIZE)) for c in (0, 1)]
    priors = tuple((counts + 1) / (counts.sum() + 2))
    inverses = [np.tril(np.linalg.inv(f)) for f in factors]
    return Discriminant(priors, np.array(means), np.array(factors), np.array(inverses), np.array([np.log(np.diag(f)).sum() for f in factors]))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, q = np.zeros(2), np.zeros((2, SIZE)), np.zeros((2, SIZE, SIZE))
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
        y = np.array(batch.column("label").to_pylist(), int)
        for c in (0, 1):
            own = x[y == c] - CENTER
            n[c] += len(own)
            s[c] += own.sum(0)
            q[c] += own.T @ own
    flat = np.concatenate([np.concatenate([[n[c]], s[c], q[c].ravel()]) for c in (0, 1)])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])


def fit_table(labelled: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """Fit on a table (x array<double>, label int 0 or 1). Only sums reach the driver: their number is fixed."""
    width = 1 + SIZE + SIZE * SIZE
    found = labelled.mapInArrow(_sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * width)
    for row in found:
        flat[row["at"]] = row["v"]
    flat = flat.reshape(2, width)
    return fit(flat[:, 0], flat[:, 1 : 1 + SIZE], flat[:, 1 + SIZE :].reshape(2, SIZE, SIZE), shrink)


def _score(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            p = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; the model is fitted on all labelled rows that are not held out.

    A null or empty text gets a score like any other. Labels other than 0 and
    1, null ids and labels of unknown documents are not used; of a document
    with both labels both count. Repeated rows get a row each; an empty table
    gives an empty result. A class without labels makes scores depend on the
    priors alone.
    """
    tune(docs.sparkSession)
    x = materialize(slim(docs, id_col, text_col).mapInArrow(_featurize, "doc_id long, x array<double>"), "classifier-features")
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("label_id"))).distinct()
    model = fit_table(x.join(known, F.col("doc_id") == F.col("label_id")).select("x", "label"))
    scored = x.mapInArrow(_score(model, threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

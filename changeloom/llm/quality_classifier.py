"""Quality classifier: regularised quadratic discriminant analysis (operator 1).

Each class has a mean and a covariance over transformed document statistics (``textstats.features``). A class covariance
is shrunk towards the pooled one by ``SHRINK`` and towards its own scaled diagonal by ``RIDGE``; its Cholesky factor is
computed once and travels with the model. A document's score is a logistic function of the difference of the two log
densities, which are Mahalanobis distances by triangular solves plus the log determinants; slope and offset of that
function are fitted on the training rows, so the score is a probability.

The model is fitted on at most ``SAMPLE`` labelled rows, those of least hash among the rows whose crc32(doc_id) modulo 5
is not 0. Only the text is an input of a score. All documents are scored.

Null text counts as empty and is scored by the same statistics (all zero). Without labels of both classes every score
is 0.5. Very long texts are read whole, a small multiple of their size in memory. Labels that repeat a document all count, and
ties of the sample's order go by id. Repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_arrow, texts_of
from .textstats import counts as counts_of
from .textstats import features, held_out, labelled_counts, with_counts

#: Labelled rows that are used at most; shares of the pooled covariance and of the diagonal; clipping of standardised
#: statistics; score from which a document counts as good.
SAMPLE, SHRINK, RIDGE, CLIP, THRESHOLD = 20_000, 0.15, 0.05, 6.0, 0.3


@dataclass
class Discriminant:
    """Centre and scale of the statistics; mean, inverse Cholesky factor and log determinant by class; logistic map."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, counts: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        x = np.clip((features(counts)[1] - self.centre) / self.scale, -CLIP, CLIP)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return density[1] - density[0]

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(counts) + self.offset, -30, 30)))


def fit(counts: np.ndarray, labels: np.ndarray) -> Discriminant | None:
    """The discriminant for labelled counts; None unless both classes have two rows."""
    if min((labels == k).sum() for k in (0, 1)) < 2:
        return None
    raw = features(counts)[1]
    centre, scale = np.median(raw, axis=0), np.maximum(raw.std(axis=0), 1e-3)
    x = np.clip((raw - centre) / scale, -CLIP, CLIP)
    own = [np.cov(x[labels == k].T) for k in (0, 1)]
    pooled = sum((labels == k).mean() * own[k] for k in (0, 1))
    means, factors, logdets = [], [], []
    for k in (0, 1):
        c = (1 - SHRINK) * own[k] + SHRINK * pooled
        c = (1 - RIDGE) * c + RIDGE * (np.diag(np.diag(c)) + np.eye(len(c)))
        root = np.linalg.cholesky(c)
        means.append(x[labels == k].mean(axis=0))
        factors.append(np.linalg.solve(root, np.eye(len(root))))
        logdets.append(2 * float(np.log(np.diag(root)).sum()))
    model = Discriminant(centre, scale, means, factors, logdets)
    d, w = np.clip(model.difference(counts), -200, 200), np.zeros(2)
    design = np.column_stack([d / 10, np.ones(len(d))])
    for _ in range(50):  # Newton steps for the logistic map, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - labels) + 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 2 / max(np.abs(step).max(), 1e-9))
    model.slope, model.offset = float(max(w[0] / 10, 1e-3)), float(w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Discriminant | None:
    """Fit on the documents' labels; see the module."""
    return fit(*labelled_counts(docs, labels, most))


def score(docs: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def made(ids: pa.Array, counts: np.ndarray) -> list[pa.Array]:
        found = model.scores(counts) if model else np.full(len(counts), 0.5)
        return [ids, pa.array(found), pa.array((found >= threshold).astype(np.int32))]

    return with_counts(docs, made, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all of their columns, whose score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and model:
                found = np.array([counts_of(x) for x in texts_of(b["text"])], dtype=np.int64)
                b = b.filter(pa.array(model.scores(found) >= threshold))
            yield b

    return in_arrow(docs, run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

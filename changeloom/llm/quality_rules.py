"""Quality rules: base limits, then gradient-boosted trees over document statistics (operator 9).

The trees are trained here on histograms of at most ``SAMPLE`` labelled documents (``textstats.labelled_counts``) with the
logistic loss. Features in ``MONOTONE`` may only lower or only raise the verdict: a split that would break this is not
taken, and the bounds of its two sides are handed down. The trained trees are flattened into numpy node arrays
(feature, threshold, left, right, value) and scored for a whole batch at once, level by level.

Null text has no words, and so fails the base rules, as do empty texts. Without labels of both classes the base rules
decide alone. Very long texts are read whole; of equal gains the first feature and the least threshold split, and a probability
just at the limit keeps. Repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textstats import COUNTS, features, labelled_counts, with_counts

#: Labelled rows used at most; trees, depth, step, bins, ridge, least weight of a leaf; probability from which to keep.
SAMPLE, TREES, DEPTH, STEP, BINS, RIDGE, LEAST, KEEP = 20_000, 60, 3, 0.2, 64, 1.0, 4.0, 0.4
#: -1: more of it never makes the verdict better; 1: never worse.
MONOTONE = {"symbols": -1, "adjacent": -1, "repeats": -1, "dup_lines": -1, "distinct": 1}


@dataclass
class Trees:
    """Flattened trees, a row of nodes each; a leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows of features."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                below = x[rows, self.feature[t][at]] <= self.threshold[t][at]
                at = np.where(below, self.left[t][at], self.right[t][at])
            out += self.value[t][at]
        return out


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, signs: list[int]) -> list[tuple]:
    """One tree's nodes (feature, threshold, left, right, value) for gradients ``g`` and curvatures ``h``."""
    nodes: list[list] = []

    def node(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + RIDGE), low, high))
        nodes.append([0, 0.0, me, me, STEP * value])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(bins.shape[1]) if depth < DEPTH else ():
            gl = np.bincount(bins[rows, f], g[rows], BINS).cumsum()[:-1]
            hl = np.bincount(bins[rows, f], h[rows], BINS).cumsum()[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
            gain = -(gl * vl + 0.5 * (hl + RIDGE) * vl**2) - (gr * vr + 0.5 * (hr + RIDGE) * vr**2) + (gs * value + 0.5 * (hs + RIDGE) * value**2)
            gain[(hl < LEAST) | (hr < LEAST) | (signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(gain.argmax())
            if gain[k] > best[0] and k < len(edges[f]):
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f >= 0:
            below, middle = bins[rows, f] <= k, (vl + vr) / 2
            bound = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[signs[f]]
            nodes[me][:2] = f, float(edges[f][k])
            nodes[me][2] = node(rows[below], depth + 1, *bound[:2])
            nodes[me][3] = node(rows[~below], depth + 1, *bound[2:])
        return me

    node(np.arange(len(g)), 0, -np.inf, np.inf)
    return nodes


def fit(counts: np.ndarray, labels: np.ndarray) -> Trees | None:
    """Boosted trees for labelled counts; None unless both classes have a row."""
    if not len(labels) or labels.min() == labels.max():
        return None
    names, x = features(counts)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    signs = [MONOTONE.get(n, 0) for n in names]
    base = float(np.log(labels.mean() / (1 - labels.mean())))
    margin, grown = np.full(len(labels), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grown.append(flat([grow(bins, edges, p - labels, p * (1 - p), signs)], 0.0))
        margin += grown[-1].margin(x)
    return Trees(*[np.concatenate([getattr(t, k) for t in grown]) for k in ("feature", "threshold", "left", "right", "value")], base)


def flat(trees: list[list], base: float) -> Trees:
    """Node arrays of equal width."""
    width = 2 ** (DEPTH + 1) - 1
    cols = [np.zeros((len(trees), width), dtype=k) for k in (np.int64, np.float64, np.int64, np.int64, np.float64)]
    for t, nodes in enumerate(trees):
        for i, row in enumerate(nodes):
            for c, v in zip(cols, row, strict=True):
                c[t, i] = v
    return Trees(*cols, base)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees | None:
    """Fit on the documents' labels; see the module."""
    return fit(*labelled_counts(docs, labels, most))


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """The base counts of every document, whether the base rules fail, and the verdict."""

    def made(ids: pa.Array, counts: np.ndarray) -> list[pa.Array]:
        c = dict(zip(COUNTS, counts.T, strict=True))
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        p = 1 / (1 + np.exp(-trees.margin(features(counts)[1]))) if trees else np.ones(len(counts))
        shown = [pa.array(c[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return [ids, *shown, pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)]

    return with_counts(docs, made, RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

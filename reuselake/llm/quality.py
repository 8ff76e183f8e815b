"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are native columns. Trees are fitted on about ``fit_rows`` labelled rows at the driver (histograms of binned
features, second-order logistic loss) and flattened into arrays; each Arrow batch of statistics walks all trees with numpy at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.rules import labelled_stats
from reuselake.llm.text_stats import features, with_stats

FIT_ROWS = 20_000
FOLDS, HELD = 4, 2


@dataclass
class Trees:
    """Complete binary trees in heap order: node k has children 2k+1 and 2k+2. A node that was not split sends all rows left."""

    depth: int
    start: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): go right if above
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for labels 0/1. Without rows, or with one label only, the score is a smoothed share of label 1."""
    n, width = x.shape
    base = (y.sum() + 1) / (n + 2)
    start = float(np.log(base / (1 - base)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(depth, start, feature[:0], cut[:0], value[:0])
    edges = []
    for j in range(width):
        v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)))
        edges.append((v[1:] + v[:-1]) / 2)
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for j in range(width):
                m = len(edges[j]) + 1
                if m == 1:
                    continue
                key = (at - first) * m + binned[:, j]
                gs, hs = (np.bincount(key, w, count * m).reshape(count, m).cumsum(1) for w in (g, h))
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                gain[(hl < least) | (ha - hl < least)] = 0
                k = gain.argmax(1)
                for node in np.nonzero(gain[np.arange(count), k] > best)[0]:
                    best[node] = gain[node, k[node]]
                    feature[t, first + node], cut[t, first + node] = j, edges[j][k[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        total += value[t, leaf]
    return Trees(depth, start, feature, cut, value)


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id has no remainder: neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    _, x, quality, _ = labelled_stats(docs, labels, fit_rows, keep=~held_out())
    return fit_trees(x, quality.astype(float))


def with_score(docs: DataFrame, model: Trees, into: str = "_score") -> DataFrame:
    """Add the score (0 to 1, higher: label 1 likelier). Null and empty texts are scored by their zero statistics."""
    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(model.score(rows.to_numpy(float)))

    cols = features()
    return with_stats(docs).withColumn(into, walk(F.struct(*(c.alias(k) for k, c in cols.items())))).drop("_stats")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.7, 1).otherwise(0).alias("predicted"))

"""Learned decision lists: quality rules grown and pruned from labelled statistics.

Sequential covering: a rule is a conjunction of threshold tests on size-free statistics. It is grown on two thirds
of the labelled rows by information gain, pruned from its end on the other third, and kept while it is
precise there; the rows it covers are then set aside and the next rule is grown. The list becomes one ordered ``CASE WHEN``
expression, so that applying it is plain native Spark over each text's own statistics: no shuffle, no Python.

The fit reads about ``fit_rows`` labelled rows (their statistics, not their texts, reach the driver). Applying covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import aside, fraction_rule
from reuselake.llm.text_stats import features, with_stats

FIT_ROWS = 10_000
MIN_WORDS = 50
MAX_REPEATED = 50


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self, cols: dict[str, Column]) -> Column:
        return cols[self.feature] > self.threshold if self.above else cols[self.feature] <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in rule:
        v = x[:, names.index(t.feature)]
        hit &= v > t.threshold if t.above else v <= t.threshold
    return hit


def _grow(names: list[str], x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most_tests: int) -> Rule:
    rule: Rule = ()
    live = np.ones(len(x), bool)
    while len(rule) < most_tests and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        if not p0:
            break
        best = (1e-9, None, None)
        for j, name in enumerate(names):
            for cut in cuts[j]:
                for above in (True, False):
                    hit = live & ((x[:, j] > cut) if above else (x[:, j] <= cut))
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Test(name, above, float(cut)), hit)
        if best[1] is None:
            break
        rule, live = (*rule, best[1]), best[2]
    return rule


def learn_rules(
    names: list[str], x: np.ndarray, bad: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_tests: int = 3, precision: float = 0.97, cover: int = 5,
) -> list[Rule]:
    """Ordered rules that each reject. ``fold`` (0 to 2) splits rows: 2 prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    cuts = []
    for j in range(len(names)):
        v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65))) if len(x) else np.array([])
        cuts.append((v[1:] + v[:-1]) / 2)
    while len(rules) < most_rules:
        g, q = left & (fold != 2), left & (fold == 2)
        rule = _grow(names, x[g], bad[g], cuts, most_tests)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], names, x[q])
            p, n = (hit & bad[q]).sum(), (hit & ~bad[q]).sum()
            worth.append(((p - n) / max(p + n, 1), p, p / max(p + n, 1), k))
        value, p, exact, k = max(worth, key=lambda w: (w[0], w[1], -w[3]))
        if exact < precision or p < cover:
            break
        rules.append(rule[:k])
        left &= ~_covers(rule[:k], names, x)
    return rules


def labelled_stats(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: Column | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Feature names, rows, quality labels (0/1) and doc_ids of about ``fit_rows`` labelled documents.

    Labels that are null or not 0/1, and null ids, are not used; of several labels of an id the lowest counts.
    ``keep`` restricts the ids that may be used at all.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    chosen = known.where(fraction_rule(F.col("doc_id"), known.count(), fit_rows))  # bounded by fit_rows, so it may be broadcast
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    cols = features()
    rows = with_stats(named).select("doc_id", "_quality", *(c.alias(k) for k, c in cols.items()))
    got = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    x = np.array([[r[k] for k in cols] for r in got], float).reshape(len(got), len(cols))
    return list(cols), x, np.array([r["_quality"] for r in got], int), np.array([r["doc_id"] for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    names, x, quality, ids = labelled_stats(docs, labels, fit_rows)
    usable = [i for i, n in enumerate(names) if n != "words"]  # rules judge texture; length is the base rule's matter
    return learn_rules([names[i] for i in usable], x[:, usable], quality == 0, (ids * 2654435761 >> 8) % 3)


def verdict(rules: list[Rule], stats: str = "_stats") -> Column:
    """Ordered conditional: the number (from 1) of the first rule that rejects, 0 if none does."""
    cols, out = features(stats), None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for t in rule:
            test = test & t.column(cols)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``_stats``, ``_base_failed``, ``_rule`` (0: none) and ``_kept``. A null or empty text has no words and fails the base."""
    s = lambda c: F.col(f"_stats.{c}")
    failed = (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > MAX_REPEATED * s("n_words"))
    return with_stats(docs).withColumn("_base_failed", failed).withColumn("_rule", verdict(rules)).withColumn("_kept", ~F.col("_base_failed") & (F.col("_rule") == 0))


def kept(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that base rule and ``rules`` keep, with the columns of ``docs`` whatever they are called."""
    named, back = aside(docs, "text")
    return back(apply_rules(named, rules).where("_kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = apply_rules(docs, fit(docs, labels))
    base = [F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))

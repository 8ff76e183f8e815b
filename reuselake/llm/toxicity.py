"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs with one word between them, hashed into ``SLOTS``
coordinates. FTRL-proximal keeps two sums per coordinate: rates shrink with a coordinate's own gradients, and a coordinate whose
evidence stays below ``l1`` has weight exactly 0. What is left are a few thousand weights at most, sent to the tasks as two small arrays.

The fit reads at most about ``fit_toxic`` + ``fit_clean`` labelled rows (their feature numbers reach the driver, not their texts); the
bias is then moved to the classes' true shares. Scoring covers every row and whole texts, with numpy over Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import fraction_rule
from reuselake.llm.hashing import mix
from reuselake.llm.tokens import byte_kinds, chunks, split

SLOTS = 1 << 22
FIT_TOXIC, FIT_CLEAN = 4_000, 6_000
FOLDS, HELD = 3, 1
#: Texts of about so many bytes are worked on together.
CHUNK_BYTES = 1_000_000
#: ASCII characters that are neither letters nor digits separate words.
KINDS = byte_kinds(bytes(c for c in range(128) if not chr(c).isalnum()))


@dataclass
class Weights:
    bias: float
    slot: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float32)
        out[self.slot] = self.weight
        return out


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of each feature, once per text, in order. ``wanted`` flags the slots to return."""
    words = split([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], KINDS)
    code = mix(np.array([zlib.crc32(w) for w in words.distinct], np.uint64) + np.uint64(1))[words.word] if len(words.word) else np.zeros(0, np.uint64)
    owners, slots = [], []
    for span in (1, 2, 3):  # the word, its neighbour, the one after
        at = words.windows(span, words.text)
        value = code[at] if span == 1 else mix(code[at] * np.uint64(2 * span + 1) + code[at + span - 1])
        slot = (value & np.uint64(SLOTS - 1)).astype(np.int64)
        owner = words.text[at].astype(np.int64)
        if wanted is not None:
            hit = wanted[slot]
            slot, owner = slot[hit], owner[hit]
        owners.append(owner)
        slots.append(slot)
    pairs = np.unique(np.concatenate(owners) * SLOTS + np.concatenate(slots))
    return pairs // SLOTS, pairs % SLOTS


def fit_ftrl(rows: list[np.ndarray], toxic: np.ndarray, alpha: float = 10.0, beta: float = 1.0, l1: float = 3.5, l2: float = 0.01, steps: int = 50_000) -> Weights:
    """Online fit over ``rows`` (slots of each example) in the given order, again and again for about ``steps`` examples (5 to 20 times). One label or no rows: the smoothed share only."""
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Weights(bias, np.zeros(0, np.int64), np.zeros(0, np.float32))
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    bias_n = 0.0
    for _ in range(min(20, max(5, steps // len(rows)))):
        for slot, y in zip(rows, toxic, strict=True):
            zs, ns = z[slot], n[slot]
            w = weights(zs, ns)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[slot] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slot] = ns + g * g
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    used = np.nonzero(np.abs(z) > l1)[0]
    return Weights(float(bias), used, weights(z[used], n[used]).astype(np.float32))


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id has no remainder: neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Weights:
    """Learn from labelled rows that are not held out. Labels that are null or not 0/1 are not used; of several labels of an id the highest counts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    rule = F.when(F.col("_toxic") == 1, fraction_rule(F.col("doc_id"), ones, fit_toxic)).otherwise(fraction_rule(F.col("doc_id"), zeros, fit_clean))
    chosen = known.where(rule)  # bounded by the two parameters, so it may be broadcast

    @F.pandas_udf("array<int>")
    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                out.append(features([t])[1].astype(np.int32))
            yield pd.Series(out, dtype=object)

    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = named.select(F.xxhash64("doc_id").alias("h"), "doc_id", "_toxic", slots("text").alias("slots")).toArrow()
    table = found.sort_by([("h", "ascending"), ("doc_id", "ascending")])
    once = np.concatenate([[True], np.diff(table["doc_id"].to_numpy()) != 0]) if len(table) else np.zeros(0, bool)  # rows that repeat an id count once
    toxic = table["_toxic"].to_numpy().astype(int)[once]
    rows = [table["slots"][i].values.to_numpy() for i in np.nonzero(once)[0]]
    model = fit_ftrl(rows, toxic)
    odds = lambda a, b: np.log((a + 1) / (b + 1))
    return Weights(float(model.bias + odds(ones, zeros) - odds(toxic.sum(), len(toxic) - toxic.sum())), model.slot, model.weight)


def scores(texts: list[str | None], bias: float, dense: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    owner, slot = features(texts, wanted)
    return 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, dense[slot], len(texts)), -35, 35)))


def with_score(docs: DataFrame, model: Weights, into: str = "_score") -> DataFrame:
    """Add the score (0 to 1, higher: label 1 likelier). Null and empty texts have the bias as their only evidence."""
    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = model.dense()
        wanted = dense != 0
        for texts in batches:
            values = texts.tolist()
            parts = [scores([values[i] for i in c], model.bias, dense, wanted) for c in chunks([t or "" for t in values], CHUNK_BYTES)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(into, walk(F.col("text").cast("string")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.7, 1).otherwise(0).alias("predicted"))

"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word adds its per-language log frequency. An unseen word is cut into n-grams (with word edges), longest first; the
first length with a known n-gram speaks for the word by the mean of its known n-grams. A document takes the language with the
highest sum over all words of its whole text.

Counts come from about ``fit_docs`` training documents of each language (all, if it has fewer) and are made by Spark; the tables keep the
``max_words`` and ``max_grams`` most frequent entries of all languages together and the ``own`` most frequent of each, so the model that tasks
receive is bounded for a given number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import small_batches

FIT_DOCS = 4_000
MAX_WORDS = 50_000
MAX_GRAMS = 50_000
#: Words and n-grams that every language has room for, however rare it is.
OWN = 10_000
LONGEST = 5
#: Scored words that a Python worker remembers before it starts afresh.
REMEMBERED = 300_000
UNKNOWN = "und"
WORD = r"\p{L}[\p{L}\p{M}]*"
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id has no remainder: neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs, self.words, self.grams = langs, words, grams

    def word(self, word: str) -> np.ndarray:
        """Log frequency per language of a lower-case word."""
        known = self.words.get(word)
        if known is not None:
            return known
        edged = f"<{word}>"
        for n in range(min(LONGEST, len(edged)), 0, -1):
            found = [v for i in range(len(edged) - n + 1) if (v := self.grams.get(edged[i : i + n])) is not None]
            if found:
                return np.mean(found, 0)
        return np.zeros(len(self.langs))


class Memory(dict):
    """Word to row of ``scores``; unseen words are scored once."""

    def __init__(self, model: Model):
        self.model, self.scores = model, np.empty((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k == len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        self.scores[k] = self.model.word(word)
        return k


def predict(model: Model, texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    words, memory = regex.compile(WORD), Memory(model)
    for batch in texts:
        langs, scores = [], []
        for text in batch:
            found = words.findall(text.lower()) if text else ()
            if not found or not model.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.zeros(len(model.langs))
            for i in range(0, len(found), 65_536):  # a very long text in pieces, all of it
                rows = np.fromiter(map(memory.__getitem__, found[i : i + 65_536]), np.int64)
                total += memory.scores[rows].sum(0)
            best = int(total.argmax())
            langs.append(model.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
            if len(memory) > REMEMBERED:
                memory = Memory(model)
        yield pd.DataFrame({"lang_pred": langs, "score": scores})


def _log_frequencies(counts: DataFrame, key: str, langs: list[str], most: int, own: int) -> dict[str, np.ndarray]:
    """The ``most`` frequent keys, and the ``own`` most frequent of each language, with their smoothed log frequency per language."""
    wide = counts.groupBy(key).agg(
        *(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)), F.sum("n").alias("all"),
    ).persist()
    try:
        found = {r[key]: r for r in wide.orderBy(F.desc("all"), key).limit(most).collect()}
        for i in range(len(langs)):
            found.update((r[key], r) for r in wide.where(F.col(f"l{i}") > 0).orderBy(F.desc(f"l{i}"), key).limit(own).collect())
    finally:
        wide.unpersist()
    rows = list(found.values())
    seen = np.array([[r[f"l{i}"] for i in range(len(langs))] for r in rows], float).reshape(len(rows), len(langs))
    smooth = 0.5
    logs = np.log(seen + smooth) - np.log(seen.sum(0) + smooth * max(len(rows), 1))
    return {r[key]: v for r, v in zip(rows, logs, strict=True)}


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, own: int = OWN) -> Model:
    """Learn from text and non-null lang of documents that are not held out and have an id."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text"))
    steps = 1 << 30
    shares = [(r["lang"], min(steps, steps * fit_docs // r["count"])) for r in usable.groupBy("lang").count().collect()]
    share = F.create_map(*(F.lit(x) for pair in shares for x in pair)) if shares else F.create_map(F.lit(""), F.lit(0))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(steps)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = (
        chosen.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    )
    try:
        langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        words = _log_frequencies(counts, "word", langs, max_words, own)
        edged = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
        spans = counts.select("lang", "n", edged.alias("e"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k")).where("k <= length(e)")
        grams = spans.select("lang", "n", F.explode(F.expr("transform(sequence(1, length(e) - k + 1), i -> substring(e, i, k))")).alias("gram"))
        grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        return Model(langs, words, _log_frequencies(grams, "gram", langs, max_grams, own))
    finally:
        counts.unpersist()


def with_language(docs: DataFrame, model: Model, into: str = "_lang") -> DataFrame:
    """Add the struct ``into`` (lang_pred, score). Null texts, texts without a letter, and a model without languages give und, 0."""
    @F.pandas_udf("lang_pred string, score double")
    def tell(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from predict(model, texts)

    return small_batches(docs).withColumn(into, tell("text"))


def digest(docs: DataFrame) -> DataFrame:
    told = with_language(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", held_out().alias("held_out"), "_lang.lang_pred", "_lang.score")

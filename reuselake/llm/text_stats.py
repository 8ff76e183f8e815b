"""Statistics of whole texts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import empty_if_null, let

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(windows: Column) -> Column:
    """Words covered by a 3-word window whose hash occurs twice or more in the text."""
    def covered(order: Column) -> Column:  # (hash, place) in order: equal windows are neighbours
        last = F.size(order) - 1
        same = lambda i, j: F.get(order, i)["h"] == F.get(order, j)["h"]
        again = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        starts = F.transform(again, lambda i: F.get(order, i)["p"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.array_sort(placed), covered))

    return let(windows, counted)


def _windows(words: Column) -> Column:
    at = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) < 3, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), at))


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        _repeat_words(_windows(words)).cast("long").alias("n_repeat_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )


def with_stats(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    """Add the struct ``into``; a null text counts as empty (all zero). Texts are read whole."""
    t = empty_if_null(text)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    parts = docs.withColumns({  # each heavy part is a column of its own, so that it is computed once
        f"{into}_w": let(words, _of_words),
        f"{into}_l": let(lines, _of_lines),
        f"{into}_c": F.length(F.translate(t, SPACES, "")).cast("long"),
        f"{into}_s": _without(t, SYMBOLS).cast("long"),
        f"{into}_u": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        f"{into}_e": _without(t, "!").cast("long"),
    })
    own = [f"{into}_{k}" for k in "wlcsue"]
    return parts.withColumn(into, F.struct(
        *(F.col(f"{into}_w.{c}").alias(c) for c in ("n_words", "n_distinct_words", "n_repeat_words")),
        *(F.col(f"{into}_l.{c}").alias(c) for c in ("n_lines", "n_dup_lines")),
        *(F.col(f"{into}_{k}").alias(c) for k, c in (("c", "word_chars"), ("s", "n_symbols"), ("u", "n_upper"), ("e", "n_exclaim"))),
    )).drop(*own)


def features(stats: str = "_stats") -> dict[str, Column]:
    """Size-free quality features of a stats struct, all doubles; empty texts give zeros."""
    s = lambda c: F.col(f"{stats}.{c}")
    per = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    return {
        "words": s("n_words").cast("double"),
        "word_length": per(s("word_chars"), s("n_words")),
        "symbols": per(s("n_symbols"), s("word_chars")),
        "repeated_words": per(s("n_repeat_words"), s("n_words")),
        "repeated_lines": per(s("n_dup_lines"), s("n_lines")),
        "line_words": per(s("n_words"), s("n_lines")),
        "distinct_words": per(s("n_distinct_words"), s("n_words")),
        "upper_case": per(s("n_upper"), s("word_chars")),
        "exclamations": per(s("n_exclaim"), s("word_chars")),
    }

"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

A line goes if an equal line, or one within ``threshold`` character edits, stands earlier in the corpus (by doc_id, then line
number). Lines without a word always stay; lines shorter than ``min_chars`` are compared for equality only.

Distinct lines are joined, so copies cost nothing. A line is cut into threshold + 1 segments of near-equal length; of
two lines within the threshold one shares a segment with the other at a place that the lengths and the segment's number narrow down
to a few (multi-match-aware selection), so each line probes a short list of substrings. Keys are (length, segment number,
substring) hashes. Lines that share a segment with many others, as near copies of one text do, meet on all but threshold of more segments
instead, and each crowd compares its members with its earliest line first. Candidates are verified by the banded edit distance on the lines themselves.
"""

from __future__ import annotations

import json
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reuselake.llm.common import aside, empty_if_null, stored
from reuselake.llm.text_stats import WORD

THRESHOLD = 2
MIN_CHARS = 20
#: A key with more indexed lines is crowded; it decides how pairs are found, not which.
MOST = 32
#: Segments of the lines of crowded keys.
FINE = 8
#: Orders occurrences by doc_id (null last), then line number; lines of a document are below 2**31.
_PLACE = "decimal(38,0)"


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """Every line with a word: doc_id, ``keep``, pos (from 0), line, place."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.posexplode(F.split(empty_if_null(), "\n", -1)).alias("pos", "line"))
    place = F.coalesce("doc_id", F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("pos")
    return parts.where(F.col("line").rlike(WORD)).withColumn("place", place.cast(_PLACE))


def _segment(length: Column, i: int | Column, threshold: int) -> tuple[Column, Column]:
    """Begin (from 0) and length of segment ``i`` of a line of ``length`` characters; the last ones are the longer ones."""
    parts = threshold + 1
    base, short = F.floor(length / parts), parts - length % parts
    return i * base + F.greatest(F.lit(0), F.lit(i) - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _key(length: Column, i: int | Column, begin: Column, size: Column) -> Column:
    inside = (begin >= 0) & (begin + size <= F.col("n"))
    return F.when(inside, F.xxhash64(length.cast("int"), F.lit(i), F.substring("line", (begin + 1).cast("int"), size.cast("int"))))


def indexed(lines: DataFrame, *keep: str | Column, threshold: int = THRESHOLD) -> DataFrame:
    """Keys (``keep``, key) of lines (line, n): their own segments."""
    rows = lines.select(*keep, "line", "n", F.explode(F.lit(list(range(threshold + 1)))).alias("_i"))
    key = _key(F.col("n"), F.col("_i"), *_segment(F.col("n"), F.col("_i"), threshold))
    return rows.withColumn("key", key).drop("line", "n", "_i")


def probes(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Keys (other, key) of lines (id, line, n) of the same or a smaller length that could be within the threshold.

    One short expression for all ways to ask: a projection that spells each of them out is too long a method for the JVM to compile.
    """
    ways = [
        [less, i, shift] for less in range(threshold + 1) for i in range(threshold + 1)
        for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)
    ]
    way = F.explode(F.from_json(F.lit(json.dumps(ways)), "array<array<int>>")).alias("_way")
    less, i, shift = (F.col("_way")[k] for k in range(3))
    length = F.col("n") - less
    begin, size = _segment(length, i, threshold)
    key = _key(length, i, begin + shift, size).alias("key")
    return lines.select(F.col("id").alias("other"), "line", "n", way).select("other", key).where("key is not null")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines (id, line, place of the first, times) from rows (line, place), grouped by a 64-bit id.

    All uses name the same columns, so that Spark shuffles the lines once. Should two lines ever have one id, both are left out and stay in the corpus.
    """
    rows = lines.select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("proof"), "line", "place")
    groups = rows.groupBy("id").agg(
        F.min("line").alias("line"), F.min("place").alias("place"), F.min("proof").alias("_p"), F.max("proof").alias("_q"), F.count("*").alias("times"),
    )
    return groups.where("_p = _q and place is not null and line is not null and times > 0").select("id", "line", "place", "times")


def _met(put: DataFrame, ask: DataFrame, most: int | None) -> DataFrame:
    """Pairs (id, other, hot) of lines that share a key; keys of more than ``most`` indexed lines give their earliest line only and are hot.

    Hot keys pair a line with itself too, so every line that has one is an ``other``.
    """
    if most is None:
        put = put.withColumn("hot", F.lit(False))
    else:
        key = Window.partitionBy("key")
        put = put.withColumn("hot", F.count("*").over(key) > most).withColumn("_r", F.row_number().over(key.orderBy("doc", "id")))
        put = put.where(~F.col("hot") | (F.col("_r") == 1))
    pairs = put.join(ask, "key").where(F.col("hot") | (F.col("id") != F.col("other")))
    return pairs.groupBy("id", "other").agg(F.max("hot").alias("hot"))


def _compared(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """``pairs`` (id, other, ...) with both lines and places, and ``near``."""
    one = pairs.join(lines.select("id", "line", "place"), "id")
    two = lines.select(F.col("id").alias("other"), F.col("line").alias("_line"), F.col("place").alias("_place"))
    near = (F.col("place") != F.col("_place")) & F.levenshtein("line", "_line", threshold).between(0, threshold)
    return one.join(two, "other").withColumn("near", near)


def _later(compared: DataFrame) -> DataFrame:
    """The later line (id) of each near pair."""
    return compared.where("near").select(F.when(F.col("place") < F.col("_place"), F.col("other")).otherwise(F.col("id")).alias("id")).distinct()


def _fine_keys(lines: DataFrame, threshold: int, probe: bool, *keep: str) -> DataFrame:
    """Keys of all but ``threshold`` of the ``FINE`` segments: (key, ``keep``).

    Between two spoiled segments the rest of a line is shifted by what was inserted or deleted before; a line asks for its own and smaller lengths.
    """
    ways = []
    for spoiled in combinations(range(FINE), threshold):
        for less in range(threshold + 1 if probe else 1):
            # the shift of each stretch of whole segments: 0 before the first spoiled one, ``less`` after the last
            for between in product(range(-threshold, threshold + 1) if probe else (0,), repeat=max(threshold - 1, 0)):
                shifts = [0, *between, less] if threshold else [0]
                bounds = [-1, *spoiled, FINE]
                moved = sum(abs(y - x) for x, y in zip(shifts, shifts[1:], strict=False))
                idle = any(bounds[i + 1] - bounds[i] == 1 and shifts[i] not in (0, shifts[i - 1]) for i in range(1, threshold))
                if moved <= threshold and not idle:
                    ways.append([less, *(x for i in range(threshold + 1) for x in (bounds[i] + 1, bounds[i + 1], shifts[i]))])
    way = F.explode(F.from_json(F.lit(json.dumps(ways)), "array<array<int>>")).alias("_way")
    rows = lines.select("*", way).withColumn("_l", F.col("n") - F.col("_way")[0]).where("_l >= 0")
    begin = lambda i: i * F.floor(F.col("_l") / FINE) + F.greatest(F.lit(0), i - (FINE - F.col("_l") % FINE))
    pieces = []
    for k in range(threshold + 1):
        first, last, shift = (F.col("_way")[3 * k + j] for j in (1, 2, 3))
        start, size = begin(first) + shift, begin(last) - begin(first)
        inside = (size == 0) | ((start >= 0) & (start + size <= F.col("n")))
        pieces += [first, last, F.when(inside, F.substring("line", (start + 1).cast("int"), size.cast("int")))]
    whole = F.lit(True)
    for piece in pieces[2::3]:
        whole = whole & piece.isNotNull()
    return rows.select(F.when(whole, F.xxhash64(F.col("_l").cast("int"), *pieces)).alias("key"), *keep).where("key is not null")


def repeated(distinct: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """Rows (id, first, near) of the distinct lines that occur again (``first``: place of the first) or have an earlier one within the threshold.

    Lines meet on one of threshold + 1 segments; where more than ``most`` share one, each meets the earliest. Lines of such keys meet once more
    on all but threshold of ``FINE`` segments: first the earliest of a crowded key again, then those still without an earlier line meet all.
    """
    doc = F.expr("cast(place div 4294967296 as bigint)")
    with_length = lambda rows: rows.withColumn("n", F.length("line"))
    lines = with_length(distinct).where(F.col("n") >= max(min_chars, threshold + 1))
    put = indexed(lines, "id", doc.alias("doc"), threshold=threshold)
    ask = probes(lines, threshold)
    # pairs and copies in one table, as one job shuffles the lines once
    pairs = _compared(_met(put, ask, most), distinct, threshold)
    seen = stored(pairs.unionByName(distinct.where("times > 1").select("id", "place"), allowMissingColumns=True), "line-pairs")
    copies = seen.where("other is null").select("id", F.col("place").alias("first"))
    gone = stored(_later(seen), "near-lines")

    crowd = seen.where("hot").select(F.col("other").alias("id"), F.col("_line").alias("line"), F.col("_place").alias("place")).dropDuplicates(["id"])
    crowd = stored(with_length(crowd).withColumn("doc", doc), "crowded-lines")
    for turn in (most, None):
        open_ = crowd.join(gone.withColumn("decided", F.lit(True)), "id", "left").withColumn("open", F.col("decided").isNull())
        put = _fine_keys(open_, threshold, False, "id", "doc", "open", "place")
        ask = _fine_keys(open_, threshold, True, F.col("id").alias("other"), F.col("open").alias("_open"), F.col("place").alias("_place"))
        if turn is None:  # of a pair, the later one must still be open
            later = F.when(F.col("place") < F.col("_place"), F.col("_open")).otherwise(F.col("open"))
            pairs = put.join(ask, "key").where((F.col("id") != F.col("other")) & later).select("id", "other").distinct()
        else:
            pairs = _met(put, ask.where("_open"), turn).where("id <> other").select("id", "other")
        gone = stored(gone.unionByName(_later(_compared(pairs, crowd, threshold))).distinct(), "near-lines")
    return copies.join(gone.withColumn("near", F.lit(True)), "id", "full").select("id", "first", F.coalesce("near", F.lit(False)).alias("near"))


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, *keep: str) -> DataFrame:
    """Lines that go, as an equal or near line stands earlier: doc_id, ``keep``, pos.

    Of equal lines the one at the smallest (doc_id, pos) is first; rows of one doc_id are one document, a null doc_id is last.
    """
    lines = lines_of(docs, *keep)
    found = stored(repeated(distinct_lines(lines), threshold, min_chars), "repeated-lines")
    every = lines.select("doc_id", *keep, "pos", "place", F.xxhash64("line").alias("id"))
    return every.join(found, "id").where(F.col("near") | (F.col("place") > F.col("first"))).select("doc_id", *keep, "pos")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: lines with a word, how many of them go, and their numbers (from 0) in order. All of null, empty and blank texts stay."""
    found = repeated_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(F.split(empty_if_null(), "\n", -1), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"),
    )
    # null ids meet as well
    joined = rows.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text``; a document that loses every line with a word goes.

    Other columns stay as they are. Lines without a word, and null, empty and blank texts, stay.
    """
    named, back = aside(docs, "doc_id", "text")
    version = F.md5(empty_if_null().cast("binary"))
    found = repeated_lines(named.withColumn("_version", version), threshold, min_chars, "_version")
    removed = found.groupBy(F.col("doc_id").alias("_id"), F.col("_version").alias("_of")).agg(F.collect_set("pos").alias("_removed"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (version == F.col("_of"))
    marked = named.join(removed, same, "left")
    parts = F.split(empty_if_null(), "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains("_removed", i))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    left = F.col("_removed").isNull() | F.exists(kept, lambda x: x.rlike(WORD))
    return back(marked.where(left).withColumn("text", text))

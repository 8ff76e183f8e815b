"""Ranked search of many queries over many artifacts with an inverted index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reuselake.operators.skew import salted_join, shuffled
from reuselake.session import stored

# fixed values: column weights and the ranking's constants
WEIGHTS = {"fqn": 4.0, "title": 8.0, "description": 1.0, "body": 0.5}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WORD = r"[\p{L}\p{N}]+"
BAREWORD = r"^[A-Za-z0-9_\x{80}-\x{10FFFF}]+$"
SCORE_DIGITS = 6


def build_index(artifact: DataFrame, weights: dict[str, float] = WEIGHTS) -> dict[str, DataFrame]:
    """Index tables of artifacts with columns fqn, title, description, body.

    positions (token, fqn, col, pos) · postings (token, fqn, weighted frequency) · docs (fqn and
    its length) · text (the columns for the substring fallback).
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), F.lit(0))
    text = stored(artifact.select("fqn", "title", "description", "body"), "search-text")
    positions = reduce(DataFrame.unionByName, [
        text.select("fqn", F.lit(c).alias("col"), F.lit(w).alias("weight"), F.posexplode(words(c)).alias("pos", "token"))
        for c, w in weights.items()
    ])
    positions = stored(positions, "positions")
    return {
        "text": text, "positions": positions,
        "postings": stored(positions.groupBy("token", "fqn").agg(F.sum("weight").alias("tf")), "postings"),
        "docs": stored(
            text.select("fqn").join(shuffled(positions.groupBy("fqn").agg(F.count("*").alias("length"))), "fqn", "left").fillna(0, ["length"]),
            "doc-lengths",
        ),
    }


def _term_tokens(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, token) for every token that starts with the term.

    Each distinct token is spelled out into its prefixes, which turns the prefix test into an
    equality join.
    """
    spelled = vocabulary.select(
        "token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring("token", F.lit(1), i))).alias("term")
    )
    return spelled.join(shuffled(terms), "term")


def search(queries: DataFrame, index: dict[str, DataFrame], k: int) -> DataFrame:
    """The ``k`` most relevant artifacts per query: query, fqn, score, rank, matched_by."""
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "fqn")
    ranked = hits(queries, index).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query", "fqn", "score", "rank", "matched_by")


def hits(queries: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """All artifacts that match a query (column query), unordered: query, fqn, score, matched_by.

    Words are OR-ed prefixes ranked by BM25 over weighted columns. A query without any ranked hit,
    or with a word that is not a plain word, falls back to a substring match. Scores are compared
    at six decimals, ties go to the smaller fqn.
    """
    asked = queries.select("query").distinct()
    words = asked.select("query", F.explode(F.filter(F.split("query", r"\s+"), lambda w: w != "")).alias("word"))
    odd = words.filter(~F.col("word").rlike(BAREWORD)).select("query").distinct()
    plain = words.join(shuffled(odd), "query", "left_anti")
    terms = stored(
        plain.groupBy("query", F.lower("word").alias("term")).agg(F.count("*").alias("times"))
        .withColumn("pieces", F.regexp_extract_all("term", F.lit(WORD), F.lit(0))), "terms",
    )
    vocabulary = index["postings"].select("token").distinct()

    single = terms.filter(F.size("pieces") == 1).select(F.element_at("pieces", 1).alias("term"), F.col("term").alias("word")).distinct()
    hit1 = salted_join(index["postings"], _term_tokens(single, vocabulary), "token", "fqn").groupBy("word", "fqn").agg(
        F.sum("tf").alias("f")
    )
    # a word such as a_b is a phrase: its pieces follow each other, the last one as a prefix
    parts = terms.filter(F.size("pieces") > 1).select(
        F.col("term").alias("word"), F.size("pieces").alias("n"), F.posexplode("pieces").alias("i", "term")
    ).distinct()
    exact = parts.filter("i < n - 1").select("word", "n", "i", F.col("term").alias("token"))
    last = _term_tokens(parts.filter("i = n - 1"), vocabulary).select("word", "n", "i", "token")
    hit2 = (
        salted_join(index["positions"], exact.unionByName(last), "token", "fqn")
        .groupBy("word", "n", "fqn", "col", "weight", (F.col("pos") - F.col("i")).alias("start"))
        .agg(F.count_distinct("i").alias("got")).filter("got = n")
        .groupBy("word", "fqn").agg(F.sum("weight").alias("f"))
    )
    found = stored(hit1.unionByName(hit2), "term-hits")

    total = index["docs"].agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
    n, avg = total.select("n").scalar(), total.select("avg").scalar()
    df = found.groupBy("word").agg(F.count("*").alias("_df"))
    raw_idf = F.log((n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    idf = df.select("word", F.when(raw_idf > 0, raw_idf).otherwise(IDF_FLOOR).alias("idf"))
    norm = K1 * (1 - B + B * F.col("length") / avg)
    weighted = salted_join(found, idf, "word", "fqn").join(shuffled(index["docs"]), "fqn").select(
        "word", "fqn", (F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + norm)).alias("s")
    )
    scored = (
        salted_join(weighted, terms.select("query", F.col("term").alias("word"), "times"), "word", "fqn")
        .groupBy("query", "fqn").agg(F.round(F.sum(F.col("s") * F.col("times")), SCORE_DIGITS).alias("score"))
        .withColumn("matched_by", F.lit("ranked"))
    )
    scored = stored(scored, "ranked")
    unanswered = asked.join(shuffled(scored.select("query").distinct()), "query", "left_anti")
    return scored.unionByName(substring_hits(unanswered, index["text"]), allowMissingColumns=True).select(
        "query", "fqn", "score", "matched_by"
    )


def substring_hits(queries: DataFrame, text: DataFrame) -> DataFrame:
    """Artifacts whose fqn, title or description contains the query, letter case ignored.

    Both sides meet on one run of up to three letters of the query, an equality; the pattern
    itself is tested afterwards. ``%`` and ``_`` in a query are wildcards.
    """
    low = F.lower("query")
    literal = F.array_max(F.transform(F.split(low, "[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    asks = queries.select("query", F.substring(literal, 1, 3).alias("gram"))
    fields = ("fqn", "title", "description")
    joined = F.lower(F.concat_ws("\n", *fields))

    def grams(t):
        starts = F.sequence(F.lit(1), F.length(t))
        return F.flatten(F.array(*[F.transform(starts, lambda i: F.substring(t, i, F.lit(n))) for n in (1, 2, 3)]))

    spelled = text.select(*fields).select(
        *fields, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.length(joined) > 0, grams(joined)).otherwise(F.array())))).alias("gram")
    )
    pattern = F.concat(F.lit("%"), F.replace(low, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    # only asked runs are shuffled; the runs of three letters are few, however many the queries are
    asked = spelled.join(F.broadcast(asks.select("gram").distinct()), "gram", "left_semi")
    met = salted_join(asked, asks, "gram", "fqn").withColumn("_p", pattern)
    test = reduce(lambda a, b: a | b, [F.expr(f"coalesce(lower({c}) LIKE _p, false)") for c in fields])
    return met.filter(test).select("query", "fqn", F.lit("substring").alias("matched_by"))

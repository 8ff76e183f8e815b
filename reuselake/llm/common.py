"""What the corpus operators share: input columns, text keys, shared-folder tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reuselake.session import stored

__all__ = ["aside", "empty_if_null", "fraction_rule", "let", "small_batches", "stored", "table", "text_key"]


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with batches to Python of few bytes from here on: workers hold several copies of one, and long texts make batches large."""
    for key, most in (("maxBytesPerBatch", 4_000_000), ("maxRecordsPerBatch", 2_000)):
        docs.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return docs


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` renamed, so that no helper column can meet a user's, and the way back to the columns of ``docs``."""
    columns = docs.columns
    names = [c if c in own else f"aside{i}" for i, c in enumerate(columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit key of a whole text; equal texts have equal keys."""
    return F.unhex(F.md5(text.cast("binary")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def fraction_rule(key: Column, total: int, wanted: int) -> Column:
    """True for about ``wanted`` of ``total`` keys, the same ones on every run."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(steps)) < F.lit(min(steps, steps * wanted // max(total, 1)))

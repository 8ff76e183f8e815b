"""Proportional stratified interleaving: shards of equal row counts that all match the source mixture.

Rows are shuffled within their source by a seeded hash, ranked there, and placed on the unit interval at
``(rank - 1/2) / rows of the source``. Cutting the rows in that order into equal runs gives every shard
each source in proportion, to within one row of a source per cut.

No task sees a whole source: ranks are counts of hash buckets (summed first, then running totals) plus a
rank within one bucket. There are about ``sqrt(rows)`` buckets, so that neither a bucket nor the list of
buckets outgrows a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reuselake.llm.common import empty_if_null, stored


def _ranked(rows: DataFrame, groups: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """1-based rank ``name`` over (bucket, order) within ``groups``, and the group's row count."""
    keys = [*groups, bucket]
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy(*keys).count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .withColumn(f"{name}_of", F.sum("count").over(Window.partitionBy(*groups)))
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_inside", inside).join(counts, keys)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def shard_plan(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, source, shard, slot.

    A null text counts as empty (size 1, crc 0); a null source is a source of its own. Rows that agree in
    doc_id, text and source are interchangeable. Row counts of shards differ by at most one; slots
    run from 0 without a gap; with fewer rows than shards the rest of the shards stay empty. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = empty_if_null().cast("binary")
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "shard-rows")
    total = rows.count()
    buckets = max(1, math.isqrt(total))

    ties = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    rows = _ranked(rows, ["_stratum"], "_bucket", [F.col("_hash"), *ties], "_rank")

    middle = 2 * F.col("_rank") - 1  # the place of a row is middle / (2 * rows of its source)
    rows = rows.withColumn("_bucket", F.expr(f"(2 * _rank - 1) * {buckets} div (2 * _rank_of)")).withColumn("_all", F.lit(0))
    place = middle / (2 * F.col("_rank_of"))
    rows = _ranked(rows, ["_all"], "_bucket", [place, F.col("_stratum"), F.col("_rank")], "_at")

    at = F.col("_at") - 1
    return (
        rows.withColumn("shard", F.expr(f"int((_at - 1) * {shards} div {max(total, 1)})"))
        .withColumn("slot", at - F.expr(f"(shard * {total} + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.when(F.col("_stratum") != "", F.substring("_stratum", 2, 1 << 30)).alias("source"), "shard", "slot")
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str) -> None:
    """Write the documents (unique doc_id) as one folder per shard, each in slot order."""
    placed = docs.drop("shard", "slot").join(plan.select("doc_id", "shard", "slot"), "doc_id")
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    return shard_plan(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )

"""Landed API pages to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def flatten_pages(
    df: DataFrame, records: str, record_type: str, has_next: Column, source: str = "source", page: str = "page",
    body: str = "body", max_pages: int | None = None,
) -> DataFrame:
    """Records of each source's pages from 1 on, up to the first page that names no next or the first gap.

    ``records`` is the JSON member that holds the list, ``record_type`` its element type. ``max_pages`` is for callers who want
    fewer pages; there is no limit by default. The last page to take is a minimum per source, so no source is ordered or gathered as a whole.
    """
    inside = df.filter(F.col(page) >= 1)
    if max_pages is not None:
        inside = inside.filter(F.col(page) <= max_pages)
    inside = inside.withColumn("_more", F.coalesce(has_next, F.lit(False)))
    ended = inside.filter(~F.col("_more")).groupBy(source).agg(F.min(page).alias("_end"))
    # a missing page ends the sequence too: a page that should follow another (or be the first) and is not there
    due = inside.select(source, (F.col(page) + 1).alias(page)).unionByName(inside.select(source).distinct().withColumn(page, F.lit(1)))
    missing = due.join(inside.select(source, page), [source, page], "left_anti")
    gap = missing.groupBy(source).agg((F.min(page) - 1).alias("_gap"))
    last = gap.join(ended, source, "left").select(source, F.least("_gap", "_end").alias("_last"))
    parsed = F.from_json(body, f"struct<{records}: array<{record_type}>>")[records]
    return (
        inside.join(last, source).filter(F.col(page) <= F.col("_last"))
        .select(source, page, F.posexplode(parsed).alias("position", "record"))
    )

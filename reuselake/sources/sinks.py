"""Structured results for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_payload(df: DataFrame, out: str = "payload") -> DataFrame:
    """Each row as compact JSON without null members."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias(out))


def write_payload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)

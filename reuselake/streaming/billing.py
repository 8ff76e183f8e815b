"""Billable events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reuselake.operators.revenue import billable_events


def stream_billable_events(invoices: DataFrame, refunds: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the union of the invoice and refund feeds to a table; same rules as the batch form."""
    return (
        billable_events(invoices, refunds).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

"""Activity events as a stream: attribution, daily buckets, usage edges."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from reuselake.operators.telemetry import EDGE, attribute, resolve

LATE = "2 days"


def deduplicated(events: DataFrame, late: str = LATE, id: str = "event_id") -> DataFrame:
    """Each event once although feeds deliver at least once.

    State is kept for ``late``: an event older than the newest one by more than that is turned away, because
    nothing remembers any more whether it was seen.
    """
    return events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark(
        "event_ts", late
    ).dropDuplicatesWithinWatermark([id])


def attributed(events: DataFrame, binding: DataFrame, names) -> DataFrame:
    """Stream of events with consumer and artifact; the bindings are a static table."""
    return resolve(attribute(events, names), binding, "event_id")


def daily_buckets(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events per edge and day; a day closes ``late`` after its end."""
    return (
        events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", late)
        .groupBy(F.window("event_ts", "1 day").alias("w"), *EDGE)
        .agg(F.count("*").alias("events"), F.max("event_ts").alias("last_seen"))
        .select(*EDGE, F.col("w.start").cast("date").alias("day"), "events", "last_seen")
    )


def _write_batch(path: str):
    """Sink that writes each micro-batch to its own folder, replacing it on a retry."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_buckets(buckets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current count of every changed bucket; read with :func:`read_buckets`."""
    return (
        buckets.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(_write_batch(path)).trigger(availableNow=True).start()
    )


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every bucket."""
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct("events", "last_seen"), "batch_id")
    return rows.groupBy(*EDGE, "day").agg(newest.alias("n")).select(*EDGE, "day", "n.events", "n.last_seen")


def run_edges(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add up usage edges: every micro-batch stores its own daily counts and sightings.

    The stored rows are partial sums, never a shared total, and a retried batch replaces its own
    folder: running it twice changes nothing. An event is added to its own day however late it arrives; only
    behind :func:`deduplicated` are events left out that are older than its watermark (count them with :class:`DroppedRows`).
    """

    def add(df: DataFrame, batch_id: int) -> None:
        part = df.groupBy(*EDGE, F.col("event_ts").cast("date").alias("day")).agg(
            F.count("*").alias("events"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen")
        )
        _write_batch(path)(part, batch_id)

    return (
        events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Daily buckets merged over all batches, with first and last sighting."""
    return spark.read.parquet(path).groupBy(*EDGE, "day").agg(
        F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def compact_edges(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Merged rows of all batches written to a new folder as one batch, to bound reading cost."""
    read_edges(spark, path).write.mode("overwrite").parquet(f"{target}/batch_id=-1")
    return read_edges(spark, target)


class DroppedRows(StreamingQueryListener):
    """Counts, per query id, the rows that watermarks turned away, so that they are reported and not lost silently.

    Add it with ``spark.streams.addListener`` before a query starts; it sees every batch, however many there are.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = defaultdict(int)
        self.batches: dict[str, int] = defaultdict(int)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches[str(p.id)] += 1
        self.rows[str(p.id)] += sum(int(op.numRowsDroppedByWatermark) for op in p.stateOperators)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

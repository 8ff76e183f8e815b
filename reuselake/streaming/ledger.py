"""Usage edges kept as keyed state: each micro-batch upserts the buckets it touches, late and repeated events are settled.

Layout below one folder of the shared store; every part is named by its batch, so a batch that runs again replaces what it wrote before:

* ``state/version=V/bucket=B``: daily counts of the edges of one hash bucket as of batch V. A batch rewrites touched buckets only.
* ``pointer/batch_id=V``: which version of every bucket is current after batch V. Writing this one file is the switch: until then
  readers see the state before.
* ``ledger/batch_id=V/day=D``: the events counted, by day, so that a repeated event is recognised in a later batch.
* ``late/batch_id=V``: events that came behind the watermark, set aside for the batch job.
* ``clock/batch_id=V``: the newest event time after batch V. The watermark of a batch is the clock of the batch before less the delay.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reuselake.operators.skew import shuffled
from reuselake.operators.telemetry import EDGE
from reuselake.session import stored

BUCKETS = 16
LATE_DAYS = 2
_STATE = "consumer_key string, artifact_fqn string, usage_type string, day date, events bigint, first_seen timestamp, last_seen timestamp"
_EVENTS = "event_id bigint, event_ts timestamp, consumer_key string, artifact_fqn string, usage_type string"


class EdgeLedger:
    """Counts usage edges of a stream of attributed events (event_id, event_ts, consumer_key, artifact_fqn, usage_type).

    An event that comes no more than ``late_days`` behind the newest one counts once, in its own day, whatever batch it is in. Older ones
    are set aside and counted by :meth:`settled`. A null event_id is an event of its own; an event without a time is set aside and never counted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, late_days: int = LATE_DAYS):
        self.spark, self.path, self.buckets, self.late_days = spark, path.rstrip("/"), buckets, late_days

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        rows = events.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("event_ts").cast("timestamp").alias("event_ts"), *EDGE)
        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add).trigger(availableNow=True).start()

    def _read(self, part: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of the batches before ``before`` (all without it); none if nothing has been written yet."""
        try:
            rows = self.spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{self.path}/{part}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], f"{schema}, batch_id bigint")
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def _current(self, before: int | None = None) -> dict[int, int]:
        """Version of every bucket: at most ``buckets`` rows."""
        pointers = self._read("pointer", "bucket int, version bigint", before)
        newest = pointers.agg(F.max("batch_id")).first()[0]
        return {} if newest is None else {r.bucket: r.version for r in pointers.filter(F.col("batch_id") == newest).collect()}

    def _state(self, versions: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/state/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(_STATE).parquet(*folders) if folders else self.spark.createDataFrame([], _STATE)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Running it again with the same rows changes nothing."""
        put = lambda df, part: df.write.mode("overwrite").parquet(f"{self.path}/{part}/batch_id={batch_id}")
        clock = self._read("clock", "newest bigint", batch_id).agg(F.max("newest")).first()[0]  # microseconds, so no zone matters
        # read by three writes below: attributed once
        batch = stored(batch, "batch").withColumn("day", F.col("event_ts").cast("date"))
        watermark = F.lit(None if clock is None else clock - self.late_days * 86_400_000_000).cast("bigint")
        behind = F.coalesce(F.unix_micros("event_ts") < watermark, F.lit(False))
        put(batch.filter(behind | F.col("event_ts").isNull()).drop("day"), "late")
        fresh = batch.filter(~behind & F.col("event_ts").isNotNull())
        named = fresh.filter("event_id is not null").dropDuplicates(["event_id"])
        seen = self._read("ledger", f"{_EVENTS}, day date", batch_id)
        if clock is not None:  # an event in time has its day in these partitions
            seen = seen.filter(F.col("day") >= F.timestamp_micros(watermark).cast("date"))
        new = named.join(shuffled(seen.select("event_id")), "event_id", "left_anti").unionByName(fresh.filter("event_id is null"))
        new.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/ledger/batch_id={batch_id}")
        counted = self.spark.read.schema(f"{_EVENTS}, day date").parquet(f"{self.path}/ledger/batch_id={batch_id}")
        self._upsert(self._counts(counted), batch_id)
        newest = batch.agg(F.max(F.unix_micros("event_ts")).alias("newest")).select(F.greatest("newest", F.lit(clock).cast("bigint")).alias("newest"))
        put(newest.filter("newest is not null"), "clock")

    @staticmethod
    def _counts(events: DataFrame) -> DataFrame:
        return events.groupBy(*EDGE, "day").agg(F.count("*").alias("events"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"))

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*EDGE, "day").agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    def _upsert(self, part: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*EDGE), F.lit(self.buckets)).cast("int")
        before = self._current(batch_id)
        touched = [r.bucket for r in part.select(bucket.alias("bucket")).distinct().collect()]
        old = self._state({b: v for b, v in before.items() if b in touched})
        merged = self._merged(part.unionByName(old)).withColumn("bucket", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/version={batch_id}")
        after = {**before, **{b: batch_id for b in touched}}
        pointer = self.spark.createDataFrame(sorted(after.items()), "bucket int, version bigint")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/batch_id={batch_id}")

    def edges(self) -> DataFrame:
        """Daily counts of every edge; reads each bucket once, however many batches there were."""
        return self._state(self._current())

    def late(self) -> DataFrame:
        """Events that were set aside, with the batch they came in."""
        return self._read("late", _EVENTS)

    def settled(self) -> DataFrame:
        """Daily counts with the late events, each once and only if it was not counted in time. Only the days that have late events are looked up."""
        late = self.late().filter("event_ts is not null").drop("batch_id").withColumn("day", F.col("event_ts").cast("date"))
        days = late.select("day").distinct()
        counted = self._read("ledger", f"{_EVENTS}, day date").join(days, "day", "left_semi").select("event_id")
        named = late.filter("event_id is not null").dropDuplicates(["event_id"]).join(shuffled(counted), "event_id", "left_anti")
        more = self._counts(named.unionByName(late.filter("event_id is null")))
        return self._merged(self.edges().unionByName(more))

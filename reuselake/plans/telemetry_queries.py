"""Queries of reuse measurement, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.operators import telemetry as T
from reuselake.plans.business import BILLABLE, FACTS
from reuselake.plans.catalog import query
from reuselake.plans.fixtures import Lake
from reuselake.plans.registry_queries import registry
from reuselake.session import new_path, stored
from reuselake.streaming import activity as A
from reuselake.streaming.billing import stream_billable_events
from reuselake.streaming.ledger import EdgeLedger

NAMES = ("k",)
AS_OF = "2024-01-30"
ACT = "activity binding artifact"

EV = """ev AS (SELECT *, coalesce(consumer_type || ':' || source_system || '/' || json_extract_string(tag, '$.k'), 'unknown:' || source_system) AS consumer_key,
    lower(physical_ref) AS ref FROM activity),
  us AS (SELECT ev.*, CASE WHEN b.fqn IS NULL THEN 'bypass' ELSE 'canonical' END AS usage_type, coalesce(b.fqn, ref) AS artifact_fqn
    FROM ev LEFT JOIN (SELECT physical_ref, min(fqn) AS fqn FROM binding GROUP BY 1) b ON b.physical_ref = ref),
  bk AS (SELECT consumer_key, artifact_fqn, usage_type, cast(event_ts AS date) AS day, count(*) AS events, max(event_ts) AS last_seen,
    min(event_ts) AS first_seen FROM us GROUP BY 1, 2, 3, 4)"""


def _events(lake: Lake) -> DataFrame:
    return T.attribute(lake.activity, NAMES)


def _buckets(lake: Lake) -> DataFrame:
    return T.daily_buckets(_events(lake), lake.binding)


@query("consumer_nodes", f"""WITH {EV} SELECT consumer_key, min(consumer_type) AS consumer_type, min(source_system) AS source_system,
    min(event_ts) AS first_seen, max(event_ts) AS last_seen FROM us GROUP BY 1""", ACT)
def _(lake):
    return T.consumer_nodes(_events(lake))


@query("daily_buckets", f"WITH {EV} SELECT * FROM bk", ACT)
def _(lake):
    return _buckets(lake)


@query("usage_edges_30d", f"""WITH {EV} SELECT *, cast(sum(events) OVER (PARTITION BY consumer_key, artifact_fqn, usage_type
    ORDER BY datediff('day', date'1970-01-01', day) RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS bigint) AS event_count_30d FROM bk""", ACT)
def _(lake):
    return T.rolling_30d(_buckets(lake))


@query("usage_edges", f"""WITH {EV} SELECT consumer_key, artifact_fqn, usage_type, cast(coalesce(sum(CASE WHEN day BETWEEN date'{AS_OF}' - 29 AND date'{AS_OF}'
    THEN events END), 0) AS bigint) AS event_count_30d, max(last_seen) AS last_seen FROM bk WHERE day <= date'{AS_OF}' GROUP BY 1, 2, 3""", ACT)
def _(lake):
    return T.usage_edges(_buckets(lake), AS_OF)


_RATES = f"""{EV}, r AS (SELECT us.*, lifecycle, interface_type FROM us LEFT JOIN artifact a ON a.fqn = artifact_fqn WHERE consumer_key NOT LIKE 'unknown:%'),
  rates AS (SELECT count(*) AS events, count(CASE WHEN usage_type = 'canonical' THEN 1 END) AS canonical_events,
    round(count(CASE WHEN usage_type = 'canonical' THEN 1 END) / count(*), 6) AS adoption_rate,
    round(count(CASE WHEN lifecycle = 'certified' AND interface_type = 'queryable_dataset' THEN 1 END) /
      count(CASE WHEN usage_type = 'bypass' OR interface_type = 'queryable_dataset' THEN 1 END), 6) AS certified_dataset_adoption_rate,
    round(count(CASE WHEN lifecycle = 'certified' AND interface_type = 'semantic_contract' THEN 1 END) /
      count(CASE WHEN usage_type = 'bypass' OR interface_type = 'semantic_contract' THEN 1 END), 6) AS certified_metric_adoption_rate FROM r)"""


@query("adoption_rate", f"WITH {_RATES} SELECT * FROM rates", ACT)
def _(lake):
    return T.adoption(_buckets(lake), registry(lake)["artifact"])


@query("coverage", f"""WITH {EV} SELECT source_system, count(*) AS events, count(CASE WHEN consumer_key LIKE 'unknown:%' THEN 1 END) AS unattributed_event_count,
    round(count(CASE WHEN consumer_key NOT LIKE 'unknown:%' THEN 1 END) / count(*), 6) AS attributed_rate,
    round(count(CASE WHEN usage_type = 'canonical' THEN 1 END) / count(*), 6) AS object_resolved_rate,
    count(DISTINCT CASE WHEN consumer_key NOT LIKE 'unknown:%' THEN consumer_key END) AS known_consumers FROM us GROUP BY 1""", ACT)
def _(lake):
    return T.coverage(_events(lake), lake.binding)


@query("bypass_distribution", f"""WITH {EV} SELECT consumer_type AS kind, source_system, count(CASE WHEN usage_type = 'bypass' THEN 1 END) AS bypass_events,
    round(count(CASE WHEN usage_type = 'bypass' THEN 1 END) / count(*), 6) AS bypass_rate FROM us
  WHERE consumer_key NOT LIKE 'unknown:%' GROUP BY CUBE (consumer_type, source_system)""", ACT)
def _(lake):
    return T.bypass_distribution(_events(lake), lake.binding)


@query("actions", f"""WITH {_RATES} SELECT 'bypass_count' AS metric, cast(count(*) AS double) AS value, '{T.BYPASS_ACTION}' AS action FROM observed
    WHERE status = 'suspected_bypass' HAVING count(*) > 5
  UNION ALL SELECT 'certified_metric_adoption_rate', certified_metric_adoption_rate, '{T.ADOPTION_ACTION}' FROM rates
    WHERE certified_metric_adoption_rate < 0.8""", f"{ACT} observed")
def _(lake):
    return T.actions(lake.observed, T.adoption(_buckets(lake), registry(lake)["artifact"]))


@query("portfolio_cube", """SELECT interface_type AS interface, lifecycle AS lifecycle_state, owner AS owner_team, count(*) AS artifacts,
    cast(grouping_id(interface_type, lifecycle, owner) AS bigint) AS level FROM artifact GROUP BY CUBE (interface_type, lifecycle, owner)""", "artifact")
def _(lake):
    return T.portfolio_cube(registry(lake)["artifact"])


_CC = """cc AS (SELECT a.fqn, owner AS owner_team, count(DISTINCT from_fqn) AS consumers FROM artifact a LEFT JOIN dependency_edge e ON e.to_fqn = a.fqn
    WHERE lifecycle = 'certified' GROUP BY 1, 2)"""


@query("certified_consumers", f"WITH {_CC} SELECT * FROM cc", "artifact dependency_edge")
def _(lake):
    t = registry(lake)
    return T.certified_consumers(t["artifact"], t["edge"])


@query("reuse_concentration", f"""WITH {_CC} SELECT cast(sum(consumers) AS bigint) AS dependencies, cast(sum(CASE WHEN rn <= 10 THEN consumers END) AS bigint) AS top_dependencies,
    round(sum(CASE WHEN rn <= 10 THEN consumers END)::double / sum(consumers), 6) AS share
  FROM (SELECT *, row_number() OVER (ORDER BY consumers DESC, fqn) AS rn FROM cc)""", "artifact dependency_edge")
def _(lake):
    t = registry(lake)
    return T.reuse_concentration(t["artifact"], t["edge"], 10)


_CON = "cano AS (SELECT 'concept_' || cast(ord % 6 AS varchar) AS concept, min(fqn) AS fqn FROM artifact WHERE lifecycle = 'certified' GROUP BY 1)"


def _canonical(lake: Lake) -> DataFrame:
    a = lake.artifact.filter("lifecycle = 'certified'")
    return a.groupBy(F.concat(F.lit("concept_"), (F.col("ord") % 6).cast("string")).alias("concept")).agg(F.min("fqn").alias("fqn"))


@query("hotspots", f"""WITH {_CON}, p AS (SELECT concept, count(DISTINCT physical_ref) AS parallel_definitions FROM observed GROUP BY 1)
  SELECT o.concept, source_system, count(*) AS objects, count(CASE WHEN status = 'suspected_bypass' THEN 1 END) AS suspected_bypass,
    max(parallel_definitions) AS parallel_definitions, max(c.fqn) AS suspected_canonical
  FROM observed o JOIN p ON p.concept = o.concept LEFT JOIN cano c ON c.concept = o.concept GROUP BY 1, 2""", f"{ACT} observed")
def _(lake):
    return T.hotspots(lake.observed, _canonical(lake))


@query("concepts_without_canonical", f"WITH {_CON} SELECT DISTINCT concept FROM observed WHERE concept NOT IN (SELECT concept FROM cano)", f"{ACT} observed")
def _(lake):
    return T.concepts_without_canonical(lake.observed, _canonical(lake))


@query("observed_scan", f"""WITH {EV} SELECT ref, count(*) AS hits, max(event_ts) AS last_seen FROM us WHERE usage_type = 'bypass' GROUP BY 1""", ACT)
def _(lake):
    return T.observed_objects(_events(lake), lake.binding)


@query("propagation_gap", """SELECT a.fqn, count(DISTINCT from_fqn) AS dependents FROM artifact a JOIN dependency_edge e ON e.to_fqn = a.fqn
  WHERE lifecycle = 'certified' AND interface_type = 'queryable_dataset' AND relationship = 'transformation_dependency' AND a.fqn NOT IN (
    SELECT to_fqn FROM dependency_edge x JOIN artifact s ON s.fqn = x.from_fqn WHERE s.interface_type = 'semantic_contract'
      AND x.relationship = 'transformation_dependency') GROUP BY 1""",
       "artifact dependency_edge")
def _(lake):
    t = registry(lake)
    return T.propagation_gap(t["artifact"], t["edge"].filter("relationship = 'transformation_dependency'"))


@query("promotion_candidates", f"""WITH {EV} SELECT ref, count(DISTINCT consumer_key) AS consumers, count(*) AS events FROM us
  WHERE usage_type = 'bypass' AND consumer_key NOT LIKE 'unknown:%' GROUP BY 1 HAVING count(DISTINCT consumer_key) >= 2""", ACT)
def _(lake):
    return T.promotion_candidates(_buckets(lake))


# -- streaming ------------------------------------------------------------------------------------


def _activity_stream(lake: Lake) -> DataFrame:
    """The events table as a file stream, shaped like the activity view."""
    raw = lake.spark.readStream.schema(lake.events.schema).option("pathGlobFilter", "events.parquet").parquet(lake.path)
    user = F.col("user_id")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_ts"),
        F.when(user % 4 == 0, "tableau").when(user % 4 == 1, "databricks").when(user % 4 == 2, "snowflake")
        .otherwise("semantic").alias("source_system"),
        F.when(F.col("event_id") % 10 != 0, F.col("props")).alias("tag"),
        F.when(user % 3 == 0, "dashboard").when(user % 3 == 1, "notebook").otherwise("service").alias("consumer_type"),
        F.concat_ws(".", F.lit("REF"), (F.col("event_id") % 120).cast("string"), (F.col("event_id") % 3).cast("string")).alias("physical_ref"),
    )


def _zoneless(df: DataFrame) -> DataFrame:
    return df.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def _attributed(lake: Lake) -> DataFrame:
    return A.attributed(A.deduplicated(_activity_stream(lake)), lake.binding, NAMES)


@query("stream_daily_buckets", f"WITH {EV} SELECT consumer_key, artifact_fqn, usage_type, day, events, last_seen FROM bk", ACT)
def _(lake):
    path = new_path(lake.spark, "stream-buckets")
    q = A.run_buckets(A.daily_buckets(A.attributed(_activity_stream(lake), lake.binding, NAMES)), f"{path}/out", f"{path}/checkpoint")
    q.awaitTermination()
    return _zoneless(A.read_buckets(lake.spark, f"{path}/out"))


@query("stream_usage_edges", f"""WITH {EV} SELECT * EXCLUDE (first_seen), cast(sum(events) OVER (PARTITION BY consumer_key, artifact_fqn, usage_type
    ORDER BY datediff('day', date'1970-01-01', day) RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS bigint) AS event_count_30d FROM bk""", ACT)
def _(lake):
    path = new_path(lake.spark, "stream-edges")
    A.run_edges(_attributed(lake), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return _zoneless(T.rolling_30d(A.read_edges(lake.spark, f"{path}/out")).drop("first_seen"))


SLICES = 4


def _in_slices(lake: Lake, awkward: bool) -> EdgeLedger:
    """The activity delivered in several batches, by time. ``awkward``: some events come twice, in their own batch or the next, and some only in the last batch."""
    spark, path = lake.spark, new_path(lake.spark, "stream-ledger")
    rows = lake.activity.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    low, high = rows.agg(F.min(F.unix_micros("event_ts")), F.max(F.unix_micros("event_ts"))).first()
    part = F.floor((F.unix_micros("event_ts") - low) * SLICES / (high - low + 1)).cast("int")
    rows = rows.withColumn("_part", part)
    if awkward:
        rows = rows.withColumn("_part", F.when(F.col("event_id") % 11 == 3, SLICES - 1).otherwise(F.col("_part")))
        again = rows.filter(F.col("event_id") % 7 == 0).withColumn("_part", F.least(F.col("_part") + (F.col("event_id") % 2).cast("int"), F.lit(SLICES - 1)))
        rows = rows.unionByName(again)
    ledger = EdgeLedger(spark, f"{path}/ledger")
    for k in range(SLICES):
        rows.filter(F.col("_part") == k).drop("_part").write.parquet(f"{path}/feed/{k}")
        feed = spark.readStream.schema(rows.drop("_part").schema).option("recursiveFileLookup", "true").parquet(f"{path}/feed")
        ledger.run(A.attributed(feed, lake.binding, NAMES), f"{path}/checkpoint").awaitTermination()
    return ledger


_DAILY = f"WITH {EV} SELECT consumer_key, artifact_fqn, usage_type, day, events, last_seen FROM bk"


@query("stream_edges_upsert", _DAILY, ACT)
def _(lake):
    """State after several batches, the last of which is delivered twice."""
    ledger = _in_slices(lake, False)
    last = SLICES - 1
    again = stored(ledger.spark.read.parquet(f"{ledger.path}/ledger/batch_id={last}").drop("day"), "batch")
    ledger.add(again, last)
    return _zoneless(ledger.edges().drop("first_seen"))


@query("stream_edges_settled", f"""WITH {EV} SELECT * EXCLUDE (first_seen), cast(sum(events) OVER (PARTITION BY consumer_key, artifact_fqn, usage_type
    ORDER BY datediff('day', date'1970-01-01', day) RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS bigint) AS event_count_30d FROM bk""", ACT)
def _(lake):
    """Repeated and late events: after the batch job the counts are those of the whole table."""
    return _zoneless(T.rolling_30d(_in_slices(lake, True).settled()).drop("first_seen"))


@query("stream_billable_events", BILLABLE, FACTS)
def _(lake):
    spark, path = lake.spark, new_path(lake.spark, "stream-billing")
    feeds = {}
    for name in ("fact_invoices", "fact_refunds"):
        df = getattr(lake, name)
        df.write.parquet(f"{path}/{name}")
        feeds[name] = spark.readStream.schema(df.schema).parquet(f"{path}/{name}")
    stream_billable_events(feeds["fact_invoices"], feeds["fact_refunds"], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")

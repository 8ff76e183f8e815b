from datetime import date, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reuselake.operators import governance as G
from reuselake.operators import telemetry as T
from reuselake.session import new_path
from reuselake.streaming import activity as A
from reuselake.streaming.billing import stream_billable_events
from reuselake.operators.revenue import billable_events
from reuselake.plans.fixtures import Lake
from reuselake.sources.tables import SCHEMAS, read_activity, read_observed


def test_consumer_keys(spark):
    df = spark.createDataFrame([
        (1, "snowflake", None, '{"app":"tableau","dashboard":"exec"}', None, "x"),
        (2, "bigquery", None, "team=a,dashboard=exec", None, "x"),
        (3, "databricks", None, None, "svc_etl", "x"),
        (4, "databricks", "notebook", None, None, "x"),
    ], "event_id int, source_system string, consumer_type string, tag string, session_user string, physical_ref string")
    got = [r.consumer_key for r in T.attribute(df).orderBy("event_id").collect()]
    assert got == ["dashboard:tableau/exec", "dashboard:bigquery/exec", "service:databricks/svc_etl", "unknown:databricks"]


def test_references_resolve_across_case_and_environment(spark):
    b = spark.createDataFrame([("a.v1", "PROD.mart.x")], "fqn string, physical_ref string")
    ev = spark.createDataFrame([("k", "mart.x"), ("k", "mart.y")], "consumer_key string, ref string")
    got = {r.ref: (r.usage_type, r.artifact_fqn) for r in T.resolve(ev, b).collect()}
    assert got == {"mart.x": ("canonical", "a.v1"), "mart.y": ("bypass", "mart.y")}
    assert spark.range(1).select(T.normal_ref(F.lit(" UAT_Mart.X"))).first()[0] == "mart.x"


@pytest.fixture(scope="module")
def feed(spark):
    """Activity landed in several files, with repeats and one very late event."""
    lake = Lake(spark, "/root/testdata/sf0.001")
    df = lake.activity.select(
        "event_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "source_system", "consumer_type", "tag",
        F.lit(None).cast("string").alias("session_user"), "physical_ref")
    path = new_path(spark, "feed")
    parts = df.withColumn("p", F.ntile(4).over(Window.orderBy("event_ts")))
    for p in range(1, 5):
        parts.filter(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(path)
    return lake, df, path


def test_stream_ends_where_batch_ends(spark, feed):
    lake, df, path = feed
    b = lake.binding
    base = new_path(spark, "s")
    stream = lambda: A.attributed(A.deduplicated(read_activity(
        spark, path, streaming=True, maxFilesPerTrigger=1)), b, ("k",))
    dropped = A.DroppedRows()
    spark.streams.addListener(dropped)
    q = A.run_edges(stream(), f"{base}/edges", f"{base}/c1")
    q.awaitTermination()
    want = T.daily_buckets(T.attribute(df, ("k",)), b)
    got = A.read_edges(spark, f"{base}/edges")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
    assert len(q.recentProgress) >= 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert dropped.batches[str(q.id)] >= 4 and dropped.rows[str(q.id)] == 0
    spark.streams.removeListener(dropped)
    # the same feed again from the same checkpoint adds nothing
    A.run_edges(stream(), f"{base}/edges", f"{base}/c1").awaitTermination()
    assert A.read_edges(spark, f"{base}/edges").agg(F.sum("events")).first()[0] == df.count()
    # a replayed batch replaces its own rows
    first = spark.read.parquet(f"{base}/edges/batch_id=0")
    A._write_batch(f"{base}/edges")(spark.createDataFrame(first.collect(), first.schema), 0)
    assert A.read_edges(spark, f"{base}/edges").agg(F.sum("events")).first()[0] == df.count()
    merged = A.compact_edges(spark, f"{base}/edges", f"{base}/merged")
    assert merged.exceptAll(A.read_edges(spark, f"{base}/edges")).count() == 0
    roll = T.rolling_30d(A.read_edges(spark, f"{base}/edges").select(*T.EDGE, "day", "events"))
    full = T.rolling_30d(want.select(*T.EDGE, "day", "events"))
    assert roll.exceptAll(full).count() == 0


def test_repeated_events_count_once(spark, feed):
    lake, df, path = feed
    twice = new_path(spark, "twice")
    df.limit(50).write.parquet(twice)
    df.limit(50).write.mode("append").parquet(twice)
    out = new_path(spark, "o")
    src = read_activity(spark, twice, streaming=True)
    A.run_edges(A.attributed(A.deduplicated(src), lake.binding, ("k",)), f"{out}/e", f"{out}/c").awaitTermination()
    assert A.read_edges(spark, f"{out}/e").agg(F.sum("events")).first()[0] == 50


def test_windowed_buckets_follow_updates(spark, feed):
    lake, df, path = feed
    out = new_path(spark, "w")
    src = read_activity(spark, path, streaming=True, maxFilesPerTrigger=1)
    A.run_buckets(A.daily_buckets(A.attributed(src, lake.binding, ("k",))), f"{out}/b", f"{out}/c").awaitTermination()
    got = A.read_buckets(spark, f"{out}/b")
    assert got.exceptAll(T.daily_buckets(T.attribute(df, ("k",)), lake.binding).select(got.columns)).count() == 0
    assert got.agg(F.sum("events")).first()[0] == df.count()


def test_billing_stream(spark):
    lake = Lake(spark, "/root/testdata/sf0.001")
    p = new_path(spark, "bill")
    feeds = []
    for n in ("fact_invoices", "fact_refunds"):
        df = getattr(lake, n)
        df.repartition(3).write.parquet(f"{p}/{n}")
        feeds.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/{n}"))
    stream_billable_events(*feeds, f"{p}/out", f"{p}/cp").awaitTermination()
    want = billable_events(lake.fact_invoices, lake.fact_refunds)
    got = spark.read.parquet(f"{p}/out").select(want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_observed_snapshot(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"physical_ref":"x.y","concept":"c","status":"suspected_bypass"}\n')
    df = read_observed(spark, str(tmp_path))
    assert df.columns == [c.split()[0] for c in SCHEMAS["observed"].split(", ")] and df.first().concept == "c"


def test_gates_on_small_tables(spark):
    art = spark.createDataFrame([
        ("a.b.c.v1", "", "certified", ["callable_logic"], "enterprise_canonical"), ("a.b.c", "t", None, [], "domain_canonical"),
        ("x.y.z.v1", None, "local", [], "?"),
    ], "fqn string, owner_team string, lifecycle_state string, interface_types array<string>, reuse_intent string")
    got = sorted(tuple(r) for r in G.gate_metadata(art).collect())
    assert got == [("a.b.c", "missing_identity"), ("a.b.c", "missing_interface"), ("a.b.c", "missing_lifecycle"), ("a.b.c.v1", "missing_owner")]
    ch = spark.createDataFrame([("a.b.v1", "a.b.v1", True), ("a.b.v1", "a.b.v2", True), ("a.b.v1", "a.b.v1", False)], "old_fqn string, new_fqn string, breaking boolean")
    assert sorted(r.outcome for r in G.gate_version(ch).collect()) == ["allow", "allow", "block"]
    ex = spark.createDataFrame([(1, True, True, date(2001, 1, 31)), (2, True, True, date(2001, 1, 30)), (3, None, True, None)],
                               "id int, justified boolean, owner_approved boolean, expiry_date date")
    assert [r.id for r in G.valid_exceptions(ex, "2001-01-31").collect()] == [1]
    fresh = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0),)], "ts timestamp_ntz")
    assert G.freshness(fresh, "ts", "2024-01-01 10:30:00", 30).first().fresh is True
    assert G.freshness(fresh, "ts", "2024-01-01 10:31:00", 30).first().fresh is False


def test_contract_on_data(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", 2)], "k string, v int")
    got = sorted(tuple(r) for r in G.contract_check(df, [("k", "string", False), ("v", "int", False), ("w", "date", True)], ["k"]).collect())
    assert got == [("duplicate_grain", "k", 1), ("missing_column", "w", 1), ("null_value", "v", 1)]


def test_schema_changes_and_renames(spark):
    c = spark.createDataFrame([
        ("d", 1, "a", "date", 1), ("d", 1, "b", "date", 1), ("d", 1, "c", "date", 1), ("d", 1, "e", "date", 1),
        ("d", 2, "a", "string", 1), ("d", 2, "b2", "date", 1), ("d", 2, "c", "date", 0), ("d", 2, "n", "date", 0), ("d", 2, "o", "date", 1),
    ], "dataset string, version int, column_name string, type string, nullable int")
    plain = {r.column_name: (r.change, r.breaking) for r in G.schema_diff(c, 1, 2).collect()}
    assert plain == {"a": ("retyped", True), "b": ("removed", True), "b2": ("added_nullable", False), "c": ("tightened", False),
                     "e": ("removed", True), "n": ("added_required", True), "o": ("added_nullable", False)}
    ren = spark.createDataFrame([("d", "b", "b2")], "dataset string, old_name string, new_name string")
    named = {r.column_name: r.change for r in G.schema_diff(c, 1, 2, ren).collect()}
    assert named["b"] == "renamed" and "b2" not in named and named["e"] == "removed"


def test_shared_folder_without_setting(spark):
    from reuselake.session import shared_dir

    old = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == old if old else shared_dir(spark).startswith("file:/tmp/reuselake-")

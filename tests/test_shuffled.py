"""Joins of tables that grow together: never a broadcast, and the same rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from reuselake.operators import similarity as S
from reuselake.operators import telemetry as T
from reuselake.operators.graph import impact_closure
from reuselake.operators.search import substring_hits
from reuselake.operators.skew import salted_join
from reuselake.plans import fixtures
from reuselake.plans.fixtures import Lake


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_sends_nothing_through_the_driver(spark):
    big = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, n int")
    small = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    for how, rows in (("inner", 3), ("left", 4), ("left_semi", 3), ("left_anti", 1)):
        out = salted_join(big, small, "k", "n", how=how)
        assert "Broadcast" not in _plan(out)
        assert out.count() == rows


def test_resolve_shuffles_the_bindings(spark):
    events = spark.createDataFrame([("a", "REF.1"), ("b", "ref.2"), (None, None)], "consumer_key string, physical_ref string")
    rows = events.withColumn("ref", T.normal_ref(F.col("physical_ref")))
    binding = spark.createDataFrame([("d.x.v1", "ref.1"), ("d.w.v1", "ref.1")], "fqn string, physical_ref string")
    out = T.resolve(rows, binding)
    assert "Broadcast" not in _plan(out)
    got = {(r.consumer_key, r.usage_type, r.artifact_fqn) for r in out.collect()}
    assert got == {("a", "canonical", "d.w.v1"), ("b", "bypass", "ref.2"), (None, "bypass", None)}


def test_closure_over_a_hub_and_a_cycle(spark, monkeypatch):
    monkeypatch.setattr("reuselake.operators.graph.HUB", 3)
    edges = [(f"n{i}", "hub") for i in range(20)] + [("x", "n1"), ("hub", "x"), ("x", "n1"), ("z", None)]
    out = impact_closure(spark.createDataFrame(edges, "from_fqn string, to_fqn string"), spark.createDataFrame([("hub",), ("lone",), (None,)], "fqn string"))
    want = {("hub", f"n{i}", 1) for i in range(20)} | {("hub", "x", 2), ("hub", "hub", 3)}
    assert {tuple(r) for r in out.select("root", "node", "depth").collect()} == want


def test_substring_hits_shuffles_asked_runs_only(spark):
    text = spark.createDataFrame([("d.a.v1", "Net revenue", "sum"), ("d.b.v1", None, "%")], "fqn string, title string, description string")
    asks = spark.createDataFrame([("REV%ue",), ("zzz",), ("",)], "query string")
    got = {(r.query, r.fqn) for r in substring_hits(asks, text).collect()}
    assert got == {("REV%ue", "d.a.v1"), ("", "d.a.v1"), ("", "d.b.v1")}


def _observed(spark, tmp_path, parts):
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("""SELECT event_id, timestamp_ntz'2024-01-01' AS ts, CASE WHEN event_id = 7 THEN NULL ELSE 1L END AS user_id, '{"k": 1}' AS props
        FROM VALUES (1L), (2L), (4L), (7L), (NULL) t(event_id)""").write.parquet(f"{tmp_path}/events.parquet")
    lake = Lake(spark, str(tmp_path))
    return {(r.physical_ref, r.hits, r.status) for r in lake.observed.collect()}, _plan(lake.observed)


def test_observed_objects_are_those_no_binding_names(spark, tmp_path):
    got, plan = _observed(spark, tmp_path / "a", [(1, "n", "T", "B"), (2, "n", "T", "B")])
    assert got == {("REF.4.1", 1, "accepted_local_variant"), ("REF.7.1", 1, "suspected_bypass")}
    assert "BroadcastHashJoin" not in plan
    # as with NOT IN, an unknown name is no row where there is a list, and an empty list keeps all
    assert len(_observed(spark, tmp_path / "b", [(11, "n", "T", None)])[0]) == 5


def test_a_batch_is_attributed_once(spark, tmp_path):
    from reuselake.streaming.ledger import EdgeLedger

    seen = spark.sparkContext.accumulator(0)

    def attributed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    schema = "event_id long, event_ts timestamp, consumer_key string, artifact_fqn string, usage_type string"
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 10:00:00' AS event_ts, 'c' AS consumer_key, 'a' AS artifact_fqn, 'bypass' AS usage_type FROM range(20)")
    ledger = EdgeLedger(spark, f"{tmp_path}/ledger")
    ledger.add(rows.mapInPandas(attributed, schema), 0)
    assert [r.events for r in ledger.edges().collect()] == [20]
    assert seen.value == 20


def test_text_rules_use_all_cores_for_one_small_file(spark, tmp_path):
    from reuselake.functions.text import SLICES, featurize

    spark.range(50).selectExpr("id", "concat('SELECT a FROM t', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = featurize(spark.read.parquet(f"{tmp_path}/part.parquet"))
    assert rows.rdd.getNumPartitions() == SLICES * spark.sparkContext.defaultParallelism
    assert rows.count() == 50


def test_query_blocks_that_travel_together_meet_what_they_ask_for(spark, monkeypatch):
    from reuselake.operators import similarity as S

    monkeypatch.setattr(S, "GROUP", 3)
    block = "named_struct('ring', id div 4, 'cut', id % 4)"
    q = spark.sql(f"SELECT cast(id % 3 AS int) AS pivot, {block} AS part, array(id) AS ids, array(array(cast(id AS double))) AS vecs FROM range(10)")
    c = spark.sql(f"SELECT cast(id % 2 AS int) AS pivot, {block} AS part, array(100 + id) AS ids, array(array(cast(id AS double))) AS vecs FROM range(7)")
    both = q.select(F.col("pivot").alias("q_pivot"), F.col("part").alias("q_part"), F.col("ids")[0].alias("i")).crossJoin(
        c.select(F.col("pivot").alias("c_pivot"), F.col("part").alias("c_part"), F.col("ids")[0].alias("j")))
    pairs = both.filter("(i + j) % 3 <> 1")
    out = S._with_vectors(pairs.drop("i", "j"), q, c)
    got = sorted((r.q_ids[0], r.c_ids[0], r.q_vecs[0][0], r.c_vecs[0][0]) for r in out.collect())
    assert got == sorted((r.i, r.j, float(r.i), float(r.j - 100)) for r in pairs.collect())
    # a candidate block is sent once to a group of query blocks, not to each of them
    sent = pairs.withColumn("g", F.pmod(F.xxhash64("q_pivot", "q_part"), F.lit(4))).select("g", "c_pivot", "c_part").distinct().count()
    assert sent < pairs.count()


def test_buckets_of_near_duplicates_are_shuffled(spark, monkeypatch):
    plans, real = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name="step": (plans.append(_plan(df)), real(df, name))[1])
    n = S.BUCKET + 6  # one bucket too large, cut by two further hashes: ids of one parity agree in the first, none in the second
    keys = spark.createDataFrame([(i, 1) for i in range(n)] + [(0, 2), (1, 2), (5, 3)], "_id bigint, key bigint")
    further = spark.createDataFrame([(i, [i % 2, i, 0, 0]) for i in range(n)], "_id bigint, m array<bigint>")
    out = S._bucket_pairs(keys, further, [], 2)
    assert len(plans) == 2 and not any("Broadcast" in p for p in [*plans, _plan(out)])
    want = {(i, j) for i in range(n) for j in range(i + 2, n, 2)} | {(0, 1)}
    got = [tuple(r) for r in out.select("left_id", "right_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_join_does_not_run_the_text_rules_again(spark, monkeypatch):
    plans, real = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name="step": (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    df = spark.createDataFrame([(1, "sql", "a", "X"), (2, "sql", "a", "x"), (3, "sql", None, "x"), (4, "sql", "a", None), (5, "sql", "a", "y")], "id int, language string, dialect string, text string")
    out = S.exact_duplicates(df.repartition(2).withColumn("fingerprint", F.sha2(F.lower("text"), 256)))
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString() and [n for n, _ in plans] == ["keys"]
    assert sorted((r.id, r.first_id, r.members) for r in out.collect()) == [(1, 1, 2), (2, 1, 2)]
    texts = df.select("id", F.split(F.lower("text"), "").alias("elements"))
    assert [tuple(r)[:2] for r in S.near_duplicates_lsh(texts).collect() if r.left_id == 1] == [(1, 2), (1, 3)]
    assert not any("Filter" in p for n, p in plans if n == "sets")


def test_a_search_index_sends_nothing_through_the_driver(spark, monkeypatch):
    from reuselake.operators import search as X
    from reuselake.operators.registry import resolve_concepts

    plans, real = [], X.stored
    monkeypatch.setattr(X, "stored", lambda df, name="step": (plans.append((name, _plan(df))), real(df, name))[1])
    rows = [("d.a.v1", "Net revenue", "sum", ""), ("d.b.v1", None, None, None), (None, "gross", "x", "")]
    artifact = spark.createDataFrame(rows, "fqn string, title string, description string, body string")
    index = X.build_index(artifact)
    assert {(r.fqn, r.length) for r in index["docs"].collect()} == {("d.a.v1", 6), ("d.b.v1", 3), (None, 0)}
    asks = spark.createDataFrame([("net rev",), ("a_b c",), ("zzz",)], "query string")
    found = artifact.withColumns({"lifecycle_state": F.lit("certified"), "reuse_intent": F.lit("shared_utility")})
    out = resolve_concepts(asks, index, found, enterprise_only=False)
    assert {(r.query, r.fqn) for r in out.collect()} == {("net rev", "d.a.v1"), ("a_b c", None), ("zzz", None)}
    assert [n for n, p in plans if "BroadcastHashJoin" in p] == []


def test_events_counted_before_are_shuffled(spark, tmp_path, monkeypatch):
    from reuselake.streaming import ledger as L

    frame = type(spark.range(1))
    joins, real = [], frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **b: (joins.append(_plan(out := real(self, *a, **b))), out)[1])
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 10:00:00' AS event_ts, 'c' AS consumer_key, 'a' AS artifact_fqn, 'bypass' AS usage_type FROM range(20)")
    ledger = L.EdgeLedger(spark, f"{tmp_path}/ledger")
    for k in range(2):
        ledger.add(rows.filter(f"event_id < {10 + 5 * k}"), k)
    assert [r.events for r in ledger.edges().collect()] == [15]
    assert len(joins) == 2 and not any("BroadcastHashJoin" in p for p in joins)


def test_refunds_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0), (2, 1), (None, 2)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 1 + k % 2, "F", 10.0) for k in range(40)] + [(3, 2, "F", 10.0), (None, 1, "F", 1.0)]
    orders = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    orders.withColumn("o_orderdate", F.lit("2000-01-03").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k % 40, k % 3, "F", "R", 5.0, 0.1) for k in range(200)] + [(None, 1, "F", "R", 5.0, 0.1)]
    lines = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_linestatus string, l_returnflag string, l_extendedprice double, l_discount double")
    lines.withColumn("l_shipdate", F.lit("2000-02-03").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = Lake(spark, str(tmp_path)).fact_refunds
    monkeypatch.setitem(fixtures.DEALT, "fact_refunds", ("lineitem", 10))
    dealt = Lake(spark, str(tmp_path)).fact_refunds
    assert "REPARTITION_BY_NUM" not in _plan(plain)
    assert "l_orderkey" in _plan(dealt) and ", 21), REPARTITION_BY_NUM" in _plan(dealt)
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty() and not dealt.isEmpty()


def test_candidates_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    part = [(k, f"part {k}", f"Brand#{k % 3}", "BOLT", k % 7) for k in [*range(60), 5, 5]] + [(None, "p", "Brand#1", "BOLT", 1)]
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    plain = Lake(spark, str(tmp_path)).candidate
    monkeypatch.setitem(fixtures.DEALT, "candidate", ("part", 5))
    dealt = Lake(spark, str(tmp_path)).candidate
    assert "REPARTITION_BY_NUM" not in _plan(plain) and ", 13), REPARTITION_BY_NUM" in _plan(dealt)
    assert "Broadcast" not in _plan(plain) and "Broadcast" not in _plan(dealt)
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty() and not dealt.isEmpty()


def test_only_sets_with_a_partner_are_brought_together(spark, monkeypatch):
    steps, real = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name="step": steps.setdefault(name, [_plan(df), real(df, name)])[1])
    rows = [(i, [f"e{i}-{j}" for j in range(12)]) for i in range(40)]
    rows += [(100, rows[3][1][:11]), (100, rows[3][1][:11]), (101, rows[4][1]), (None, rows[5][1]), (102, []), (103, None)]
    df = spark.createDataFrame(rows, "id int, elements array<string>")
    got = sorted(tuple(r) for r in S.near_duplicates_lsh(df).collect())
    assert got == [(3, 100, 11, 12, 11), (4, 101, 12, 12, 12)]
    assert sorted(r["_id"] for r in steps["paired-sets"][1].collect()) == [3, 100]
    assert "_set" not in steps["signatures"][1].columns
    moved = [line for line in steps["signatures"][0].splitlines() if "Exchange" in line or "SortAggregate" in line]
    assert moved and not any("_set" in line for line in moved)


def test_least_hashes_equal_brute_force():
    rnd = np.random.default_rng(3)
    sets = [rnd.integers(-(1 << 63), (1 << 63) - 1, n) for n in (1, 3, S.AT_ONCE + 5, 2, 700, 1)]
    seeds = rnd.integers(1, 1 << 63, 5, dtype=np.uint64)
    for x, got in zip(sets, S._least(sets, seeds), strict=True):
        for seed, least in zip(seeds.tolist(), got.view(np.uint64).tolist(), strict=True):
            v = [((e & (1 << 64) - 1) ^ seed) * 0x9E3779B97F4A7C15 % (1 << 64) for e in x.tolist()]
            assert least == min((y ^ (y >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64) for y in v)


def test_table_of_what_may_occur_forgets_nothing(spark):
    there = spark.range(3000).select(F.xxhash64("id"))
    table = S.seen_table(there)
    assert spark.range(3000).filter(S.maybe_seen(table)(F.xxhash64("id"))).count() == 3000
    assert spark.range(3000, 23000).filter(S.maybe_seen(table)(F.xxhash64("id"))).count() < 20
    sets = spark.range(2900, 3100).select("id", F.array("id", F.col("id") + 100, F.lit(-1)).alias("e")).select("id", F.transform("e", lambda x: F.xxhash64(x)).alias("h"))
    enough = S.maybe_enough(table, 1, 2)
    assert sets.unionByName(spark.sql("SELECT -5L AS id, CAST(NULL AS ARRAY<BIGINT>) AS h")).filter(enough("h")).count() == 0
    assert sets.filter(S.maybe_enough(table, 1, 3)("h")).count() == 100


def test_exact_pairs_of_one_table(spark):
    rnd = random.Random(4)
    sets = [sorted({f"e{min(rnd.randrange(90), rnd.randrange(90))}" for _ in range(rnd.randrange(1, 14))}) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, elements array<string>")
    for num, den in ((4, 5), (1, 2), (1, 20)):
        share = lambda x, y: (len(set(x) & set(y)), len(set(x) | set(y)))
        want = {(i, j, share(x, y)[0]) for i, x in enumerate(sets) for j, y in enumerate(sets) if (s := share(x, y))[0] and s[0] * den >= s[1] * num}
        assert {tuple(r)[:3] for r in S.similar_pairs(df, df, (num, den)).collect()} == want
        assert {tuple(r)[:3] for r in S.similar_pairs(df, df, (num, den), ordered=True).collect()} == {x for x in want if x[0] < x[1]}


def test_rows_that_can_have_no_partner_are_not_stored(spark, monkeypatch):
    tables, real = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name="step": (out := real(df, name), tables.append((name, out)))[0])
    left = [(i, [f"own{i}-{j}" for j in range(30)] + ["a"]) for i in range(50)]
    left += [(90, ["a", "b", "x", "y", "b"]), (91, ["b", "a", "x", "y", "b"]), (92, ["c"]), (93, []), (94, None), (None, ["c"])]
    right = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c"]), (3, []), (4, ["c"])], "id int, elements array<string>")
    got = S.similar_rows(spark.createDataFrame(left, "id int, elements array<string>"), right, (1, 10))
    want = {(90, 1, 2, 5, 3), (91, 1, 2, 5, 3)} | {(i, 1, 1, 1, 3) for i in (92, None)} | {(i, j, 1, 1, 1) for i in (92, None) for j in (2, 4)}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sorted(str(r["_row"]) for r in [t for n, t in tables if n == "sets"][1].collect()) == ["90", "91", "92", "None"]

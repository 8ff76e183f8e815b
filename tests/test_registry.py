import math
import re

import pytest
from pyspark.sql import functions as F

from reuselake.operators import registry as R
from reuselake.operators import search as X
from reuselake.session import new_path
from reuselake.sources.code import read_code_tree, registered_candidates
from reuselake.sources.manifests import read_manifests, read_registry, registry_tables, write_registry
from reuselake.sources.pages import flatten_pages
from reuselake.sources.sinks import to_payload

NET = """kind: Thing
metadata:
  fqn: fin.logic.net_usd.v1
  title: Net USD revenue
  description: " Recognised revenue. "
  lifecycle: {state: certified}
  owner: {team: finance}
  aliases: [net sales]
spec:
  interfaceTypes: [callable_logic]
  reuseIntent: enterprise_canonical
  implementationBindings:
    - {system: warehouse, env: uat, objectType: udf, ref: W.NET, source: finance/net.sql}
    - {system: dbt, env: prod, objectType: macro, ref: m.net}
    - {system: lab, env: prod, objectType: view, ref: L.NET, runtime: spark, dialect: spark, source: finance/net.py}
  declaredDependencies: [{fqn: fin.data.bill.v1, relationship: source_input}]
  knownConsumers: [{fqn: ent.kpi.v1}]
"""
OLD = """kind: Thing
metadata: {fqn: fin.data.bill.v1, title: Billable events}
spec:
  reuseScope: domain_canonical
  physicalImplementations: [{system: Databricks SQL, env: prod, objectType: table, ref: d.bill}]
  dependencies: []
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("manifests")
    (root / "fin" / "deep").mkdir(parents=True)
    (root / "fin" / "net.yaml").write_text(NET)
    (root / "fin" / "deep" / "old.yml").write_text(OLD)
    (root / "policy.yaml").write_text("kind: Policy\n")
    (root / "empty.yaml").write_text("")
    (root / "note.txt").write_text("kind: Thing\n")
    return registry_tables(read_manifests(spark, str(root), "Thing"))


def test_manifest_tables(spark, tables):
    a = {r.fqn: r for r in tables["artifact"].collect()}
    assert set(a) == {"fin.logic.net_usd.v1", "fin.data.bill.v1"}
    net, old = a["fin.logic.net_usd.v1"], a["fin.data.bill.v1"]
    assert (net.description, net.source_manifest, net.entry_role) == ("Recognised revenue.", "fin/net.yaml", "producer")
    assert (old.reuse_intent, old.lifecycle_state, old.source_manifest) == ("domain_canonical", "", "fin/deep/old.yml")
    for word in ("net sales", "fin.data.bill.v1", "ent.kpi.v1", "W.NET", "macro"):
        assert word in net.body
    b = {r.physical_ref: (r.runtime, r.dialect) for r in tables["binding"].collect()}
    assert b == {"W.NET": ("warehouse", "snowflake"), "m.net": ("dbt", "snowflake"), "L.NET": ("spark", "spark"),
                 "d.bill": ("databricks", "databricks")}
    assert [tuple(r) for r in tables["edge"].collect()] == [("fin.logic.net_usd.v1", "fin.data.bill.v1", "source_input", "declared")]
    path = new_path(spark, "registry")
    write_registry(tables, path)
    write_registry(tables, path)
    assert read_registry(spark, path)["artifact"].count() == 2


def test_binding_by_runtime(spark, tables):
    ask = spark.createDataFrame([(1, "fin.logic.net_usd.v1", "dbt", None), (2, "fin.logic.net_usd.v1", None, None),
                                 (3, "fin.logic.net_usd.v1", "flink", None), (4, "nope.v1", None, None)],
                                "request_id int, fqn string, runtime string, dialect string")
    got = {r.request_id: r for r in R.resolve_bindings(ask, tables["artifact"], tables["binding"]).collect()}
    assert got[1].recommended_ref == "m.net" and set(got[1].alternatives) == {"W.NET", "L.NET"}
    assert got[2].recommended_env == "prod" and got[2].recommended_ref == "m.net"
    assert got[3].recommended_ref is None and got[3].note == (
        "No binding matches runtime='flink' dialect=None. 3 binding(s) exist on other runtimes.")
    assert got[4].note == "'nope.v1' is not registered."


def test_code_tree_and_candidates(spark, tables, tmp_path):
    for rel, data in {
        "finance/net.sql": b"SELECT 1", "finance/net.py": b"def f(df): pass", "finance/__init__.py": b"", "finance/venv/x.sql": b"no",
        "sales/bad.sql": b"\xff\xfe\xfa", "other/x.sql": b"no", "finance/readme.md": b"no",
    }.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    code = read_code_tree(spark, str(tmp_path))
    assert sorted((r.logical_id, r.language) for r in code.collect()) == [("finance/net.py", "python"), ("finance/net.sql", "sql")]
    pick = lambda lang: [(r.logical_id, r.source_path) for r in registered_candidates(
        tables["artifact"], tables["binding"], code, lang).collect()]
    assert pick("python") == [("fin.logic.net_usd.v1", "finance/net.py")]
    assert pick("") == [("fin.logic.net_usd.v1", "finance/net.sql")]


DOCS = [
    ("a.b.net_revenue.v1", "Net revenue", "revenue of the net kind", "a net revenue"),
    ("a.b.active.v1", "Active customer", "customers with revenue", "x"),
    ("a.b.gross.v2", "Gross-margin", "100% of it", "path a_b c"),
    ("a.c.empty.v1", None, None, ""),
]


@pytest.fixture(scope="module")
def index(spark):
    return X.build_index(spark.createDataFrame(DOCS, "fqn string, title string, description string, body string"))


def bm25(query):
    cols = ("fqn", "title", "description", "body")
    toks = [[re.findall(r"[^\W_]+", (d[i] or "").lower()) for i in range(4)] for d in DOCS]
    size = [sum(map(len, t)) for t in toks]
    avg, out = sum(size) / len(DOCS), {}
    for word in query.split():
        pieces = re.findall(r"[^\W_]+", word.lower())
        f = []
        for t in toks:
            n = 0.0
            for c, col in enumerate(t):
                for s in range(len(col) - len(pieces) + 1):
                    run = col[s:s + len(pieces)]
                    if run[:-1] == pieces[:-1] and run[-1].startswith(pieces[-1]):
                        n += X.WEIGHTS[cols[c]]
            f.append(n)
        df = sum(1 for x in f if x)
        idf = math.log((len(DOCS) - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, x in enumerate(f):
            if x:
                out[i] = out.get(i, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / avg))
    return {DOCS[i][0]: round(s, 6) for i, s in out.items()}


@pytest.mark.parametrize("q", ["net", "rev cust", "net_rev", "b_net_revenue", "zzz act", "net net"])
def test_ranked_search_equals_brute_force(spark, index, q):
    got = X.search(spark.createDataFrame([(q,)], "query string"), index, 10).orderBy("rank").collect()
    assert {r.fqn: r.score for r in got} == pytest.approx(bm25(q)) and got
    assert [r.fqn for r in got] == [f for f, _ in sorted(bm25(q).items(), key=lambda t: (-t[1], t[0]))]


@pytest.mark.parametrize("q,want", [
    ("gross-mar", ["a.b.gross.v2"]), ("00%", ["a.b.gross.v2"]), ("B.ACT", ["a.b.active.v1"]), ("no such", []),
    ("a.", ["a.b.active.v1", "a.b.gross.v2", "a.b.net_revenue.v1", "a.c.empty.v1"]), ("r_venue-", []), ("t r%e.", []),
    ("a.b.n_t", ["a.b.net_revenue.v1"]),
])
def test_substring_fallback(spark, index, q, want):
    got = X.search(spark.createDataFrame([(q,)], "query string"), index, 10).orderBy("rank").collect()
    assert [r.fqn for r in got] == want and {r.matched_by for r in got} <= {"substring"}


def test_pages_stop_at_the_end_or_a_gap(spark):
    body = '{"accounts":[{"id":%d},{"id":%d}],"next_page":%s}'
    df = spark.createDataFrame([
        ("a", 1, body % (1, 2, "2")), ("a", 2, body % (3, 4, "null")), ("a", 3, body % (5, 6, "4")),
        ("b", 1, body % (7, 8, "2")), ("b", 3, body % (9, 9, "4")), ("c", 2, body % (1, 1, "3")),
    ], "source string, page int, body string")
    out = flatten_pages(df, "accounts", "struct<id: bigint>", F.get_json_object("body", "$.next_page").isNotNull())
    assert sorted((r.source, r.record.id) for r in out.collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7), ("b", 8)]


def test_pages_beyond_any_round_number(spark):
    body = F.concat(F.lit('{"accounts":[{"id":'), F.col("page").cast("string"), F.lit('}],"next_page":"x"}'))
    df = spark.range(1, 301).select(F.lit("a").alias("source"), F.col("id").cast("int").alias("page")).where("page <> 251").withColumn("body", body)
    more = F.get_json_object("body", "$.next_page").isNotNull()
    assert flatten_pages(df, "accounts", "struct<id: bigint>", more).count() == 250
    assert flatten_pages(df, "accounts", "struct<id: bigint>", more, max_pages=40).count() == 40


def test_payload_drops_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert to_payload(df).first().payload == '{"a":1}'


def test_facets_and_find(spark, tables):
    a, b = tables["artifact"], tables["binding"]
    assert R.facet(a, b, interface="callable_logic", lifecycle="certified", runtime="dbt").count() == 1
    assert R.facet(a, b, runtime="semantic").count() == 0
    assert R.find(a, exact="fin.data.bill.v1").count() == 1 and R.find(a, keyword="NET").count() == 1

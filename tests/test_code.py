import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reuselake.functions import text as T
from reuselake.operators import compare as C
from reuselake.operators import graph as G
from reuselake.operators import similarity as S
from reuselake.operators.skew import salted_join
from reuselake.plans.fixtures import Lake


def sets(spark, seed, n, hot=True):
    """Random sets over a skewed vocabulary, a third of them copies of one set."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if hot and i % 3 == 0:
            out.append((i, [f"h{j}" for j in range(12)] + [f"x{r.randint(0, 2)}"]))
        else:
            out.append((i, sorted({f"t{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randint(0, 14))})))
    return [(i, list(dict.fromkeys(e))) for i, e in out], spark.createDataFrame(
        [(i, list(dict.fromkeys(e))) for i, e in out], "id long, elements array<string>")


@pytest.mark.parametrize("threshold", [(0, 1), (1, 8), (1, 2), (3, 5), (9, 10), (1, 1)])
def test_similarity_join_equals_brute_force(spark, threshold):
    a, left = sets(spark, 1, 60)
    b, right = sets(spark, 2, 40)
    num, den = threshold
    want = set()
    for i, x in a:
        for j, y in b:
            o, u = len(set(x) & set(y)), len(set(x) | set(y))
            if o and o * den >= u * num:
                want.add((i, j, o))
    for join in (S.similar_pairs, S.similar_rows):
        got = join(left, right, threshold).select("left_id", "right_id", "overlap").collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want


def test_shingles_of_short_and_long_texts(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c", "a", "b", "c"],)], "t array<string>")
    got = [r[0] for r in df.select(T.shingles(F.col("t"))).collect()]
    assert got == [[], ["a"], ["a b"], ["a b c", "b c a", "c a b"]]


def test_lsh_misses_nothing(spark):
    """Pairs of distinct sets as the exact join finds them, and every copy beside its first."""
    rows, df = sets(spark, 9, 90)
    near = sorted((r.left_id, r.right_id) for r in S.near_duplicates_lsh(df).collect())
    first = {}
    for i, x in rows:
        if x:
            first.setdefault(frozenset(x), i)
    want = [(first[frozenset(x)], i) for i, x in rows if x and first[frozenset(x)] != i]
    for x, i in first.items():
        for y, j in first.items():
            if i < j and 5 * len(x & y) >= 4 * len(x | y):
                want.append((i, j))
    assert near == sorted(want)


def test_embedding_topk_equals_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    m = v.astype("float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(m @ m.T, 4)
    got = {}
    for r in S.embedding_topk(df, df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.candidate_id, r.cosine))
    for i in range(50):
        best = sorted((-cos[i, j], j) for j in range(50) if j != i)[:3]
        assert [(a, b, pytest.approx(c)) for a, b, c in sorted(got[i])] == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    pairs = {(r.a, r.b) for r in S.embedding_pairs(df, df, 0.6).collect()}
    assert pairs == {(i, j) for i in range(50) for j in range(i + 1, 50) if cos[i, j] >= 0.6}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)],
    [(99, i) for i in range(60)] + [(5, 200), (200, 201)],
    [(1, 2), (3, 4), (4, 2), (10, 11), (7, 7)],
])
def test_components_equal_union_find(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.cluster for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in list(parent)}
    sizes = {r.cluster: r.members for r in G.cluster_sizes(spark.createDataFrame(list(got.items()), "node long, cluster long")).collect()}
    assert sizes == dict(Counter(got.values()))


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "from_fqn string, to_fqn string")
    roots = spark.createDataFrame([("a",)], "fqn string")
    got = {r.node: r.depth for r in G.impact_closure(edges, roots).collect()}
    assert got == {"b": 1, "c": 2, "d": 3, "a": 3}
    assert {r.node for r in G.impact_closure(edges, roots, max_depth=1).collect()} == {"b"}


def test_salted_join_keeps_each_row_once(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    assert salted_join(big, small, "k", "id").count() == big.join(small, "k").count()
    assert salted_join(big, small, "k", "id", how="left").count() == 300
    assert salted_join(big, small, "k", "id", how="left_anti").count() == 99


# -- known answers, in our own words --------------------------------------------------------------

RULE = """CREATE FUNCTION net_usd(a DATE, b DATE) AS $$
SELECT e.customer_id, sum(e.net_amount) AS revenue FROM finance.billable AS e
JOIN finance.rates AS r ON r.code = e.currency WHERE e.recognizable GROUP BY e.customer_id
$$"""
RETIRED = "SELECT invoice_id, customer_id, amount AS revenue FROM dwh.invoices WHERE status = 'POSTED'"
ACTIVE = "SELECT customer_id FROM sales.events WHERE event_date >= d - 90 GROUP BY customer_id"


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame([
        ("fin.logic.net_usd.v1", RULE, "Net USD", "certified", "finance", "enterprise_canonical", "udf.net_usd"),
        ("fin.data.invoice_revenue.v1", RETIRED, "Invoice revenue", "retired", None, "domain_canonical", "view.inv"),
        ("sales.data.active.v1", ACTIVE, "Active", "certified", "sales", "enterprise_canonical", "view.act"),
    ], "logical_id string, text string, title string, lifecycle string, owner string, reuse_intent string, binding_ref string")


CASES = [
    (1, """select  e.customer_id, SUM( e.net_amount ) as revenue  -- tidy copy
from finance.billable as e join finance.rates as r on r.code = e.currency where e.recognizable group by e.customer_id"""),
    (2, RULE.replace("e.", "z.").replace("AS e", "AS z").replace("net_amount", "amt").replace("billable", "bill2")),
    (3, "SELECT invoice_id, customer_id, amount AS revenue\nFROM dwh.invoices\nWHERE status = 'POSTED' AND 1 = 1"),
    (4, 'def active(df, d):\n    return df.groupBy("customer_id").agg(F.count("x"))'),
    (5, "SELECT 1"),
]


def shingles(tokens):
    return {" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)} if len(tokens) >= 3 else {" ".join(tokens)} - {""}


def brute(queries, cands, k, registered=True):
    """The same scoring over all pairs in plain Python, fed by the library's own features."""
    out = {}
    for qid, ql, qt, qb in queries:
        scored = []
        for cid, cl, ct, cb, life in cands:
            a, b = shingles(qt), shingles(ct)
            ast = None if ql != cl else (len(a & b) / len(a | b) if a and b else 0.0)
            f = round(len(set(qb) & set(cb)) / len(set(qb) | set(cb)), 4) if qb and cb else 0.0
            comb = round(0.8 * ast + 0.2 * f, 4) if ast is not None else f
            scored.append((-comb, cid, ast, f))
        out[qid] = [(c, -s, a, f) for s, c, a, f in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_compare_equals_brute_force(spark, candidates, k):
    queries = spark.createDataFrame(CASES, "id int, text string")
    got = {}
    for r in C.compare(queries, candidates, k=k).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.logical_id, pytest.approx(r.combined, abs=1e-4), r.ast, r.feature))
    fq = T.featurize(queries, mode="ws").select("id", "language", "tokens", "bag").collect()
    fc = T.featurize(candidates, mode="ws").select("logical_id", "language", "tokens", "bag", "lifecycle").collect()
    want = brute([tuple(r) for r in fq], [tuple(r) for r in fc], k)
    assert got == want


def test_known_answers(spark, candidates):
    queries = spark.createDataFrame(CASES, "id int, text string")
    best = {r.id: r for r in C.compare(queries, candidates, mode="lex").filter("rank = 1").collect()}
    assert (best[1].logical_id, best[1].relationship, best[1].ast) == ("fin.logic.net_usd.v1", "DIRECT_MATCH", 1.0)
    assert best[2].logical_id == "fin.logic.net_usd.v1" and best[2].owner == "finance"
    assert (best[3].logical_id, best[3].lifecycle, best[3].owner) == ("fin.data.invoice_revenue.v1", "retired", "UNKNOWN")
    assert best[4].ast is None and best[4].relationship == "VALID_ALTERNATE_BINDING" and best[4].method == "feature"
    assert best[5].combined < 0.30
    assert list(best[1].warnings) == [C.NO_VECTORS_WARNING]
    text = {r.id: r.summary for r in C.summarize(queries, C.compare(queries, candidates, mode="lex")).collect()}
    assert text[1].startswith("Closest match: fin.logic.net_usd.v1 [DIRECT_MATCH]") and text[5] == C.SAFE_SUMMARY


def test_ungoverned_scope(spark, candidates):
    queries = spark.createDataFrame(CASES, "id int, text string")
    for r in C.compare(queries, candidates, scope="workspace").collect():
        assert {r.lifecycle, r.owner, r.reuse_intent, r.authority} == {"UNKNOWN"}
        assert r.coverage == "CURRENT_WORKSPACE_ONLY" and len(r.warnings) == 6
        assert r.recommended_action == C.UNREGISTERED_ACTION and r.relationship != "VALID_ALTERNATE_BINDING"


def test_no_candidates(spark, candidates):
    queries = spark.createDataFrame(CASES, "id int, text string")
    none = candidates.filter("logical_id = 'x'")
    got = C.summarize(queries, C.compare(queries, none)).collect()
    assert len(got) == 5 and {r.summary for r in got} == {C.NO_CANDIDATES_SUMMARY}


def test_vectors_take_part(spark, candidates):
    queries = spark.createDataFrame(CASES, "id int, text string")
    docs = T.featurize(queries).select(T.profile_document(F.col("profile")).alias("document")).union(
        T.featurize(candidates).select(T.profile_document(F.col("profile")))).distinct().collect()
    rng = np.random.default_rng(1)
    vec = {r.document: rng.normal(size=6) for r in docs}
    vectors = spark.createDataFrame([(d, [float(x) for x in v]) for d, v in vec.items()], "document string, embedding array<double>")
    out = C.compare(queries, candidates, vectors=vectors).collect()
    assert {r.method for r in out if r.id == 4} == {"embedding"} and all(len(r.warnings) == 0 for r in out)
    text = {r.id: r.d for r in T.featurize(queries).select("id", T.profile_document(F.col("profile")).alias("d")).collect()}
    other = {r.logical_id: r.d for r in T.featurize(candidates).select("logical_id", T.profile_document(F.col("profile")).alias("d")).collect()}
    cos = lambda x, y: round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 4)
    score = {(r.id, r.logical_id): (r.combined, r.embedding) for r in out}
    for k in (1, 2):  # a score does not depend on k, and the best k are the first k of more
        few = C.compare(queries, candidates, vectors=vectors, k=k).collect()
        assert all(score[r.id, r.logical_id] == (r.combined, r.embedding) for r in few)
        assert {(r.id, r["rank"], r.logical_id) for r in few} == {(r.id, r["rank"], r.logical_id) for r in out if r["rank"] <= k}
    for r in out:
        if r.combined > 0:
            assert r.embedding == pytest.approx(cos(vec[text[r.id]], vec[other[r.logical_id]]), abs=2e-4)


def test_vectors_are_computed_once(spark, monkeypatch):
    """A vector table may be a long plan (a model, a join): compare reads it once and keeps it."""
    class Seen(Exception):
        pass

    def nearest(q, c, vectors, k):
        raise Seen(vectors._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(C, "_nearest", nearest)
    snippets = spark.createDataFrame([(1, "SELECT SUM(a) AS x FROM t"), (2, "SELECT b FROM u GROUP BY b")], "id int, text string")
    candidates = spark.createDataFrame([("d.a.v1", "SELECT SUM(a) AS x FROM t", "t")], "logical_id string, text string, title string")
    vectors = spark.createDataFrame([("d", 1)], "document string, n int").groupBy("document").agg(F.array(F.sum("n").cast("double")).alias("embedding"))
    with pytest.raises(Seen) as seen:
        C.compare(snippets, candidates, k=1, vectors=vectors)
    assert "Aggregate" not in str(seen.value) and "parquet" in str(seen.value)


def test_shared_parts_of_the_rules_are_steps_of_their_own(spark):
    df = spark.createDataFrame([(1, "# fx\ndef f(a):\n    return a.join(b, 'c')"), (2, "SELECT x FROM y -- tax\nGROUP BY x"), (3, None)], "id int, text string")
    out = T.featurize(df)
    assert out.columns == ["id", "text", "language", "tokens", "fingerprint", "profile", "bag"]
    rows = {r.id: r for r in out.collect()}
    assert rows[1].bag == ["concept:fx", "joins:1", "src:a"] and rows[2].bag == ["concept:tax", "grp:x", "src:y"] and rows[3].bag is None
    plan = out.select("bag")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("'''") == 2  # docstrings are stripped in one place

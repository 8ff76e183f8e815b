"""Queries of governance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reuselake.functions import text as X
from reuselake.operators import governance as G
from reuselake.operators.similarity import exact_duplicates
from reuselake.plans.catalog import query
from reuselake.plans.code_queries import _FP
from reuselake.plans.fixtures import AS_OF
from reuselake.plans.registry_queries import registry

ART = "artifact"


@query("gate_metadata", """SELECT fqn, 'missing_owner' AS violation FROM artifact WHERE lifecycle IN ('shared', 'certified') AND owner IS NULL""", ART)
def _(lake):
    return G.gate_metadata(registry(lake)["artifact"])


_NAMES = """names AS (SELECT 'fin.' || CASE p_size % 4 WHEN 0 THEN 'marts' WHEN 1 THEN 'Reporting' ELSE 'reporting' END || '.a' || p_partkey ||
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.v' || p_size END AS fqn FROM part)"""


@query("gate_fqn", rf"""WITH {_NAMES} SELECT fqn, 'bad_fqn' AS violation FROM names WHERE NOT regexp_matches(fqn, '{G.FQN_PATTERN}')
  UNION ALL SELECT fqn, 'physical_namespace' FROM names WHERE split_part(fqn, '.', 2) IN ('marts', 'staging', 'raw')""")
def _(lake):
    p = F.col("p_partkey")
    ns = F.when(F.col("p_size") % 4 == 0, "marts").when(F.col("p_size") % 4 == 1, "Reporting").otherwise("reporting")
    tail = F.when(p % 5 == 0, "").otherwise(F.concat(F.lit(".v"), F.col("p_size").cast("string")))
    return G.gate_fqn(lake.part.select(F.concat(F.lit("fin."), ns, F.lit(".a"), p.cast("string"), tail).alias("fqn")))


@query("fqn_collisions", """SELECT fqn, count(*) AS entries FROM (SELECT 'x.' || lower(p_type) || '.' || replace(p_name, ' ', '_') || '.v' || p_size AS fqn FROM part)
  GROUP BY 1 HAVING count(*) > 1""")
def _(lake):
    name = F.concat(F.lit("x."), F.lower("p_type"), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit(".v"), F.col("p_size").cast("string"))
    return G.fqn_collisions(lake.part.select(name.alias("fqn")))


@query("check_vocab", """SELECT ord AS key, 'unknown_lifecycle' AS violation FROM artifact WHERE lifecycle NOT IN ('local', 'shared')
  UNION ALL SELECT ord, 'unknown_reuse_intent' FROM artifact WHERE reuse_intent NOT IN ('enterprise_canonical', 'domain_canonical')""", ART)
def _(lake):
    a = lake.artifact.select(F.col("ord").alias("key"), "lifecycle", "reuse_intent")
    return G.check_vocab(a, "key", {"lifecycle": ("local", "shared"), "reuse_intent": ("enterprise_canonical", "domain_canonical")})


_DIFF = """o AS (SELECT * FROM contract WHERE version = 1), n AS (SELECT * FROM contract WHERE version = 2),
  df AS (SELECT coalesce(o.dataset, n.dataset) AS dataset, coalesce(o.column_name, n.column_name) AS column_name,
    CASE WHEN n.type IS NULL THEN 'removed' WHEN o.type IS NULL AND n.nullable = 0 THEN 'added_required' WHEN o.type IS NULL THEN 'added_nullable'
      WHEN o.type <> n.type THEN 'retyped' WHEN o.nullable = 1 AND n.nullable = 0 THEN 'tightened' END AS change
    FROM o FULL JOIN n ON o.dataset = n.dataset AND o.column_name = n.column_name)"""


@query("gate_breaking", f"""WITH {_DIFF} SELECT *, change IN ('removed', 'added_required', 'retyped') AS breaking FROM df WHERE change IS NOT NULL""", "contract")
def _(lake):
    return G.schema_diff(lake.contract, 1, 2)


@query("grain_changes", """WITH g AS (SELECT dataset, version, column_name FROM contract WHERE nullable = 0),
  p AS (SELECT dataset, string_agg(DISTINCT CASE WHEN version = 1 THEN column_name END, ',' ORDER BY CASE WHEN version = 1 THEN column_name END) AS old_grain,
    string_agg(DISTINCT CASE WHEN version = 2 THEN column_name END, ',' ORDER BY CASE WHEN version = 2 THEN column_name END) AS new_grain FROM g GROUP BY 1)
  SELECT * FROM p WHERE old_grain <> new_grain""", "contract")
def _(lake):
    return G.grain_changes(lake.contract.filter("nullable = 0"), 1, 2)


_FIELDS = """mf AS (SELECT 'm' || p_partkey AS metric, unnest(['filter', 'aggregation', 'dimension', 'owner']) AS field,
    unnest([lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'sum' ELSE 'count' END, p_brand, 'x']) AS old_value,
    unnest([CASE WHEN p_size % 5 = 0 THEN 'none' ELSE lower(p_type) END, 'sum', CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END, 'y']) AS new_value FROM part)"""


@query("gate_semantic", f"""WITH {_FIELDS} SELECT metric, field, old_value, coalesce(new_value, '') AS new_value FROM mf
  WHERE field <> 'owner' AND old_value IS DISTINCT FROM new_value""")
def _(lake):
    rows = lambda *v: F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), x.alias("value")) for f, x in zip(("filter", "aggregation", "dimension", "owner"), v)
    ]))
    size, name = F.col("p_size"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("metric")
    kind = F.lower("p_type")
    agg = F.when(size % 2 == 0, "sum").otherwise("count")
    old = lake.part.select(name, rows(kind, agg, F.col("p_brand"), F.lit("x")).alias("f")).select("metric", "f.*")
    new = lake.part.select(name, rows(
        F.when(size % 5 == 0, "none").otherwise(kind), F.lit("sum"), F.when(size % 7 != 0, F.col("p_brand")), F.lit("y")
    ).alias("f")).select("metric", "f.*").filter("value IS NOT NULL")
    return G.gate_semantic(old, new)


@query("gate_version", f"""WITH {_DIFF}, b AS (SELECT dataset, bool_or(change IN ('removed', 'added_required', 'retyped')) AS breaking FROM df WHERE change IS NOT NULL GROUP BY 1),
  c AS (SELECT dataset || '.v1' AS old_fqn, dataset || CASE WHEN length(dataset) % 2 = 0 THEN '.v1' ELSE '.v2' END AS new_fqn, breaking FROM b)
  SELECT *, CASE WHEN breaking AND old_fqn = new_fqn THEN 'block' ELSE 'allow' END AS outcome FROM c""", "contract")
def _(lake):
    b = G.schema_diff(lake.contract, 1, 2).groupBy("dataset").agg(F.bool_or("breaking").alias("breaking"))
    tail = F.when(F.length("dataset") % 2 == 0, ".v1").otherwise(".v2")
    return G.gate_version(b.select(
        F.concat("dataset", F.lit(".v1")).alias("old_fqn"), F.concat("dataset", tail).alias("new_fqn"), "breaking"))


_POLICY = "(VALUES ('certified', 'exact', 'review', true), ('shared', 'exact', 'warn', false)) p(lifecycle, match_kind, outcome, evidence)"


@query("gate_duplication", f"""WITH {_FP}, d AS (SELECT id FROM (SELECT id, min(id) OVER w AS f, count(*) OVER w AS n FROM fp
      WINDOW w AS (PARTITION BY language, dialect, fingerprint)) WHERE n > 1 AND id <> f),
  ok AS (SELECT ord FROM exception_grant WHERE justified AND owner_approved AND expiry_date >= date'{AS_OF}')
  SELECT d.id, a.lifecycle, 'exact' AS match_kind, CASE WHEN evidence AND d.id NOT IN (SELECT ord FROM ok) THEN 'block' ELSE outcome END AS outcome
  FROM d JOIN artifact a ON a.ord = d.id JOIN {_POLICY} ON p.lifecycle = a.lifecycle""", "sql_snippet artifact exception_grant")
def _(lake):
    copies = exact_duplicates(X.featurize(lake.sql_snippet)).filter("id <> first_id").select("id")
    matches = copies.join(lake.artifact.select(F.col("ord").alias("id"), "lifecycle"), "id").withColumn("match_kind", F.lit("exact"))
    policy = lake.spark.createDataFrame(
        [("certified", "exact", "review", True), ("shared", "exact", "warn", False)],
        "lifecycle string, match_kind string, outcome string, evidence boolean",
    )
    return G.gate_duplication(matches, lake.exception_grant.withColumnRenamed("ord", "id"), policy, AS_OF)


@query("valid_exceptions", f"""SELECT ord AS id, expiry_date FROM exception_grant WHERE justified AND owner_approved AND expiry_date >= date'{AS_OF}'""", "exception_grant")
def _(lake):
    return G.valid_exceptions(lake.exception_grant.withColumnRenamed("ord", "id"), AS_OF).select("id", "expiry_date")


@query("gate_retired_refs", """WITH e AS (SELECT DISTINCT from_fqn, to_fqn FROM dependency_edge), old AS (SELECT DISTINCT from_fqn, to_fqn FROM dependency_edge WHERE relationship = 'source_input')
  SELECT e.from_fqn, e.to_fqn, lifecycle AS lifecycle_state, CASE WHEN o.to_fqn IS NULL THEN 'block' WHEN lifecycle = 'deprecated' THEN 'migrate' ELSE 'remove' END AS outcome
  FROM e JOIN artifact a ON a.fqn = e.to_fqn LEFT JOIN old o ON o.from_fqn = e.from_fqn AND o.to_fqn = e.to_fqn WHERE lifecycle IN ('deprecated', 'retired')""",
       "artifact dependency_edge")
def _(lake):
    t = registry(lake)
    return G.gate_retired_refs(t["edge"], t["edge"].filter("relationship = 'source_input'"), t["artifact"])


_DEP = """dp AS (SELECT fqn, CASE WHEN ord % 4 <> 0 THEN date'2000-06-01' + cast(ord % 100 AS int) END AS deprecated_since,
    CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN fqn || 'x' ELSE fqn END AS replacement,
    CASE WHEN ord % 6 <> 1 THEN date'2000-12-15' + cast(ord % 120 AS int) END AS removal_after FROM artifact WHERE lifecycle = 'deprecated')"""


@query("deprecation_complete", f"""WITH {_DEP} SELECT fqn, 'missing_since' AS violation FROM dp WHERE deprecated_since IS NULL
  UNION ALL SELECT fqn, 'missing_replacement' FROM dp WHERE replacement IS NULL
  UNION ALL SELECT fqn, 'unregistered_replacement' FROM dp WHERE replacement IS NOT NULL AND replacement NOT IN (SELECT fqn FROM artifact)
  UNION ALL SELECT fqn, 'missing_removal_date' FROM dp WHERE removal_after IS NULL
  UNION ALL SELECT fqn, 'sunset_passed' FROM dp WHERE removal_after < date'{AS_OF}'""", ART)
def _(lake):
    n = F.col("ord")
    dep = lake.artifact.filter("lifecycle = 'deprecated'").select(
        "fqn", F.when(n % 4 != 0, F.date_add(F.lit("2000-06-01").cast("date"), (n % 100).cast("int"))).alias("deprecated_since"),
        F.when(n % 3 == 1, F.concat("fqn", F.lit("x"))).when(n % 3 == 2, F.col("fqn")).alias("replacement"),
        F.when(n % 6 != 1, F.date_add(F.lit("2000-12-15").cast("date"), (n % 120).cast("int"))).alias("removal_after"),
    )
    return G.deprecation_complete(dep, lake.artifact, AS_OF)


_SNAP = """sn AS (SELECT p_brand || '/' || p_type AS fqn, date'2001-01-01' + cast(p_partkey AS int) AS snapshot_date,
    CASE p_size % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'shared' WHEN 2 THEN 'certified' WHEN 3 THEN 'deprecated' ELSE 'retired' END AS lifecycle_state FROM part)"""


@query("gate_lifecycle", f"""WITH {_SNAP}, l AS (SELECT *, lag(lifecycle_state) OVER (PARTITION BY fqn ORDER BY snapshot_date) AS from_state FROM sn)
  SELECT fqn, snapshot_date, from_state, lifecycle_state AS to_state FROM l WHERE from_state <> lifecycle_state AND (from_state, lifecycle_state) NOT IN
    (('local', 'shared'), ('shared', 'certified'), ('certified', 'deprecated'), ('deprecated', 'retired'))""")
def _(lake):
    state = F.element_at(F.array(*[F.lit(s) for s in G.LIFECYCLES]), (F.col("p_size") % 5 + 1).cast("int"))
    return G.gate_lifecycle(lake.part.select(
        F.concat_ws("/", "p_brand", "p_type").alias("fqn"),
        F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_partkey").cast("int")).alias("snapshot_date"), state.alias("lifecycle_state")))


@query("contract_check", """SELECT 'missing_column' AS "check", 'tax_code' AS "column", cast(1 AS bigint) AS violations
  UNION ALL SELECT 'wrong_type', 'l_quantity', 1
  UNION ALL SELECT 'duplicate_grain', 'l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def _(lake):
    return G.contract_check(lake.lineitem, [
        ("l_orderkey", "bigint", False), ("l_quantity", "decimal(18,2)", False), ("l_tax", "number", True),
        ("l_shipdate", "timestamp", False), ("tax_code", "string", True),
    ], ["l_orderkey", "l_linenumber"])


@query("grain_violations", """SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(lake):
    return G.grain_violations(lake.lineitem, ["l_orderkey", "l_linenumber"])


@query("freshness", """SELECT max(ts) AS newest, datediff('minute', date_trunc('minute', max(ts)), timestamp '2024-01-31 00:00:00') -
    CASE WHEN max(ts) > date_trunc('minute', max(ts)) THEN 1 ELSE 0 END AS age_minutes,
    datediff('minute', max(ts), timestamp '2024-01-31 00:00:00') <= 1440 AS fresh FROM events""")
def _(lake):
    return G.freshness(lake.events, "ts", "2024-01-31 00:00:00", 1440)


@query("gate_scope", """SELECT fqn, 'published_out_of_scope' AS violation FROM artifact WHERE reuse_intent = 'enterprise_canonical' AND lifecycle NOT IN ('shared', 'certified')
  UNION ALL SELECT l.fqn, 'missing_canonical_pointer' FROM artifact l WHERE lifecycle = 'local' AND ord % 3 <> 0
    AND title IN (SELECT title FROM artifact WHERE lifecycle = 'certified')""", ART)
def _(lake):
    from reuselake.operators.registry import local_pointers

    a = registry(lake)["artifact"]
    own = lake.artifact.select("fqn", F.when(F.col("ord") % 3 == 0, F.col("fqn")).alias("canonical_pointer"))
    return G.gate_scope(a, a.filter("reuse_intent = 'enterprise_canonical'"), local_pointers(a, F.col("title")).join(own, "fqn"))

"""Queries of registry lookup, search, composition and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.operators import graph as G
from reuselake.operators import registry as R
from reuselake.operators import search as X
from reuselake.operators.skew import shuffled
from reuselake.plans.catalog import query
from reuselake.plans.fixtures import Lake
from reuselake.sources.manifests import registry_tables
from reuselake.sources.pages import flatten_pages

ART = "artifact binding dependency_edge"


def registry(lake: Lake) -> dict[str, DataFrame]:
    """The fixture artifacts in the registry's own tables."""
    b = lake.binding.groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ordinal").alias("position"), "system", "env", "object_type", "physical_ref"))).alias("bindings"))
    d = lake.dependency_edge.groupBy(F.col("from_fqn").alias("fqn")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("to_fqn").alias("fqn"), "relationship"))).alias("dependencies"))
    empty = F.array().cast("array<struct<fqn:string,relationship:string>>")
    raw = lake.artifact.join(shuffled(b), "fqn", "left").join(shuffled(d), "fqn", "left").select(
        "fqn", "ord", "title", "description", F.array("interface_type").alias("interface_types"),
        F.col("lifecycle").alias("lifecycle_state"), "reuse_intent", F.lit("producer").alias("entry_role"),
        F.col("owner").alias("owner_team"), F.array().cast("array<string>").alias("aliases"),
        empty.alias("known_consumers"), "bindings", "dependencies",
    )
    return registry_tables(raw)


RUNTIME = """CASE WHEN system = 'databricks' THEN 'databricks' WHEN system = 'dbt' OR object_type = 'macro' THEN 'dbt' ELSE 'warehouse' END"""
DIALECT = "CASE WHEN system = 'databricks' THEN 'databricks' ELSE 'snowflake' END"
BIND = f"bnd AS (SELECT *, {RUNTIME} AS runtime, {DIALECT} AS dialect FROM binding)"
BODY = f"""{BIND}, bt AS (SELECT fqn, string_agg(physical_ref, ' ' ORDER BY ordinal) AS refs, string_agg(object_type, ' ' ORDER BY ordinal) AS types FROM bnd GROUP BY 1),
  dt AS (SELECT from_fqn AS fqn, string_agg(to_fqn, ' ' ORDER BY to_fqn, relationship) AS deps FROM dependency_edge GROUP BY 1),
  art AS (SELECT a.*, concat_ws(' ', a.fqn, title, description, reuse_intent, interface_type, deps, refs, types) AS body
    FROM artifact a LEFT JOIN bt ON bt.fqn = a.fqn LEFT JOIN dt ON dt.fqn = a.fqn)"""


def _rank_sql(asked: str) -> str:
    """Ranked hits ``rk(query, fqn, score, rank)`` of the plain-word queries in ``asked``."""
    cols = " UNION ALL ".join(f"SELECT fqn, {w}::DOUBLE AS w, {c} AS x FROM art" for c, w in X.WEIGHTS.items())
    return f"""{BODY}, tok AS (SELECT fqn, w, unnest(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+')) AS token FROM ({cols})),
  post AS (SELECT token, fqn, sum(w) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT fqn, count(*) AS length FROM tok GROUP BY 1),
  st AS (SELECT count(*) AS n, avg(length) AS av FROM dl),
  tm AS (SELECT query, unnest(list_filter(string_split(query, ' '), lambda t: t <> '')) AS word FROM (SELECT DISTINCT query FROM {asked})),
  ht AS (SELECT word, fqn, sum(tf) AS f FROM (SELECT DISTINCT word FROM tm) JOIN post ON starts_with(token, lower(word)) GROUP BY 1, 2),
  idf AS (SELECT word, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf
    FROM ht, st GROUP BY word, n),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, fqn) AS rank FROM (
    SELECT query, ht.fqn, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / av))), 6) AS score
    FROM tm JOIN ht USING (word) JOIN idf USING (word) JOIN dl ON dl.fqn = ht.fqn, st GROUP BY 1, 2))"""


@query("search_top5", f"WITH {_rank_sql('intent')} SELECT query, fqn, score, cast(rank AS int) AS rank, 'ranked' AS matched_by FROM rk WHERE rank <= 5",
       f"{ART} intent")
def _(lake):
    return X.search(lake.intent, X.build_index(registry(lake)["artifact"]), 5)


@query("search_like_fallback", """WITH q AS (SELECT DISTINCT 'BRAND#' || p_size % 10 AS query FROM part), h AS (SELECT query, fqn FROM q JOIN artifact
    ON contains(lower(fqn), lower(query)) OR contains(lower(title), lower(query)) OR contains(lower(description), lower(query)))
  SELECT query, fqn, cast(NULL AS double) AS score, cast(row_number() OVER (PARTITION BY query ORDER BY fqn) AS int) AS rank,
    'substring' AS matched_by FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY fqn) <= 20""", "artifact")
def _(lake):
    q = lake.part.select(F.concat(F.lit("BRAND#"), (F.col("p_size") % 10).cast("string")).alias("query")).distinct()
    return X.search(q, X.build_index(registry(lake)["artifact"]), 20)


@query("artifact_detail", f"""WITH {BIND}, b AS (SELECT fqn, string_agg(physical_ref || '/' || runtime, ',' ORDER BY ordinal) AS bindings FROM bnd GROUP BY 1),
  d AS (SELECT from_fqn AS fqn, count(*) AS n FROM dependency_edge GROUP BY 1), c AS (SELECT to_fqn AS fqn, count(*) AS n FROM dependency_edge GROUP BY 1)
  SELECT a.fqn, title, lifecycle, coalesce(owner, 'UNKNOWN') AS owner, bindings, coalesce(d.n, 0) AS dependencies, coalesce(c.n, 0) AS consumers
  FROM artifact a LEFT JOIN b ON b.fqn = a.fqn LEFT JOIN d ON d.fqn = a.fqn LEFT JOIN c ON c.fqn = a.fqn""", ART)
def _(lake):
    t = registry(lake)
    refs = F.transform("bindings", lambda b: F.concat_ws("/", b["physical_ref"], b["runtime"]))
    return R.artifact_detail(t["artifact"], t["binding"], t["edge"]).select(
        "fqn", "title", "governance.lifecycle", "governance.owner", F.array_join(refs, ",").alias("bindings"),
        "dependencies", "consumers",
    )


@query("artifact_links", """SELECT from_fqn AS fqn, 'dependency' AS direction, to_fqn AS other, relationship FROM dependency_edge
  UNION ALL SELECT to_fqn, 'consumer', from_fqn, relationship FROM dependency_edge""", ART)
def _(lake):
    return R.artifact_links(registry(lake)["edge"])


_CANON = """cn AS (SELECT query, arg_min(fqn, rank) AS fqn FROM (SELECT query, r.fqn, rank FROM rk r JOIN artifact a ON a.fqn = r.fqn
    WHERE lifecycle <> 'retired' AND reuse_intent = 'enterprise_canonical') GROUP BY query)"""


@query("resolve_concepts", f"""WITH {_rank_sql('intent')}, {_CANON} SELECT i.query, c.fqn, a.title, a.lifecycle AS lifecycle_state, a.reuse_intent
  FROM intent i LEFT JOIN cn c ON c.query = i.query LEFT JOIN artifact a ON a.fqn = c.fqn""", f"{ART} intent")
def _(lake):
    t = registry(lake)
    return R.resolve_concepts(lake.intent, X.build_index(t["artifact"]), t["artifact"])


@query("resolve_concepts_any_tier", f"""WITH {_rank_sql('intent')}, o AS (SELECT query, r.fqn, lifecycle, reuse_intent, row_number() OVER (PARTITION BY query
    ORDER BY CASE reuse_intent WHEN 'enterprise_canonical' THEN 0 WHEN 'domain_canonical' THEN 1 WHEN 'shared_utility' THEN 2 ELSE 99 END, rank) AS k
    FROM rk r JOIN artifact a ON a.fqn = r.fqn WHERE lifecycle <> 'retired')
  SELECT i.query, o.fqn, o.lifecycle AS lifecycle_state, o.reuse_intent FROM intent i LEFT JOIN o ON o.query = i.query AND k = 1""", f"{ART} intent")
def _(lake):
    t = registry(lake)
    out = R.resolve_concepts(lake.intent, X.build_index(t["artifact"]), t["artifact"], enterprise_only=False)
    return out.select("query", "fqn", "lifecycle_state", "reuse_intent")


_REQ = """req AS (SELECT p_brand AS request_id, min(lower(p_type) || ' ' || split_part(p_name, ' ', 1)) AS intent,
    list_concat(list_sort(list_distinct(list(lower(p_type) || ' ' || split_part(p_name, ' ', 2)))), ['zzz unheard']) AS components,
    CASE WHEN min(p_partkey) % 2 = 0 THEN 'warehouse' END AS runtime, cast(NULL AS varchar) AS dialect FROM part GROUP BY 1),
  cmp AS (SELECT request_id, runtime, unnest(components) AS query, unnest(range(len(components))) AS position FROM req),
  asked AS (SELECT query FROM cmp UNION SELECT intent FROM req)"""


def _requests(lake: Lake) -> DataFrame:
    word = lambda n: F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(n)))
    return lake.part.groupBy(F.col("p_brand").alias("request_id")).agg(
        F.min(word(1)).alias("intent"),
        F.concat(F.array_sort(F.collect_set(word(2))), F.array(F.lit("zzz unheard"))).alias("components"),
        F.when(F.min("p_partkey") % 2 == 0, "warehouse").alias("runtime"), F.lit(None).cast("string").alias("dialect"),
    )


_BEST = f"""bb AS (SELECT fqn, physical_ref, runtime, row_number() OVER (PARTITION BY fqn ORDER BY env <> 'prod', env, ordinal) AS k FROM bnd),
  bw AS (SELECT fqn, physical_ref, row_number() OVER (PARTITION BY fqn ORDER BY env <> 'prod', env, ordinal) AS k FROM bnd WHERE runtime = 'warehouse')"""
_COMP = f"""{_REQ}, {_rank_sql('asked')}, {_CANON}, {_BEST}, nb AS (SELECT fqn, count(*) AS n FROM bnd GROUP BY 1),
  comps AS (SELECT request_id, cast(position AS int) AS position, m.query AS concept, CASE WHEN c.fqn IS NULL THEN 'AUTHOR_AND_REGISTER' ELSE 'REUSE_REGISTERED' END AS status,
    c.fqn, CASE WHEN m.runtime IS NULL THEN bb.physical_ref ELSE bw.physical_ref END AS recommended_ref,
    CASE WHEN c.fqn IS NULL THEN '{R.AUTHOR_NOTE}' WHEN n IS NULL THEN '{R.NO_BINDING_NOTE}' WHEN m.runtime IS NOT NULL AND bw.physical_ref IS NULL
      THEN 'No binding matches runtime=''warehouse'' dialect=None. ' || n || ' binding(s) exist on other runtimes.' END AS note
  FROM cmp m LEFT JOIN cn c ON c.query = m.query LEFT JOIN bb ON bb.fqn = c.fqn AND bb.k = 1 LEFT JOIN bw ON bw.fqn = c.fqn AND bw.k = 1 LEFT JOIN nb ON nb.fqn = c.fqn)"""


def _plan(lake: Lake):
    t = registry(lake)
    return R.composition_plan(_requests(lake), X.build_index(t["artifact"]), t["artifact"], t["binding"])


@query("composition_plan", f"WITH {_COMP} SELECT * FROM comps", ART)
def _(lake):
    return _plan(lake)[0]


@query("composition_summary", f"""WITH {_COMP}, n AS (SELECT request_id, count(fqn) AS reuse, count(*) - count(fqn) AS missing,
    string_agg(CASE WHEN fqn IS NULL THEN concept END, ',' ORDER BY position) AS missing_list FROM comps GROUP BY 1),
  dm AS (SELECT request_id, a.fqn, a.lifecycle, len(list_filter(string_split(lower(intent), ' '), lambda w: length(w) >= 3 AND contains(lower(a.fqn || ' ' || a.title), w))) > 0 AS own
    FROM req JOIN cn ON cn.query = intent JOIN artifact a ON a.fqn = cn.fqn)
  SELECT r.request_id, CASE WHEN own THEN dm.fqn END AS direct_match, coalesce(missing_list, '') AS missing,
    CASE WHEN own THEN 'A registered artifact already matches the whole request: ' || dm.fqn || ' [' || dm.lifecycle || ']. Reuse it instead of re-composing.'
      WHEN reuse > 0 THEN 'Reuse ' || reuse || ' registered component(s); author only the ' || missing || ' missing part(s) and the small composition that joins them.'
      ELSE '{R.NEW_WORK}' END AS summary FROM req r LEFT JOIN n USING (request_id) LEFT JOIN dm ON dm.request_id = r.request_id""", ART)
def _(lake):
    return _plan(lake)[1].withColumn("missing", F.array_join("missing", ","))


@query("missing_concepts", f"WITH {_REQ}, {_rank_sql('asked')}, {_CANON} SELECT query FROM asked WHERE query NOT IN (SELECT query FROM cn)", ART)
def _(lake):
    t = registry(lake)
    req = _requests(lake)
    asked = req.select(F.explode("components").alias("query")).union(req.select("intent")).distinct()
    return R.missing_concepts(R.resolve_concepts(asked, X.build_index(t["artifact"]), t["artifact"]))


@query("resolve_bindings", f"""WITH {BIND}, rq AS (SELECT ord AS request_id, CASE WHEN ord % 50 = 0 THEN 'x.' || fqn ELSE fqn END AS fqn,
    CASE ord % 3 WHEN 0 THEN 'dbt' WHEN 1 THEN 'warehouse' END AS runtime, CASE WHEN ord % 7 = 0 THEN 'databricks' END AS dialect FROM artifact),
  j AS (SELECT rq.*, b.physical_ref, b.env, b.ordinal, (rq.runtime IS NULL OR rq.runtime = b.runtime) AND (rq.dialect IS NULL OR rq.dialect = b.dialect) AS ok
    FROM rq LEFT JOIN bnd b ON b.fqn = rq.fqn),
  p AS (SELECT request_id, physical_ref, env, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY env <> 'prod', env, ordinal) AS k FROM j WHERE ok) WHERE k = 1)
  SELECT j.request_id, j.fqn, j.runtime, j.dialect, max(p.physical_ref) AS recommended_ref, max(p.env) AS recommended_env,
    string_agg(CASE WHEN p.ordinal IS NULL OR p.ordinal <> j.ordinal THEN j.physical_ref END, ',' ORDER BY j.ordinal) AS alternatives,
    CASE WHEN j.fqn NOT IN (SELECT fqn FROM artifact) THEN '''' || j.fqn || ''' is not registered.'
      WHEN count(j.physical_ref) = 0 THEN '{R.NO_BINDING_NOTE}'
      WHEN max(p.physical_ref) IS NULL THEN 'No binding matches runtime=' || coalesce('''' || j.runtime || '''', 'None') || ' dialect=' ||
        coalesce('''' || j.dialect || '''', 'None') || '. ' || count(j.physical_ref) || ' binding(s) exist on other runtimes.' END AS note
  FROM j LEFT JOIN p USING (request_id) GROUP BY 1, 2, 3, 4""", ART)
def _(lake):
    t = registry(lake)
    n = F.col("ord")
    req = lake.artifact.select(
        n.alias("request_id"), F.when(n % 50 == 0, F.concat(F.lit("x."), "fqn")).otherwise(F.col("fqn")).alias("fqn"),
        F.when(n % 3 == 0, "dbt").when(n % 3 == 1, "warehouse").alias("runtime"), F.when(n % 7 == 0, "databricks").alias("dialect"),
    )
    out = R.resolve_bindings(req, t["artifact"], t["binding"])
    return out.withColumn("alternatives", F.when(F.size("alternatives") > 0, F.array_join("alternatives", ",")))


@query("facet_search", f"""WITH {BIND} SELECT fqn FROM artifact WHERE interface_type = 'queryable_dataset' AND lifecycle = 'certified'
  AND fqn IN (SELECT fqn FROM bnd WHERE runtime = 'databricks')""", ART)
def _(lake):
    t = registry(lake)
    return R.facet(t["artifact"], t["binding"], "queryable_dataset", "certified", "databricks").select("fqn")


@query("impact_direct", """SELECT fqn, cast(sum(o) AS bigint) AS upstream, cast(sum(i) AS bigint) AS downstream FROM (
    SELECT from_fqn AS fqn, 1 AS o, 0 AS i FROM dependency_edge UNION ALL SELECT to_fqn, 0, 1 FROM dependency_edge) GROUP BY 1""", ART)
def _(lake):
    return G.impact_direct(lake.dependency_edge)


_CLOSURE = """e AS (SELECT DISTINCT from_fqn, to_fqn FROM dependency_edge),
  walk AS (SELECT fqn AS root, fqn AS node, 0 AS depth FROM artifact WHERE lifecycle = '{state}'
    UNION SELECT root, e.from_fqn, depth + 1 FROM walk JOIN e ON e.to_fqn = walk.node)"""


@query("impact_closure", f"""WITH {_CLOSURE.format(state='certified')} SELECT root, node, cast(min(depth) AS int) AS depth FROM walk
  WHERE depth > 0 GROUP BY 1, 2""", ART, recursive=True)
def _(lake):
    return G.impact_closure(lake.dependency_edge, lake.artifact.filter("lifecycle = 'certified'"))


@query("deprecation_notices", f"""WITH {_CLOSURE.format(state='deprecated')} SELECT root AS deprecated_fqn, node AS consumer_fqn, owner AS consumer_owner,
    cast(min(depth) AS int) AS depth FROM walk JOIN artifact a ON a.fqn = node WHERE depth > 0 GROUP BY 1, 2, 3""", ART, recursive=True)
def _(lake):
    from reuselake.operators.governance import deprecation_notices

    t = registry(lake)
    return deprecation_notices(t["artifact"], t["edge"])


@query("registry_index", """SELECT fqn, interface_type AS interface, owner AS owner_team, lifecycle AS lifecycle_state FROM artifact
  WHERE lifecycle IN ('shared', 'certified', 'retired')""", ART)
def _(lake):
    return R.registry_index(registry(lake)["artifact"])


@query("local_pointers", """SELECT l.fqn, c.fqn AS certified_fqn FROM artifact l LEFT JOIN (SELECT title, min(fqn) AS fqn FROM artifact
  WHERE lifecycle = 'certified' GROUP BY 1) c ON c.title = l.title WHERE lifecycle = 'local'""", ART)
def _(lake):
    return R.local_pointers(registry(lake)["artifact"], F.col("title"))


@query("find_prefix", "SELECT fqn, title FROM artifact WHERE starts_with(fqn, 'd3.ns1.')", ART)
def _(lake):
    return R.find(registry(lake)["artifact"], prefix="d3.ns1.").select("fqn", "title")


@query("bindings_with_source", f"""WITH {BIND} SELECT b.fqn, cast(ordinal AS int) AS ordinal, physical_ref, runtime, dialect, a.lifecycle AS lifecycle_state, a.owner AS owner_team
  FROM bnd b JOIN artifact a ON a.fqn = b.fqn WHERE physical_ref IS NOT NULL""", ART)
def _(lake):
    t = registry(lake)
    return R.bindings_with_source(t["artifact"], t["binding"], source="physical_ref").select(
        "fqn", "ordinal", "physical_ref", "runtime", "dialect", "lifecycle_state", "owner_team"
    )


@query("representative_binding", """SELECT fqn, physical_ref FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY
    CASE WHEN object_type = 'macro' THEN 0 ELSE 1 END, env <> 'prod', ordinal) AS k FROM binding) WHERE k = 1""", ART)
def _(lake):
    path = F.concat("physical_ref", F.when(F.col("object_type") == "macro", ".py").otherwise(".sql"))
    b = registry(lake)["binding"].withColumn("source_path", path)
    return R.pick_binding(b, "python").select("fqn", "physical_ref")


@query("flatten_pages", """WITH n AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) AS k, contains(body, '"next_page":null') AS ends FROM landed_page),
  l AS (SELECT source, least(coalesce(min(page) FILTER (ends), max(page)), coalesce(min(k) FILTER (page <> k) - 1, max(page))) AS last FROM n GROUP BY 1),
  p AS (SELECT source, page, unnest(from_json(json_extract(body, '$.accounts'), '[{"id":"BIGINT"}]')) AS r FROM landed_page JOIN l USING (source)
    WHERE page <= last)
  SELECT source, cast(page AS int) AS page, r.id AS account_id FROM p""", "landed_page")
def _(lake):
    more = F.get_json_object("body", "$.next_page").isNotNull()
    return flatten_pages(lake.landed_page, "accounts", "struct<id: bigint>", more).select(
        "source", "page", F.col("record.id").alias("account_id")
    )

"""Queries of duplicate and re-implementation detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.functions import text as T
from reuselake.operators import compare as C
from reuselake.operators import graph as G
from reuselake.operators import similarity as S
from reuselake.plans.catalog import query
from reuselake.plans.fixtures import Lake
from reuselake.session import stored

# -- the same text rules as SQL -------------------------------------------------------------------

_BODY = r"CASE WHEN regexp_matches(text, '(?s)\$\$.*?\$\$') THEN regexp_extract(text, '(?s)\$\$(.*?)\$\$', 1) ELSE text END"
_STRIP = rf"""regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)\{{\{{.*?\}}\}}|\{{%.*?%\}}', ' ', 'g'),
    '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g')"""
NORM_SQL = rf"trim(regexp_replace(lower({_STRIP}), '[ \t\r\n\f]+', ' ', 'g'))"
_DOC = r"""regexp_replace(regexp_replace(text, '(?sm)^[ \t]*\"\"\".*?\"\"\"[ \t]*$', ' ', 'g'), '(?sm)^[ \t]*''''''.*?''''''[ \t]*$', ' ', 'g')"""
STRIP_PY = rf"""regexp_replace({_DOC}, '("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')|#[^\n]*', '\1', 'g')"""
NORM_PY = rf"trim(regexp_replace({STRIP_PY}, '[ \t\r\n\f]+', ' ', 'g'))"
DETECT = r"""CASE WHEN regexp_matches(text, '^[ \t\r\n\f]*(def |import |from |\"\"\"|#|@)') THEN 'python' ELSE 'sql' END"""
LEX = r"regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]')"
SHINGLES = """list_distinct(CASE WHEN len(toks) >= 3 THEN list_transform(range(1, len(toks) - 1), lambda i: array_to_string(toks[i:i+2], ' '))
    WHEN len(toks) > 0 THEN [array_to_string(toks, ' ')] ELSE [] END)"""


def _set(e: str) -> str:
    return f"list_sort(list_distinct({e}))"


def _found(conds: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conds.items())
    return _set(f"list_filter([{items}], lambda x: x IS NOT NULL)")


def _aggs(col: str, names) -> str:
    conds: dict[str, str] = {}
    for n in names:
        c = rf"regexp_matches({col}, '\b{n}\s*\(')"
        key = {"average": "avg", "mean": "avg"}.get(n, n)
        conds[key] = f"({conds[key]} OR {c})" if key in conds else c
    return _found(conds)


_CONCEPTS = _found({c: f"contains(lower(text), '{c}')" for c in T.CONCEPTS})
PROFILE_SQL = rf"""SELECT *, 'sql' AS plang,
    {_set(r"regexp_extract_all(lower(text), '\b(from|join)\s+([a-zA-Z_][\w\.]*)', 2)")} AS src,
    len(list_filter(regexp_extract_all(lower(text), '\b(from|join)\s+([a-zA-Z_][\w\.]*)', 1), lambda k: k = 'join')) AS joins,
    {_aggs('lower(text)', T.SQL_AGGREGATES)} AS aggs,
    {_set(r"list_filter(list_transform(flatten(list_transform(regexp_extract_all(lower(text), 'group\s+by\s+([\w\.,\s]+)', 1), lambda g: string_split(g, ','))), lambda g: regexp_extract(g, '^\s*(\S+)', 1)), lambda g: g <> '')")} AS grp,
    {_set(r"regexp_extract_all(regexp_extract(lower(text), '(?s)\bselect\b(.*?)\bfrom\b', 1), '\bas\s+([a-z_][a-z0-9_]*)', 1)")} AS outs,
    {_CONCEPTS} AS concepts"""
PROFILE_PY = rf"""SELECT *, 'python' AS plang,
    {_set("list_filter(list_transform(flatten(list_transform(list_concat(regexp_extract_all(code, '" + r"\bdef\s+\w+\s*\(([^)]*)\)', 1), regexp_extract_all(code, '\blambda\s+([^:]*):', 1)), lambda p: string_split(p, ','))), lambda p: regexp_extract(p, '^[\s\*]*([A-Za-z_]\w*)', 1)), lambda n: n <> '' AND n NOT IN ('self','start_date','end_date'))")} AS src,
    len(regexp_extract_all(code, '\.(join|merge)\s*\(', 1)) AS joins,
    {_aggs('code', T.PYTHON_AGGREGATES)} AS aggs,
    {_set(r"regexp_extract_all(array_to_string(regexp_extract_all(code, '\.(?:groupBy|groupby|agg)\s*\(([^()]*)', 1), ','), '[" + '"' + r"'']([^" + '"' + r"'']+)[" + '"' + "'']', 1)")} AS grp,
    {_set(r"regexp_extract_all(code, '\.(?:withColumn|alias|withColumnRenamed)\s*\(\s*[" + '"' + r"'']([^" + '"' + r"'']+)[" + '"' + "'']', 1)")} AS outs,
    {_CONCEPTS} AS concepts"""
_LEAF = "lower(trim(list_extract(string_split({}, '.'), -1)))"
BAG = _set(f"""list_concat(list_concat(list_concat(list_transform(src, lambda v: 'src:' || {_LEAF.format('v')}),
    list_transform(aggs, lambda v: 'agg:' || v)), list_concat(list_transform(grp, lambda v: 'grp:' || {_LEAF.format('v')}),
    list_transform(outs, lambda v: 'out:' || {_LEAF.format('v')}))), list_concat(list_transform(concepts, lambda v: 'concept:' || v),
    CASE WHEN joins > 0 THEN ['joins:' || cast(least(joins, 3) AS varchar)] ELSE [] END))""")
PROFILES = f"""feat AS (SELECT *, {BAG} AS bag FROM (
    {PROFILE_SQL} FROM (SELECT id, text, '' AS code FROM sql_snippet)
    UNION ALL {PROFILE_PY} FROM (SELECT id, text, {STRIP_PY} AS code FROM py_snippet)))"""
CODE = "sql_snippet py_snippet"

_JOINED = ("source_entities", "aggregations", "group_by", "output_columns", "concepts")


def _flat(df: DataFrame, *keep: str) -> DataFrame:
    p = "profile"
    return df.select(
        *keep, *[F.array_join(f"{p}.{f}", ",").alias(f) for f in _JOINED], F.col(f"{p}.joins").alias("joins")
    )


_FLAT_SQL = """array_to_string(src, ',') AS source_entities, array_to_string(aggs, ',') AS aggregations, array_to_string(grp, ',') AS group_by,
    array_to_string(outs, ',') AS output_columns, array_to_string(concepts, ',') AS concepts, cast(joins AS int) AS joins"""


@query("detect_language", f"SELECT id, {DETECT} AS language FROM code_snippet", "code_snippet")
def _(lake):
    return lake.code_snippet.select("id", T.detect_lang(F.col("text")).alias("language"))


@query("normalize_sql", f"SELECT id, {NORM_SQL} AS normalized FROM sql_snippet", "sql_snippet")
def _(lake):
    return lake.sql_snippet.select("id", T.normalize_sql(F.col("text")).alias("normalized"))


@query("normalize_py", f"SELECT id, {NORM_PY} AS normalized FROM py_snippet", "py_snippet")
def _(lake):
    return lake.py_snippet.select("id", T.normalize_py(F.col("text")).alias("normalized"))


@query("token_counts", f"""SELECT id, cast(len({LEX.format(NORM_SQL)}) AS int) AS lex,
    cast(len(list_filter(string_split({NORM_SQL}, ' '), lambda t: t <> '')) AS int) AS ws FROM sql_snippet""", "sql_snippet")
def _(lake):
    norm = T.normalize_sql(F.col("text"))
    return lake.sql_snippet.select(
        "id", F.size(T.tokens(norm, "lex")).alias("lex"), F.size(T.tokens(norm, "ws")).alias("ws")
    )


_FP = f"fp AS (SELECT id, language, dialect, sha256(array_to_string({LEX.format(NORM_SQL)}, ' ')) AS fingerprint FROM sql_snippet)"


@query("fingerprint_groups", f"""WITH {_FP} SELECT * FROM (SELECT id, language, dialect, fingerprint,
    min(id) OVER w AS first_id, count(*) OVER w AS members FROM fp WINDOW w AS (PARTITION BY language, dialect, fingerprint))
  WHERE members > 1""", "sql_snippet")
def _(lake):
    return S.exact_duplicates(T.featurize(lake.sql_snippet))


@query("profile_sql", f"WITH {PROFILES} SELECT id, {_FLAT_SQL} FROM feat WHERE plang = 'sql'", CODE)
def _(lake):
    return _flat(T.featurize(lake.sql_snippet), "id")


@query("profile_py", f"WITH {PROFILES} SELECT id, {_FLAT_SQL} FROM feat WHERE plang = 'python'", CODE)
def _(lake):
    return _flat(T.featurize(lake.py_snippet), "id")


@query("feature_bag", f"WITH {PROFILES} SELECT id, array_to_string(bag, ',') AS bag FROM feat", CODE)
def _(lake):
    return T.featurize(lake.code_snippet).select("id", F.array_join("bag", ",").alias("bag"))


_LEAVES = "array_to_string(list_sort(list_transform({}, lambda v: " + _LEAF.format("v") + ")), ', ')"


@query("profile_document", f"""WITH {PROFILES} SELECT id, trim(concat_ws('. ', 'transformation in ' || plang,
    'reads ' || {_LEAVES.format('src')}, CASE WHEN joins > 0 THEN 'joins ' || cast(joins AS varchar) || ' sources' ELSE 'no joins' END,
    CASE WHEN len(aggs) > 0 THEN 'aggregates ' || array_to_string(aggs, ', ') END,
    CASE WHEN len(grp) > 0 THEN 'grouped by ' || {_LEAVES.format('grp')} END,
    CASE WHEN len(outs) > 0 THEN 'outputs ' || {_LEAVES.format('outs')} END,
    CASE WHEN len(concepts) > 0 THEN 'business concepts ' || array_to_string(concepts, ', ') END)) AS document FROM feat""", CODE)
def _(lake):
    return T.featurize(lake.code_snippet).select("id", T.profile_document(F.col("profile")).alias("document"))


_BAGS = f"""{PROFILES}, l AS (SELECT DISTINCT bag FROM feat), r AS (SELECT DISTINCT bag FROM feat JOIN candidate c ON c.id = feat.id),
  p AS (SELECT l.bag AS lb, r.bag AS rb, len(list_intersect(l.bag, r.bag)) AS o FROM l, r)"""
_PAIR_J = "o / (len(lb) + len(rb) - o)"


def _bag_pairs(lake: Lake) -> DataFrame:
    bags = T.featurize(lake.code_snippet).select("bag").distinct().withColumn("id", F.array_join("bag", ","))
    cand = T.featurize(lake.candidate).select("bag").distinct().withColumn("id", F.array_join("bag", ","))
    return S.similar_pairs(stored(bags, "bags"), stored(cand, "bags"), (1, 2), elements="bag")


@query("feature_jaccard", f"""WITH {_BAGS} SELECT array_to_string(lb, ',') AS query_bag, array_to_string(rb, ',') AS candidate_bag,
    cast(o AS int) AS shared, round({_PAIR_J}, 4) AS feature FROM p WHERE {_PAIR_J} >= 0.5""", f"{CODE} candidate")
def _(lake):
    return _bag_pairs(lake).select(
        F.col("left_id").alias("query_bag"), F.col("right_id").alias("candidate_bag"), F.col("overlap").alias("shared"),
        S.jaccard().alias("feature"),
    )


def _kind_sql(*kinds: str) -> str:
    test = " OR ".join(f"starts_with(v, '{k}:')" for k in kinds)
    return f"array_to_string(list_sort(list_transform(list_filter(list_intersect(lb, rb), lambda v: {test}), lambda v: v[strpos(v, ':') + 1:])), ',')"


@query("structural_pairs", f"""WITH s AS (SELECT id, {LEX.format(NORM_SQL)} AS toks FROM sql_snippet),
  q AS (SELECT DISTINCT {SHINGLES} AS sh, sha256(array_to_string(toks, ' ')) AS fp FROM s),
  c AS (SELECT DISTINCT {SHINGLES} AS sh, sha256(array_to_string(toks, ' ')) AS fp FROM s WHERE id IN (SELECT id FROM candidate)),
  p AS (SELECT q.fp AS query_fp, c.fp AS candidate_fp, q.sh AS lb, c.sh AS rb, len(list_intersect(q.sh, c.sh)) AS o FROM q, c)
  SELECT query_fp, candidate_fp, cast(o AS int) AS shared, round({_PAIR_J}, 4) AS structural FROM p
  WHERE 5 * o >= 3 * (len(lb) + len(rb) - o)""", "sql_snippet candidate")
def _(lake):
    def sets(df):
        one = T.featurize(df).groupBy("language", "fingerprint").agg(F.any_value("tokens").alias("t"))
        return stored(one.select(
            "language", F.col("fingerprint").alias("id"), T.shingles(F.col("t")).alias("elements")
        ), "shingles")

    return S.similar_pairs(sets(lake.sql_snippet), sets(lake.candidate), (3, 5), by=["language"]).select(
        F.col("left_id").alias("query_fp"), F.col("right_id").alias("candidate_fp"), F.col("overlap").alias("shared"),
        S.jaccard().alias("structural"),
    )


_PROSE = r"regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query("structural_pairs_prose", f"""WITH d AS (SELECT doc_id, {SHINGLES} AS sh FROM (SELECT doc_id, {_PROSE} AS toks FROM documents)),
  b AS (SELECT item_id, {SHINGLES} AS sh FROM (SELECT item_id, {_PROSE} AS toks FROM benchmark)),
  p AS (SELECT doc_id, item_id, d.sh AS lb, b.sh AS rb, len(list_intersect(d.sh, b.sh)) AS o FROM d, b)
  SELECT doc_id, item_id, cast(o AS int) AS shared, round({_PAIR_J}, 4) AS structural FROM p
  WHERE o > 0 AND 20 * o >= len(lb) + len(rb) - o""")
def _(lake):
    def sets(df, id):
        toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
        return df.select(F.col(id).alias("id"), T.shingles(toks).alias("elements"))

    return S.similar_rows(sets(lake.documents, "doc_id"), sets(lake.benchmark, "item_id"), (1, 20)).select(
        F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), F.col("overlap").alias("shared"),
        S.jaccard().alias("structural"),
    )


# -- comparison -----------------------------------------------------------------------------------


def _candidates(lake: Lake) -> DataFrame:
    """Registered candidates with their governance and first binding."""
    first = lake.binding.groupBy("fqn").agg(F.min_by("physical_ref", "ordinal").alias("binding_ref"))
    return lake.candidate.withColumnRenamed("id", "ord").join(first, "fqn").select(
        F.col("fqn").alias("logical_id"), "text", "title", "lifecycle", "owner", "reuse_intent", "binding_ref"
    )


_LABEL = """CASE WHEN NOT same THEN 'VALID_ALTERNATE_BINDING' WHEN ast >= 0.85 THEN 'DIRECT_MATCH' WHEN ast >= 0.62 THEN 'STRUCTURAL_SIMILARITY'
    WHEN feature >= 0.30 THEN 'PARTIAL_REIMPLEMENTATION' ELSE 'INSUFFICIENT_EVIDENCE' END"""
_ACTION = "CASE relationship " + " ".join(
    f"WHEN '{k}' THEN '{a}' || tag || '{b}'" for k, (a, b) in C.ACTIONS.items()
) + f" ELSE '{C.INSUFFICIENT_ACTION}' END"
COMPARE = f"""{PROFILES}, tk AS (SELECT *, {LEX.format("CASE WHEN plang = 'sql' THEN norm_s ELSE norm_p END")} AS toks
    FROM (SELECT *, {NORM_SQL} AS norm_s, {NORM_PY} AS norm_p FROM feat)),
  sh AS (SELECT id, plang, bag, {SHINGLES} AS sh FROM tk),
  q AS (SELECT plang, bag, sh, list(id) AS ids FROM sh GROUP BY ALL),
  cc AS (SELECT c.fqn, c.lifecycle, s.plang, s.bag, s.sh FROM candidate c JOIN sh s ON s.id = c.id),
  cu AS (SELECT plang, bag, sh, row_number() OVER () AS cid FROM cc GROUP BY ALL),
  pr AS (SELECT q.ids, cu.cid, q.plang = cu.plang AS same, CASE WHEN q.plang = cu.plang THEN len(list_intersect(q.sh, cu.sh)) /
      (len(q.sh) + len(cu.sh) - len(list_intersect(q.sh, cu.sh))) END AS ast,
    round(len(list_intersect(q.bag, cu.bag)) / (len(q.bag) + len(cu.bag) - len(list_intersect(q.bag, cu.bag))), 4) AS feature FROM q, cu),
  sc AS (SELECT *, CASE WHEN ast IS NOT NULL THEN round(0.8 * ast + 0.2 * feature, 4) ELSE round(feature, 4) END AS combined FROM pr),
  al AS (SELECT ids, fqn AS logical_id, lifecycle, ast, feature, combined, same,
    row_number() OVER (PARTITION BY ids ORDER BY combined DESC, fqn) AS rank
    FROM sc JOIN cu USING (cid) JOIN cc ON cc.plang = cu.plang AND cc.bag = cu.bag AND cc.sh = cu.sh),
  top AS (SELECT unnest(ids) AS id, * EXCLUDE (ids), {_LABEL} AS relationship, ' (' || lifecycle || ')' AS tag FROM al WHERE rank <= 5)"""


def _compare(lake: Lake, **kw) -> DataFrame:
    return C.compare(lake.code_snippet, _candidates(lake), mode="lex", **kw)


_COLS = ["id", "rank", "logical_id", "lifecycle", "feature", "combined", "relationship", "recommended_action"]


@query("compare_top5", f"""WITH {COMPARE} SELECT id, cast(rank AS int) AS rank, logical_id, lifecycle, round(ast, 4) AS ast, feature, combined,
    relationship, {_ACTION} AS recommended_action FROM top""", f"{CODE} candidate")
def _(lake):
    return _compare(lake).select(*_COLS, F.round("ast", 4).alias("ast"))


@query("compare_summary", f"""WITH {COMPARE} SELECT id, max(CASE WHEN rank = 1 THEN logical_id END) AS closest,
    max(CASE WHEN rank = 1 THEN combined END) AS closest_score, count(*) AS matches,
    CASE WHEN bool_or(ast IS NOT NULL) THEN 'ast' ELSE 'feature' END AS method,
    max(CASE WHEN rank = 1 THEN CASE WHEN combined < 0.30 THEN '{C.SAFE_SUMMARY}'
      ELSE 'Closest match: ' || logical_id || ' [' || relationship || '] — ' || {_ACTION} END END) AS summary
  FROM top GROUP BY id""", f"{CODE} candidate")
def _(lake):
    return C.summarize(lake.code_snippet, _compare(lake))


@query("compare_evidence", f"""WITH {COMPARE}, e AS (SELECT t.id, t.rank, a.bag AS lb, b.bag AS rb FROM top t
    JOIN feat a ON a.id = t.id JOIN candidate c ON c.fqn = t.logical_id JOIN feat b ON b.id = c.id)
  SELECT id, cast(rank AS int) AS rank, {_kind_sql('src')} AS shared_sources, {_kind_sql('agg', 'grp', 'joins')} AS shared_operations,
    {_kind_sql('concept')} AS shared_concepts FROM e""", f"{CODE} candidate")
def _(lake):
    m = _compare(lake)
    return m.select("id", "rank", *[
        F.array_join(c, ",").alias(c) for c in ("shared_sources", "shared_operations", "shared_concepts")
    ])


@query("compare_workspace", f"""WITH {COMPARE} SELECT id, cast(rank AS int) AS rank, logical_id, 'UNKNOWN' AS lifecycle, 'UNKNOWN' AS owner,
    'CURRENT_WORKSPACE_ONLY' AS coverage, combined, CASE WHEN same THEN relationship WHEN feature >= 0.55 THEN 'POSSIBLE_DOMAIN_VARIANT'
      WHEN feature >= 0.30 THEN 'PARTIAL_REIMPLEMENTATION' ELSE 'INSUFFICIENT_EVIDENCE' END AS relationship,
    '{C.UNREGISTERED_ACTION}' AS recommended_action, 6 AS warnings FROM top""", f"{CODE} candidate")
def _(lake):
    m = _compare(lake, scope="workspace")
    return m.select(
        "id", "rank", "logical_id", "lifecycle", "owner", "coverage", "combined", "relationship", "recommended_action",
        F.size("warnings").alias("warnings"),
    )


@query("compare_at_floor", f"""WITH {COMPARE} SELECT id, cast(rank AS int) AS rank, logical_id, combined FROM top WHERE combined >= 0.5""",
       f"{CODE} candidate")
def _(lake):
    return _compare(lake, min_combined=(1, 2)).select("id", "rank", "logical_id", "combined")


_VECTORS = """vs AS (SELECT document, (SELECT e.embedding FROM embeddings e WHERE e.vec_id = d.vec_id) AS v FROM (
      SELECT document, cast('0x' || substr(md5(document), 1, 6) AS bigint) % (SELECT count(*) FROM embeddings) AS vec_id FROM docs GROUP BY ALL) d)"""
_DOCUMENT = f"""trim(concat_ws('. ', 'transformation in ' || plang,
    'reads ' || {_LEAVES.format('src')}, CASE WHEN joins > 0 THEN 'joins ' || cast(joins AS varchar) || ' sources' ELSE 'no joins' END,
    CASE WHEN len(aggs) > 0 THEN 'aggregates ' || array_to_string(aggs, ', ') END,
    CASE WHEN len(grp) > 0 THEN 'grouped by ' || {_LEAVES.format('grp')} END,
    CASE WHEN len(outs) > 0 THEN 'outputs ' || {_LEAVES.format('outs')} END,
    CASE WHEN len(concepts) > 0 THEN 'business concepts ' || array_to_string(concepts, ', ') END))"""


def _with_vectors(k: int) -> str:
    return f"""WITH {PROFILES}, docs AS (SELECT id, {_DOCUMENT} AS document FROM feat), {_VECTORS},
  tk AS (SELECT *, {LEX.format("CASE WHEN plang = 'sql' THEN norm_s ELSE norm_p END")} AS toks
    FROM (SELECT *, {NORM_SQL} AS norm_s, {NORM_PY} AS norm_p FROM feat)),
  sh AS (SELECT id, plang, bag, {SHINGLES} AS sh, document FROM tk JOIN docs USING (id)),
  q AS (SELECT plang, bag, sh, document, list(id) AS ids FROM sh GROUP BY ALL),
  cc AS (SELECT c.fqn, s.plang, s.bag, s.sh, s.document FROM candidate c JOIN sh s ON s.id = c.id),
  cu AS (SELECT plang, bag, sh, document, row_number() OVER () AS cid FROM cc GROUP BY ALL),
  pr AS (SELECT q.ids, cu.cid, q.plang = cu.plang AS same, CASE WHEN q.plang = cu.plang THEN len(list_intersect(q.sh, cu.sh)) /
      (len(q.sh) + len(cu.sh) - len(list_intersect(q.sh, cu.sh))) END AS ast,
    round(len(list_intersect(q.bag, cu.bag)) / (len(q.bag) + len(cu.bag) - len(list_intersect(q.bag, cu.bag))), 4) AS feature,
    round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 4) AS embedding
    FROM q, cu, vs a, vs b WHERE a.document = q.document AND b.document = cu.document),
  sc AS (SELECT *, greatest(feature, embedding, 0.0) AS n FROM pr),
  al AS (SELECT ids, fqn AS logical_id, embedding, round(CASE WHEN ast IS NOT NULL THEN 0.8 * ast + 0.2 * n ELSE n END, 4) AS combined
    FROM sc JOIN cu USING (cid) JOIN cc ON cc.plang = cu.plang AND cc.bag = cu.bag AND cc.sh = cu.sh AND cc.document = cu.document)
  SELECT id, rank, logical_id, embedding, combined FROM (SELECT unnest(ids) AS id, cast(row_number() OVER (PARTITION BY ids ORDER BY combined DESC, logical_id) AS int) AS rank,
    logical_id, embedding, combined FROM al) WHERE rank <= {k}"""


def _vectors(lake: Lake) -> DataFrame:
    """A stand-in vector for every profile document, chosen by its hash."""
    docs = T.featurize(lake.code_snippet).select(T.profile_document(F.col("profile")).alias("document")).distinct()
    docs = stored(docs, "documents")  # else the join's null test runs the text rules once more, in the tasks that read
    n = F.lit(lake.embeddings.count())
    at = F.conv(F.substring(F.md5("document"), 1, 6), 16, 10).cast("long") % n
    return docs.withColumn("vec_id", at).join(lake.embeddings, "vec_id").select("document", "embedding")


@query("compare_with_vectors", _with_vectors(5), f"{CODE} candidate")
def _(lake):
    return _compare(lake, vectors=_vectors(lake)).select("id", "rank", "logical_id", "embedding", "combined")


@query("compare_with_vectors_top1", _with_vectors(1), f"{CODE} candidate")
def _(lake):
    return _compare(lake, vectors=_vectors(lake), k=1).select("id", "rank", "logical_id", "embedding", "combined")


@query("compare_payload", f"""WITH {COMPARE} SELECT id, cast(rank AS int) AS rank, logical_id, relationship, combined FROM top WHERE combined >= 0.5""",
       f"{CODE} candidate")
def _(lake):
    from reuselake.sources.sinks import to_payload

    rows = to_payload(_compare(lake, min_combined=(1, 2)))
    read = F.from_json("payload", "id bigint, rank int, logical_id string, relationship string, combined double")
    return rows.select(read.alias("p")).select("p.*")


def _near_sql(num: int, den: int) -> str:
    return f"""WITH d AS (SELECT doc_id, list_sort({SHINGLES}) AS sh FROM (SELECT doc_id, {_PROSE} AS toks FROM documents)),
  g AS (SELECT *, min(doc_id) OVER (PARTITION BY sh) AS first FROM d WHERE len(sh) > 0), u AS (SELECT first AS id, any_value(sh) AS sh FROM g GROUP BY 1),
  e AS (SELECT id, len(sh) AS n, unnest(sh) AS x FROM u),
  o AS (SELECT a.id AS l, b.id AS r, a.n AS ln, b.n AS rn, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
  SELECT l AS left_id, r AS right_id, round(o / (ln + rn - o), 4) AS score FROM o WHERE {den} * o >= {num} * (ln + rn - o)
  UNION ALL SELECT first, doc_id, cast(1 AS double) FROM g WHERE doc_id <> first"""


def _prose_shingles(lake: Lake) -> DataFrame:
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    return T.dealt(lake.documents.select("doc_id", "text")).select("doc_id", T.shingles(toks).alias("elements"))


@query("near_duplicates_lsh", _near_sql(4, 5))
def _(lake):
    return S.near_duplicates_lsh(_prose_shingles(lake), id="doc_id").select("left_id", "right_id", S.jaccard().alias("score"))


@query("near_duplicates_half", _near_sql(1, 2))
def _(lake):
    found = S.near_duplicates_lsh(_prose_shingles(lake), id="doc_id", threshold=(1, 2))
    return found.select("left_id", "right_id", S.jaccard().alias("score"))


@query("near_duplicates_recall", None)
def _(lake):
    """Recall of the bands against the exact join, at both thresholds."""
    sets = stored(_prose_shingles(lake), "shingles")
    at = lambda num, den: S.near_duplicates_recall(sets, "doc_id", threshold=(num, den)).withColumn("threshold", F.lit(num / den))
    return at(4, 5).unionByName(at(1, 2))


# -- vectors, duplicates, clusters ----------------------------------------------------------------

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4)"


@query("embedding_top5", f"""SELECT query_id, candidate_id, cosine, cast(rank AS int) AS rank, flagged FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, candidate_id) AS rank, cosine >= 0.88 AS flagged FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
  WHERE rank <= 5""")
def _(lake):
    rows = lake.embeddings
    return S.embedding_topk(rows, rows, 5, threshold=0.88)


# a revision of each vector, between it and the next vector: close to its original, so that there is something to flag
_REVISED = """rev AS (SELECT vec_id, embedding FROM embeddings UNION ALL
    SELECT -1 - a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE * 3 + p[2]::DOUBLE)::FLOAT)
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _revised(lake: Lake) -> DataFrame:
    following = lake.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    mixed = F.zip_with("embedding", "_next", lambda x, y: (x.cast("double") * 3 + y.cast("double")).cast("float"))
    more = lake.embeddings.join(following, "vec_id").select((-1 - F.col("vec_id")).alias("vec_id"), mixed.alias("embedding"))
    return stored(lake.embeddings.select("vec_id", "embedding").unionByName(more), "revised-vectors")


@query("embedding_flags", f"""WITH {_REVISED} SELECT a, b, score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS score
    FROM rev a JOIN rev b ON a.vec_id < b.vec_id) WHERE score >= 0.88""")
def _(lake):
    rows = _revised(lake)
    return S.embedding_pairs(rows, rows, 0.88)


@query("embedding_close_pairs", f"""SELECT a, b, score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE score >= 0.4""")
def _(lake):
    rows = lake.embeddings
    return S.embedding_pairs(rows, rows, 0.4)


@query("embedding_work", None)
def _(lake):
    """How many block pairs the two vector joins multiply, and the share that the triangle inequality skips."""
    rows, revised = lake.embeddings, _revised(lake)
    top = S.topk_work(rows, rows, 5).withColumn("join", F.lit("top 5"))
    return top.unionByName(S.pairs_work(revised, revised, 0.88).withColumn("join", F.lit("pairs at 0.88")))


def _duplicates(lake: Lake) -> dict[str, DataFrame]:
    """Copies point at the first member of their group; distinct contents at similar ones."""
    feats = stored(T.featurize(lake.sql_snippet).select("id", "language", "dialect", "fingerprint", "tokens"), "features")
    exact = S.exact_duplicates(feats).filter("id <> first_id").select(
        F.col("first_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")
    )
    one = feats.groupBy("language", "fingerprint").agg(F.min("id").alias("id"), F.any_value("tokens").alias("t")).select(
        "language", "id", T.shingles(F.col("t")).alias("elements")
    )
    one = stored(one, "shingles")
    near = S.similar_pairs(one, one, (9, 10), by=["language"]).filter("left_id < right_id").select(
        F.col("left_id").alias("a"), F.col("right_id").alias("b"), S.jaccard().alias("score")
    )
    return {"exact": exact, "structural": near}


_DUP = f"""s AS (SELECT id, language, dialect, {LEX.format(NORM_SQL)} AS toks FROM sql_snippet),
  ex AS (SELECT min(id) OVER (PARTITION BY language, dialect, toks) AS a, id AS b FROM s),
  o AS (SELECT min(id) AS id, toks, {SHINGLES} AS sh FROM s GROUP BY toks),
  nr AS (SELECT l.id AS a, r.id AS b, len(list_intersect(l.sh, r.sh)) AS o, l.sh AS lb, r.sh AS rb FROM o l JOIN o r ON l.id < r.id),
  dup AS (SELECT a, b, 'exact' AS method, cast(1 AS double) AS score FROM ex WHERE a <> b
    UNION ALL SELECT a, b, 'structural', round({_PAIR_J}, 4) FROM nr WHERE 10 * o >= 9 * (len(lb) + len(rb) - o))"""


@query("duplication_candidates", f"WITH {_DUP} SELECT *, 'open' AS status FROM dup", "sql_snippet")
def _(lake):
    return S.duplication_candidates(_duplicates(lake))


@query("clusters", f"""WITH {_DUP}, e AS (SELECT a, b FROM dup UNION SELECT b, a FROM dup),
  r AS (SELECT a AS node, a AS label FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.label)
  SELECT node, min(label) AS cluster FROM r GROUP BY node""", "sql_snippet", recursive=True)
def _(lake):
    return G.connected_components(S.duplication_candidates(_duplicates(lake)))


@query("clusters_per_layer", f"""WITH {_DUP}, e AS (SELECT a, b FROM dup UNION SELECT b, a FROM dup),
  r AS (SELECT a AS node, a AS label FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.label),
  c AS (SELECT node, min(label) AS cluster FROM r GROUP BY node)
  SELECT interface_type, count(DISTINCT cluster) AS clusters, count(*) AS members FROM c JOIN artifact a ON a.ord = c.node GROUP BY 1""",
       "sql_snippet artifact", recursive=True)
def _(lake):
    c = G.connected_components(S.duplication_candidates(_duplicates(lake)))
    layer = lake.artifact.select(F.col("ord").alias("node"), "interface_type")
    return c.join(layer, "node").groupBy("interface_type").agg(
        F.count_distinct("cluster").alias("clusters"), F.count("*").alias("members")
    )


@query("schema_duplicates", """WITH w AS (SELECT p_size AS dataset, lower(p_type) AS column_name, CASE WHEN p_size % 3 = 0 THEN 'string' ELSE 'date' END AS type FROM part),
  s AS (SELECT 'ds' || dataset AS dataset, sha256(array_to_string(list_sort(list_distinct(list(column_name || ' ' || type))), ',')) AS shape FROM w GROUP BY 1)
  SELECT * FROM (SELECT dataset, min(dataset) OVER (PARTITION BY shape) AS first_dataset, count(*) OVER (PARTITION BY shape) AS members, shape FROM s)
  WHERE members > 1""")
def _(lake):
    contract = lake.part.select(
        F.concat(F.lit("ds"), F.col("p_size").cast("string")).alias("dataset"), F.lower("p_type").alias("column_name"),
        F.when(F.col("p_size") % 3 == 0, "string").otherwise("date").alias("type"),
    )
    return S.schema_duplicates(contract)


@query("metric_duplicates", """WITH f AS (SELECT 'm' || p_partkey AS metric, unnest(['agg', 'expr', 'grain']) AS field,
    unnest([CASE WHEN p_size % 2 = 0 THEN 'sum' ELSE ' sum ' END, lower(p_type), cast(p_size % 4 AS varchar)]) AS value FROM part),
  s AS (SELECT metric, sha256(array_to_string(list_sort(list(field || '=' || trim(value))), ',')) AS definition FROM f GROUP BY 1)
  SELECT * FROM (SELECT metric, min(metric) OVER (PARTITION BY definition) AS first_metric, count(*) OVER (PARTITION BY definition) AS members, definition FROM s)
  WHERE members > 1""")
def _(lake):
    fields = lake.part.select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("metric"),
        F.explode(F.create_map(
            F.lit("agg"), F.when(F.col("p_size") % 2 == 0, "sum").otherwise(" sum "), F.lit("expr"), F.lower("p_type"),
            F.lit("grain"), (F.col("p_size") % 4).cast("string"),
        )).alias("field", "value"),
    )
    return S.metric_duplicates(fields)

"""Compare code with candidates: scores, labels, advice and a summary per snippet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reuselake.functions import text as T
from reuselake.operators.similarity import candidate_pairs, embedding_topk
from reuselake.operators.skew import salted_join
from reuselake.session import stored

UNKNOWN = "UNKNOWN"
REGISTERED = "REGISTERED_CANONICAL"
LANGUAGES = ("sql", "python")

# fixed values: labels, coverage names and texts of the comparison result
DIRECT_MATCH = "DIRECT_MATCH"
STRUCTURAL_SIMILARITY = "STRUCTURAL_SIMILARITY"
PARTIAL_REIMPLEMENTATION = "PARTIAL_REIMPLEMENTATION"
VALID_ALTERNATE_BINDING = "VALID_ALTERNATE_BINDING"
POSSIBLE_DOMAIN_VARIANT = "POSSIBLE_DOMAIN_VARIANT"
INSUFFICIENT_EVIDENCE = "INSUFFICIENT_EVIDENCE"
COVERAGE = {"registry": "REGISTERED_ARTIFACTS", "workspace": "CURRENT_WORKSPACE_ONLY"}
WORKSPACE_WARNINGS = (
    "Warehouse objects (UDFs, tables, views) were not searched.",
    "Semantic-layer / metric runtimes were not searched.",
    "Repositories not checked out into this workspace were not searched.",
    "Package versions not installed locally were not searched.",
    "No governance signal: lifecycle, ownership and reuse intent are UNKNOWN.",
)
NO_VECTORS_WARNING = "No embeddings were given; the feature profiles stand in for them."
UNREGISTERED_ACTION = (
    "Workspace-only match with no governance signal. Verify against the registry "
    "before assuming this is canonical."
)
ACTIONS = {  # text before and after the lifecycle tag
    DIRECT_MATCH: ("Reuse the registered artifact", " instead of re-implementing it."),
    STRUCTURAL_SIMILARITY: (
        "Structurally very close to the registered artifact",
        "; review and reuse it rather than maintaining a copy.",
    ),
    PARTIAL_REIMPLEMENTATION: (
        "Overlaps a registered artifact", "; reuse the shared parts rather than copying logic.",
    ),
    VALID_ALTERNATE_BINDING: (
        "This is a valid runtime binding of a registered artifact", "; resolve the binding for your runtime.",
    ),
    POSSIBLE_DOMAIN_VARIANT: (
        "May be a domain variant of a registered artifact", "; confirm intent before diverging.",
    ),
}
INSUFFICIENT_ACTION = "No strong match; safe to author, but register the new artifact."
NO_CANDIDATES_SUMMARY = "No candidates were available to compare against."
SAFE_SUMMARY = "No strong match found. Safe to author, but register the new artifact."
SAFE_BELOW = 0.30


@dataclass(frozen=True)
class Thresholds:
    direct: float = 0.85
    structural: float = 0.62
    strong_feature: float = 0.55
    weak_feature: float = 0.30


def neutral(feature: Column, embedding: Column) -> Column:
    return F.greatest(F.coalesce(feature, F.lit(0.0)), F.coalesce(embedding, F.lit(0.0)), F.lit(0.0))


def combined(ast: Column, feature: Column, embedding: Column) -> Column:
    """Structure leads where both sides share a language; otherwise the neutral signal alone."""
    n = neutral(feature, embedding)
    return F.round(F.when(ast.isNotNull(), 0.8 * ast + 0.2 * n).otherwise(n), 4)


def classify(
    ast: Column, feature: Column, embedding: Column, same_language: Column, bound: Column, t: Thresholds = Thresholds()
) -> Column:
    """Relationship label. ``bound`` marks registered candidates with a binding."""
    n = neutral(feature, embedding)
    return (
        F.when(~same_language & bound, VALID_ALTERNATE_BINDING)
        .when(same_language & (ast >= t.direct), DIRECT_MATCH)
        .when(same_language & (ast >= t.structural), STRUCTURAL_SIMILARITY)
        .when(~same_language & (n >= t.strong_feature), POSSIBLE_DOMAIN_VARIANT)
        .when(n >= t.weak_feature, PARTIAL_REIMPLEMENTATION)
        .otherwise(INSUFFICIENT_EVIDENCE)
    )


def action(label: Column, registered: Column, lifecycle: Column) -> Column:
    tag = F.when(F.coalesce(lifecycle, F.lit("")) != "", F.concat(F.lit(" ("), lifecycle, F.lit(")"))).otherwise("")
    out = F.when(~registered, UNREGISTERED_ACTION)
    for name, (before, after) in ACTIONS.items():
        out = out.when(label == name, F.concat(F.lit(before), tag, F.lit(after)))
    return out.otherwise(INSUFFICIENT_ACTION)


def _contents(df: DataFrame, id: str, mode: str) -> DataFrame:
    """Rows with a key for everything a score depends on, so that copies are scored once."""
    doc = T.profile_document(F.col("profile"))
    rows = (
        T.featurize(df, mode=mode)
        .withColumn("document", doc)
        .withColumn("content", F.concat("language", F.lit(":"), F.sha2(
            F.concat_ws("|", "fingerprint", F.array_join("bag", ","), "document"), 256)))
        .select(F.col(id).alias("_id"), "content", "language", "tokens", "bag", "document")
    )
    return stored(rows, "features")


def _distinct_contents(rows: DataFrame, vectors: DataFrame | None, extra=()) -> DataFrame:
    cols = ("language", "tokens", "bag", "document")
    one = rows.groupBy("content").agg(*[F.any_value(c).alias(c) for c in cols], *extra)
    one = one.withColumn("shingles", T.shingles(F.col("tokens"))).drop("tokens")
    one = one.withColumn("_v", F.lit(None).cast("array<double>")) if vectors is None else one.join(vectors, "document", "left")
    return stored(one, "contents")


#: Score floors of the search for the best, in ten-thousandths (scores have four decimals). The last one is every score above zero.
FLOORS = (5000, 2000, 500, 1)


def _reaching(q: DataFrame, c: DataFrame, floor: int) -> DataFrame:
    """Pairs that hold every one with a structural or feature score of ``floor`` ten-thousandths, also if only by rounding.

    A combined score is a mean of the two, so it cannot be above the larger one.
    """
    least = (2 * floor - 1, 20_000)
    return candidate_pairs(q, c, least, "content", "shingles", ["language"]).unionByName(candidate_pairs(q, c, least, "content", "bag")).distinct()


def _nearest(q: DataFrame, c: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Candidates by cosine alone (``vectors``: document, _v): a pair that shares nothing else ranks by its cosine within a language.

    Contents with one profile document share a vector, so documents are compared, and of a document's contents the first ``k`` count.
    """
    documents = q.select("document").unionByName(c.select("document")).distinct().join(vectors.select("document", F.col("_v").alias("_x")), "document")
    numbered = stored(documents.withColumn("_n", F.monotonically_increasing_id()), "document-vectors")
    qv = q.select("document").distinct().join(numbered, "document")
    best = None
    for lang in LANGUAGES:
        own = c.filter(F.col("language") == lang)
        cv = own.select("document").distinct().join(numbered, "document")
        few = own.withColumn("_m", F.row_number().over(Window.partitionBy("document").orderBy("first_logical"))).filter(F.col("_m") <= k)
        top = embedding_topk(qv.select("_n", "_x"), cv.select("_n", "_x"), k, "_n", "_x", skip_self=False)
        name = lambda n, d: numbered.select(F.col("_n").alias(n), F.col("document").alias(d))
        met = (
            top.join(name("query_id", "_qd"), "query_id").join(name("candidate_id", "_cd"), "candidate_id")
            .join(q.select(F.col("content").alias("left_id"), F.col("document").alias("_qd")), "_qd")
            .join(few.select(F.col("content").alias("right_id"), F.col("document").alias("_cd")), "_cd")
            .select("left_id", "right_id")
        )
        best = met if best is None else best.unionByName(met)
    return best


def _scored(pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs with all their scores, shared features and the candidate's first logical id."""
    side = lambda df, key, p: df.select(F.col("content").alias(key), F.col("bag").alias(f"{p}b"), F.col("shingles").alias(f"{p}s"), F.col("_v").alias(f"{p}v"))
    right = side(c, "right_id", "_r").join(c.select(F.col("content").alias("right_id"), "first_logical", "_rows"), "right_id")
    both = salted_join(pairs.join(side(q, "left_id", "_l"), "left_id"), right, "right_id", "left_id")
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return (
        both.withColumn("_same", F.substring_index("left_id", ":", 1) == F.substring_index("right_id", ":", 1))
        .withColumn("ast", F.when(F.col("_same"), share("_ls", "_rs")))
        .withColumn("feature", F.round(share("_lb", "_rb"), 4))
        .withColumn("embedding", _cosine("_lv", "_rv"))
        .withColumn("combined", combined(F.col("ast"), F.col("feature"), F.col("embedding")))
        .withColumn("_shared", F.array_sort(F.array_intersect("_lb", "_rb")))
        .select("left_id", "right_id", "ast", "feature", "embedding", "combined", "_same", "_shared", "first_logical", "_rows")
    )


def best_pairs(q: DataFrame, c: DataFrame, near: DataFrame | None, k: int, least: int) -> DataFrame:
    """The best candidate contents of each query content, ``k`` at least unless fewer score ``least`` ten-thousandths.

    Exact top k without joining all that share something: floors go down from 1/2, and at each one only pairs that can reach it are joined and
    scored. A query whose k-th candidate reaches the floor is settled, because whatever was not joined lies
    below; only the others go on. ``near`` holds pairs that are scored whatever they share.
    """
    best_first = Window.partitionBy("left_id").orderBy(F.desc("combined"), "first_logical")
    out = None
    for floor in [f for f in FLOORS if f > least] + [least]:
        pairs = _reaching(q, c, floor)
        if near is not None:
            pairs = pairs.unionByName(near.join(q.select(F.col("content").alias("left_id")), "left_id", "left_semi")).distinct()
        found = _scored(pairs, q, c).filter(F.round(F.col("combined") * 10_000) >= floor)
        found = found.withColumn("_r", F.row_number().over(best_first)).filter(F.col("_r") <= k)
        found = stored(found.drop("_r", "first_logical"), "best-pairs")
        if floor == least:
            settled = found
        else:
            # copies of a candidate fill places as well
            done = found.groupBy("left_id").agg(F.sum("_rows").alias("_n")).filter(F.col("_n") >= k).select("left_id")
            settled = found.join(done, "left_id", "left_semi")
            q = stored(q.join(done.withColumnRenamed("left_id", "content"), "content", "left_anti"), "open-queries")
        out = settled if out is None else out.unionByName(settled)
        if q.isEmpty():
            break
    return out.drop("_rows")


def _cosine(a: str, b: str) -> Column:
    """Cosine rounded to 4; zero for a zero vector, null where a side has no vector."""
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm), 4)


def compare(
    queries: DataFrame, candidates: DataFrame, k: int = 5, scope: str = "registry",
    min_combined: tuple[int, int] = (0, 1), vectors: DataFrame | None = None, thresholds: Thresholds = Thresholds(),
    id: str = "id", mode: str = "ws",
) -> DataFrame:
    """The ``k`` best candidates of every query snippet with scores, label, action and evidence.

    ``candidates`` has logical_id and text, and in registry scope title, lifecycle, owner,
    reuse_intent and binding_ref. Scoring works on distinct contents: a text copied many times is
    scored once and its result handed to every copy. With the default ``min_combined`` of zero the
    result is the full top ``k`` (``best_pairs``), filled up with candidates that share nothing; at a positive floor ``p/q`` pairs
    that cannot reach it are never joined, and nothing
    at or above the floor is lost. Ties go to the smaller logical id.
    """
    if scope not in COVERAGE:
        raise ValueError("scope must be 'registry' or 'workspace'")
    p, q_ = min_combined
    least = max(1, -(-10_000 * p // q_))
    governed = scope == "registry"
    qrows = _contents(queries, id, mode)
    crows = _contents(candidates, "logical_id", mode)
    vec = None if vectors is None else stored(vectors.select("document", F.col("embedding").alias("_v")), "vectors")
    q = _distinct_contents(qrows, vec)
    c = _distinct_contents(crows, vec, extra=[F.min("_id").alias("first_logical"), F.count("*").alias("_rows")])
    near = None if vectors is None else stored(_nearest(q, c, vec, k), "nearest")
    top = best_pairs(q, c, near, k, least)
    # of candidates with one content only the first k by id can be among the best k
    members = (
        crows.select(F.col("_id").alias("logical_id"), F.col("content").alias("right_id"))
        .withColumn("_m", F.row_number().over(Window.partitionBy("right_id").orderBy("logical_id")))
        .filter(F.col("_m") <= k).drop("_m")
    )
    hits = stored(top.join(members, "right_id"), "hits")
    if not p:
        hits = hits.unionByName(_fillers(q, c, crows, hits, k))
    order = Window.partitionBy("left_id").orderBy(F.desc("combined"), "logical_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    gov = _governance(candidates, governed)
    bound = F.lit(governed) & F.col("binding_ref").isNotNull()
    result = salted_join(hits, gov, "logical_id", "left_id")
    label = classify(F.col("ast"), F.col("feature"), F.col("embedding"), F.col("_same"), bound, thresholds)
    shared = lambda *kinds: F.transform(
        F.filter("_shared", lambda f: F.substring_index(f, ":", 1).isin(*kinds)),
        lambda f: F.regexp_extract(f, "^[^:]*:(.*)$", 1),
    )
    warnings = [*(WORKSPACE_WARNINGS if not governed else ()), *((NO_VECTORS_WARNING,) if vectors is None else ())]
    per_content = result.select(
        "left_id", "rank", "logical_id", "title", "lifecycle", "owner", "reuse_intent", "authority", "binding_ref",
        F.lit(COVERAGE[scope]).alias("coverage"), "ast", "feature", "embedding", "combined",
        F.when(F.col("ast").isNotNull(), "ast").when(F.col("embedding").isNotNull(), "embedding")
        .otherwise("feature").alias("method"),
        label.alias("relationship"), action(label, F.lit(governed), F.col("lifecycle")).alias("recommended_action"),
        shared("src").alias("shared_sources"), F.array_sort(shared("agg", "grp", "joins")).alias("shared_operations"),
        shared("concept").alias("shared_concepts"),
        F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"),
    )
    ids = qrows.select(F.col("_id").alias(id), F.col("content").alias("left_id"), "language")
    return salted_join(ids, per_content, "left_id", id).drop("left_id")


def _fillers(q: DataFrame, c: DataFrame, crows: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Zero-score candidates for queries with fewer than ``k`` hits.

    Such a query has at most ``k - 1`` hits, so ``k`` others are found among the first
    ``2k - 1`` candidates by id.
    """
    first = (
        crows.select(F.col("_id").alias("logical_id"), F.col("content").alias("right_id"))
        .orderBy("logical_id").limit(2 * k - 1)
        .agg(F.collect_list(F.struct("logical_id", "right_id")).alias("f")).scalar()
    )
    have = hits.groupBy("left_id").agg(F.collect_list("logical_id").alias("_have"))
    short = (
        q.select(F.col("content").alias("left_id")).join(have, "left_id", "left")
        .filter(F.coalesce(F.size("_have"), F.lit(0)) < k).withColumn("_first", first)
        .select("left_id", "_have", F.inline("_first"))
        .filter(~F.coalesce(F.array_contains("_have", F.col("logical_id")), F.lit(False)))
    )
    same = F.substring_index("left_id", ":", 1) == F.substring_index("right_id", ":", 1)
    short = short.join(q.select(F.col("content").alias("left_id"), F.col("_v").alias("_lv")), "left_id").join(
        c.select(F.col("content").alias("right_id"), F.col("_v").alias("_rv")), "right_id"
    )
    return short.select(
        "left_id", "right_id", F.when(same, F.lit(0.0)).alias("ast"), F.lit(0.0).alias("feature"),
        _cosine("_lv", "_rv").alias("embedding"), F.lit(0.0).alias("combined"), same.alias("_same"),
        F.array().cast("array<string>").alias("_shared"), "logical_id",
    )


def _governance(candidates: DataFrame, governed: bool) -> DataFrame:
    def field(name: str, default: str | None):
        if not governed or name not in candidates.columns:
            return F.lit(default if name != "title" else "").cast("string").alias(name)
        return (F.coalesce(F.col(name), F.lit(default)) if default else F.col(name)).alias(name)

    title = F.col("title") if "title" in candidates.columns else F.lit("")
    return candidates.select(
        "logical_id", title.alias("title"), field("lifecycle", UNKNOWN), field("owner", UNKNOWN),
        field("reuse_intent", UNKNOWN), F.lit(REGISTERED if governed else UNKNOWN).alias("authority"),
        field("binding_ref", None),
    )


def summarize(queries: DataFrame, matches: DataFrame, id: str = "id") -> DataFrame:
    """One row per query snippet: method used, best match and the advice in words."""
    best = F.min_by(F.struct("logical_id", "relationship", "recommended_action", "combined"), "rank")
    per = matches.groupBy(id).agg(
        best.alias("_b"), F.count("*").alias("matches"),
        F.bool_or(F.col("embedding").isNotNull()).alias("_e"), F.bool_or(F.col("ast").isNotNull()).alias("_a"),
    )
    text = (
        F.when(F.col("_b").isNull(), NO_CANDIDATES_SUMMARY)
        .when(F.col("_b.combined") < SAFE_BELOW, SAFE_SUMMARY)
        .otherwise(F.concat(
            F.lit("Closest match: "), F.col("_b.logical_id"), F.lit(" ["), F.col("_b.relationship"), F.lit("] — "),
            F.col("_b.recommended_action"),
        ))
    )
    return queries.select(id).join(per, id, "left").select(
        id, F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.coalesce("_e", F.lit(False)), "embedding").when(F.coalesce("_a", F.lit(False)), "ast")
        .otherwise("feature").alias("method"),
        F.col("_b.logical_id").alias("closest"), F.col("_b.combined").alias("closest_score"), text.alias("summary"),
    )

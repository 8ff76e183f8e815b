"""Registry lookups: bindings, governance, canonical choice and composition, for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.operators.search import hits as search_hits
from reuselake.operators.skew import salted_join, shuffled
from reuselake.session import stored

# fixed values: order of authority, and the texts of lookup results
INTENT_RANK = {"enterprise_canonical": 0, "domain_canonical": 1, "shared_utility": 2}
AUTHOR_NOTE = "No enterprise-wide certified definition — author and register a new canonical."
NO_BINDING_NOTE = "No implementation bindings are registered for this artifact."
NEW_WORK = "No registered components matched — this is new work; author and register it."


def facet(
    artifact: DataFrame, binding: DataFrame | None = None, interface: str | None = None, lifecycle: str | None = None,
    runtime: str | None = None,
) -> DataFrame:
    if interface:
        artifact = artifact.filter(F.array_contains("interface_types", interface))
    if lifecycle:
        artifact = artifact.filter(F.col("lifecycle_state") == lifecycle)
    if runtime:
        artifact = artifact.join(binding.filter(F.col("runtime") == runtime), "fqn", "left_semi")
    return artifact


def find(artifact: DataFrame, exact: str | None = None, prefix: str | None = None, keyword: str | None = None) -> DataFrame:
    for value, test in ((exact, lambda v: F.col("fqn") == v), (prefix, lambda v: F.col("fqn").startswith(v)),
                        (keyword, lambda v: F.lower("fqn").contains(v.lower()))):
        if value is not None:
            artifact = artifact.filter(test(value))
    return artifact


def registry_index(artifact: DataFrame) -> DataFrame:
    """Snapshot of what is published; local artifacts stay out."""
    return artifact.filter(F.col("lifecycle_state").isin("shared", "certified", "retired")).select(
        "fqn", F.array_join("interface_types", ",").alias("interface"), "owner_team", "lifecycle_state"
    )


def local_pointers(artifact: DataFrame, concept: Column) -> DataFrame:
    """Local artifacts with the first certified artifact for the same concept, if there is one."""
    keyed = artifact.withColumn("_concept", concept)
    certified = keyed.filter(F.col("lifecycle_state") == "certified").groupBy("_concept").agg(
        F.min("fqn").alias("certified_fqn")
    )
    local = keyed.filter(F.col("lifecycle_state") == "local").select("fqn", "_concept")
    return salted_join(local, certified, "_concept", "fqn", how="left").select("fqn", "certified_fqn")


def pick_binding(binding: DataFrame, preferred_language: str = "") -> DataFrame:
    """One source-bearing binding per artifact: preferred language, else SQL, else any; prod first."""
    lang = F.when(F.col("source_path").endswith(".py"), "python").otherwise("sql")
    rank = F.when(lang == preferred_language, 0).when(lang == "sql", 1).otherwise(2)
    best = F.min_by(F.struct("*"), F.struct(rank, F.col("env") != "prod", F.col("ordinal")))
    return binding.filter(F.col("source_path").isNotNull()).groupBy("fqn").agg(best.alias("b")).select("b.*")


def bindings_with_source(artifact: DataFrame, binding: DataFrame, source: str = "source_path") -> DataFrame:
    gov = artifact.select("fqn", "lifecycle_state", "owner_team", "interface_types")
    return binding.filter(F.col(source).isNotNull()).join(gov, "fqn")


def artifact_detail(artifact: DataFrame, binding: DataFrame, edge: DataFrame) -> DataFrame:
    """Each artifact with governance, its bindings, and how many artifacts it reads and serves.

    The linked artifacts themselves are rows of :func:`artifact_links`: an artifact may be read
    by any number of others, so they are never gathered into one value."""
    b = binding.groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", "physical_ref", "system", "env", "runtime", "dialect", "object_type"))).alias("bindings"))
    n = artifact_links(edge).groupBy("fqn").agg(
        F.count_if(F.col("direction") == "dependency").alias("dependencies"),
        F.count_if(F.col("direction") == "consumer").alias("consumers"),
    )
    known = lambda x: F.coalesce(F.when(F.col(x) != "", F.col(x)), F.lit("UNKNOWN"))
    gov = F.struct(
        F.lit("REGISTERED_CANONICAL").alias("authority"), known("lifecycle_state").alias("lifecycle"),
        known("owner_team").alias("owner"), known("reuse_intent").alias("reuse_intent"),
    )
    return artifact.join(b, "fqn", "left").join(n, "fqn", "left").select(
        "fqn", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"),
        "interface_types", gov.alias("governance"), "bindings",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dependencies", "consumers")],
    )


def artifact_links(edge: DataFrame) -> DataFrame:
    """Both directions of every edge: what an artifact reads, and who reads it."""
    out = edge.select(F.col("from_fqn").alias("fqn"), F.lit("dependency").alias("direction"), F.col("to_fqn").alias("other"), "relationship")
    back = edge.select(F.col("to_fqn").alias("fqn"), F.lit("consumer").alias("direction"), F.col("from_fqn").alias("other"), "relationship")
    return out.unionByName(back)


def resolve_bindings(requests: DataFrame, artifact: DataFrame, binding: DataFrame) -> DataFrame:
    """Recommended binding per request (request_id, fqn, runtime, dialect), the rest as alternatives.

    A binding fits if its runtime equals the one asked for and its dialect, where it has one,
    does too. Production comes first, then environment names in order, then declared order.
    """
    registered = artifact.select("fqn", F.lit(True).alias("_known"))
    per = binding.groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", "physical_ref", "system", "env", F.col("runtime").alias("rt"), F.col("dialect").alias("dl"))
    )).alias("_all"))
    known = registered.join(per, "fqn", "left")
    df = salted_join(requests, known, "fqn", "request_id", how="left")
    fits = lambda b: (
        (F.col("runtime").isNull() | (b["rt"] == F.col("runtime")))
        & (F.col("dialect").isNull() | b["dl"].isNull() | (b["dl"] == F.col("dialect")))
    )
    keyed = F.transform(
        F.filter("_all", fits), lambda b: F.struct((b["env"] != "prod").alias("p"), b["env"].alias("e"), b["ordinal"].alias("o"), b.alias("b"))
    )
    best = F.array_min(keyed)["b"]
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c), F.lit("'")), F.lit("None"))
    df = df.withColumn("_best", best)
    others = F.filter("_all", lambda b: F.col("_best").isNull() | (b["ordinal"] != F.col("_best.ordinal")))
    note = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("'"), F.col("fqn"), F.lit("' is not registered.")))
        .when(F.coalesce(F.size("_all"), F.lit(0)) <= 0, NO_BINDING_NOTE)
        .when(F.col("_best").isNull(), F.concat(
            F.lit("No binding matches runtime="), quoted("runtime"), F.lit(" dialect="), quoted("dialect"), F.lit(". "),
            F.size("_all").cast("string"), F.lit(" binding(s) exist on other runtimes.")))
    )
    return df.select(
        "request_id", "fqn", "runtime", "dialect", F.col("_best.physical_ref").alias("recommended_ref"),
        F.col("_best.env").alias("recommended_env"), F.transform(others, lambda b: b["physical_ref"]).alias("alternatives"),
        note.alias("note"),
    )


def select_canonical(hits: DataFrame, artifact: DataFrame, enterprise_only: bool = True) -> DataFrame:
    """The artifact to reuse per query: never a retired one; enterprise-wide definitions only, or
    by authority and then relevance. A minimum per query, so nothing is sorted."""
    gov = artifact.select("fqn", "title", "lifecycle_state", "reuse_intent")
    live = salted_join(hits, gov, "fqn", "query").filter(F.lower(F.coalesce("lifecycle_state", F.lit(""))) != "retired")
    rank = F.lit(99)
    for intent, r in INTENT_RANK.items():
        rank = F.when(F.col("reuse_intent") == intent, r).otherwise(rank)
    if enterprise_only:
        live = live.filter(F.col("reuse_intent") == "enterprise_canonical")
    # relevance order without ranking: the higher score, then the smaller name; substring hits have no score
    order = F.struct(rank, -F.coalesce("score", F.lit(0.0)), F.col("fqn"))
    return live.groupBy("query").agg(
        F.min_by(F.struct("fqn", "title", "lifecycle_state", "reuse_intent"), order).alias("c")
    ).select("query", "c.*")


def resolve_concepts(concepts: DataFrame, index: dict[str, DataFrame], artifact: DataFrame, enterprise_only: bool = True) -> DataFrame:
    """Each concept (column query) with its canonical artifact, null where there is none."""
    found = select_canonical(search_hits(concepts, index), artifact, enterprise_only)
    return concepts.select("query").distinct().join(shuffled(found), "query", "left")


def identity_match(query: Column, fqn: Column, title: Column) -> Column:
    """A word of at least three letters of the query occurs in the artifact's name or title."""
    hay = F.lower(F.concat_ws(" ", fqn, title))
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) >= 3)
    return F.exists(words, lambda w: hay.contains(w))


def composition_plan(
    requests: DataFrame, index: dict[str, DataFrame], artifact: DataFrame, binding: DataFrame, enterprise_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Reuse plans for requests (request_id, intent, components, runtime, dialect).

    Returns (components, summary): one row per asked component with its artifact and binding or
    the note to author it, and one row per request with a whole-request match if there is one.
    """
    comp = requests.select("request_id", "runtime", "dialect", F.posexplode("components").alias("position", "query"))
    asked = comp.select("query").unionByName(requests.select(F.col("intent").alias("query"))).distinct()
    canon = stored(
        resolve_concepts(asked, index, artifact, enterprise_only).filter(F.col("fqn").isNotNull()), "canonical"
    )
    found = salted_join(comp, canon, "query", ["request_id", "position"], how="left")
    unique = F.concat_ws("#", F.col("request_id").cast("string"), F.col("position").cast("string"))
    asks = found.filter(F.col("fqn").isNotNull()).select(unique.alias("request_id"), "fqn", "runtime", "dialect")
    bound = resolve_bindings(asks, artifact, binding).select(
        F.col("request_id").alias("_u"), "recommended_ref", F.col("note").alias("_note")
    )
    components = stored(
        found.withColumn("_u", unique).join(bound, "_u", "left").select(
            "request_id", "position", F.col("query").alias("concept"),
            F.when(F.col("fqn").isNull(), "AUTHOR_AND_REGISTER").otherwise("REUSE_REGISTERED").alias("status"), "fqn",
            "recommended_ref", F.when(F.col("fqn").isNull(), AUTHOR_NOTE).otherwise(F.col("_note")).alias("note"),
        ), "components",
    )
    per = components.groupBy("request_id").agg(
        F.count_if(F.col("fqn").isNotNull()).alias("_reuse"), F.count_if(F.col("fqn").isNull()).alias("_missing"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("fqn").isNull(), F.struct("position", "concept")))), lambda s: s["concept"]
        ).alias("missing"),
    )
    direct = salted_join(requests, canon.withColumnRenamed("query", "intent"), "intent", "request_id", how="left").select(
        "request_id", F.when(identity_match(F.col("intent"), F.col("fqn"), F.col("title")), F.col("fqn")).alias("direct_match"),
        "lifecycle_state",
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    summary = (
        F.when(F.col("direct_match").isNotNull(), F.concat(
            F.lit("A registered artifact already matches the whole request: "), F.col("direct_match"), F.lit(" ["),
            F.col("lifecycle_state"), F.lit("]. Reuse it instead of re-composing.")))
        .when(F.coalesce("_reuse", F.lit(0)) > 0, F.concat(
            F.lit("Reuse "), zero("_reuse"), F.lit(" registered component(s); author only the "), zero("_missing"),
            F.lit(" missing part(s) and the small composition that joins them.")))
        .otherwise(NEW_WORK)
    )
    return components, direct.join(per, "request_id", "left").select(
        "request_id", "direct_match", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        summary.alias("summary"),
    )


def missing_concepts(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("fqn").isNull()).select("query")

"""Reuse measurement: who consumes what, and how much of it goes through canonical artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reuselake.functions.predicates import as_date
from reuselake.operators.skew import salted_join, shuffled

# fixed values: consumer types, environment prefixes of physical names, action thresholds
CONSUMER_TYPES = ("dashboard", "notebook", "pipeline", "service")
ENV_PREFIX = r"^(prod|uat|dev|test)[._]"
BYPASS_LIMIT, BYPASS_ACTION = 5, "review_access_patterns_and_discoverability"
ADOPTION_LIMIT, ADOPTION_ACTION = 0.8, "improve_semantic_layer_guardrails"
WINDOW_DAYS = 30

EDGE = ["consumer_key", "artifact_fqn", "usage_type"]


def normal_ref(ref: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(ref)), ENV_PREFIX, "")


def attribute(events: DataFrame, names: tuple[str, ...] = CONSUMER_TYPES, type_column: str = "consumer_type") -> DataFrame:
    """Events with ``consumer_key``: ``{type}:{source}/{name}`` from the tag, else from the session,
    else ``unknown:{source}``.

    The tag is JSON (``{"app": "tableau", "dashboard": "x"}``) or labels (``dashboard=x``); its
    ``app`` names the source where the log is not the tool's own.
    """
    tag = F.col("tag")
    found = F.coalesce(*[F.get_json_object(tag, f"$.{n}") for n in names], *[
        F.nullif(F.regexp_extract(tag, rf"(?:^|[,; ]){n}=([^,; ]+)", 1), F.lit("")) for n in names
    ])
    kinds = [F.when(F.get_json_object(tag, f"$.{n}").isNotNull() | tag.rlike(rf"(?:^|[,; ]){n}="), n)
             for n in names if n in CONSUMER_TYPES]
    kind = F.coalesce(F.col(type_column), *kinds, F.lit("service")) if type_column in events.columns else F.coalesce(
        *kinds, F.lit("service"))
    source = F.coalesce(F.get_json_object(tag, "$.app"), F.col("source_system"))
    session = F.col("session_user") if "session_user" in events.columns else F.lit(None).cast("string")
    key = F.coalesce(
        F.concat(kind, F.lit(":"), source, F.lit("/"), found),
        F.concat(F.lit("service:"), F.col("source_system"), F.lit("/"), session),
        F.concat(F.lit("unknown:"), F.col("source_system")),
    )
    return events.withColumns({"consumer_key": key, "kind": kind, "ref": normal_ref(F.col("physical_ref"))})


def known(key: Column) -> Column:
    return ~key.startswith("unknown:")


def ref_index(binding: DataFrame) -> DataFrame:
    """Normalised physical name to artifact, one row per name."""
    return binding.groupBy(normal_ref(F.col("physical_ref")).alias("ref")).agg(F.min("fqn").alias("fqn"))


def resolve(rows: DataFrame, binding: DataFrame, spread="consumer_key") -> DataFrame:
    """Rows (column ref) with the artifact they use; unresolved objects count as bypass and keep
    their physical name."""
    out = salted_join(rows, ref_index(binding), "ref", spread, how="left")
    return out.withColumns({
        "usage_type": F.when(F.col("fqn").isNull(), "bypass").otherwise("canonical"),
        "artifact_fqn": F.coalesce("fqn", "ref"),
    }).drop("fqn")


def daily_buckets(events: DataFrame, binding: DataFrame) -> DataFrame:
    """Events per consumer, artifact and day.

    Events are counted per physical name before the name is resolved, so a name with a third of
    all events crosses the join as a few counted rows."""
    raw = attribute(events) if "consumer_key" not in events.columns else events
    counted = raw.groupBy("consumer_key", "ref", F.col("event_ts").cast("date").alias("day")).agg(
        F.count("*").alias("events"), F.max("event_ts").alias("last_seen"), F.min("event_ts").alias("first_seen")
    )
    return resolve(counted, binding, ["consumer_key", "day"]).groupBy(*EDGE, "day").agg(
        F.sum("events").alias("events"), F.max("last_seen").alias("last_seen"), F.min("first_seen").alias("first_seen")
    )


def rolling_30d(buckets: DataFrame, n: int = WINDOW_DAYS) -> DataFrame:
    """Rolling count at every day an edge was active, recomputed from the daily buckets."""
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*EDGE).orderBy("_n").rangeBetween(-(n - 1), 0)
    return buckets.withColumn("_n", day).withColumn("event_count_30d", F.sum("events").over(w)).drop("_n")


def usage_edges(buckets: DataFrame, as_of, n: int = WINDOW_DAYS) -> DataFrame:
    """One row per (consumer, artifact): count of the last ``n`` days and last sighting."""
    d = as_date(as_of)
    inside = F.col("day").between(F.date_sub(d, n - 1), d)
    return buckets.filter(F.col("day") <= d).groupBy(*EDGE).agg(
        F.coalesce(F.sum(F.when(inside, F.col("events"))), F.lit(0)).alias("event_count_30d"),
        F.max("last_seen").alias("last_seen"),
    )


def consumer_nodes(events: DataFrame) -> DataFrame:
    """Consumers as they were discovered, with first and last sighting."""
    return events.groupBy("consumer_key").agg(
        F.min("kind").alias("consumer_type"), F.min("source_system").alias("source_system"),
        F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"),
    )


def rate(part: Column, whole: Column) -> Column:
    return F.round(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), 6)


def adoption(buckets: DataFrame, artifact: DataFrame) -> DataFrame:
    """Canonical share of all attributed use, overall and for certified datasets and metrics.

    Unknown consumers are left out, so that missing tags do not pass for adoption."""
    uses = buckets.filter(known(F.col("consumer_key"))).groupBy("artifact_fqn", "usage_type").agg(
        F.sum("events").alias("events")
    )
    gov = artifact.select(F.col("fqn").alias("artifact_fqn"), "lifecycle_state", F.element_at("interface_types", 1).alias("interface"))
    rows = uses.join(shuffled(gov), "artifact_fqn", "left")
    certified = F.coalesce(F.col("lifecycle_state") == "certified", F.lit(False))

    def of(interface: str):
        scope = (F.col("interface") == interface) | (F.col("usage_type") == "bypass")
        return F.sum(F.when(certified & (F.col("interface") == interface), F.col("events")).otherwise(0)), F.sum(
            F.when(scope, F.col("events")).otherwise(0))

    total = F.sum("events")
    canonical = F.sum(F.when(F.col("usage_type") == "canonical", F.col("events")).otherwise(0))
    return rows.agg(
        total.alias("events"), canonical.alias("canonical_events"), rate(canonical, total).alias("adoption_rate"),
        rate(*of("queryable_dataset")).alias("certified_dataset_adoption_rate"),
        rate(*of("semantic_contract")).alias("certified_metric_adoption_rate"),
    )


def coverage(events: DataFrame, binding: DataFrame) -> DataFrame:
    """Per source: how many events name their consumer and their artifact."""
    counted = events.groupBy("source_system", "consumer_key", "ref").agg(F.count("*").alias("n"))
    rows = resolve(counted, binding)
    n, named = F.col("n"), known(F.col("consumer_key"))
    total = F.sum("n")
    return rows.groupBy("source_system").agg(
        total.alias("events"),
        F.sum(F.when(named, 0).otherwise(n)).alias("unattributed_event_count"),
        rate(F.sum(F.when(named, n).otherwise(0)), total).alias("attributed_rate"),
        rate(F.sum(F.when(F.col("usage_type") == "canonical", n).otherwise(0)), total).alias("object_resolved_rate"),
        F.count_distinct(F.when(named, F.col("consumer_key"))).alias("known_consumers"),
    )


def bypass_distribution(events: DataFrame, binding: DataFrame) -> DataFrame:
    """Bypass events by consumer type and tool with subtotals (null means all)."""
    counted = events.filter(known(F.col("consumer_key"))).groupBy("kind", "source_system", "consumer_key", "ref").agg(
        F.count("*").alias("n")
    )
    rows = resolve(counted, binding).withColumn("_by", F.when(F.col("usage_type") == "bypass", F.col("n")).otherwise(0))
    return rows.cube("kind", "source_system").agg(
        F.sum("_by").alias("bypass_events"), rate(F.sum("_by"), F.sum("n")).alias("bypass_rate")
    )


def actions(observed: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows of recommended actions whose threshold is crossed."""
    bypass = observed.agg(F.count_if(F.col("status") == "suspected_bypass").cast("double").alias("value")).select(
        F.lit("bypass_count").alias("metric"), "value", F.lit(BYPASS_ACTION).alias("action")
    ).filter(F.col("value") > BYPASS_LIMIT)
    low = rates.select(
        F.lit("certified_metric_adoption_rate").alias("metric"), F.col("certified_metric_adoption_rate").alias("value"),
        F.lit(ADOPTION_ACTION).alias("action"),
    ).filter(F.col("value") < ADOPTION_LIMIT)
    return bypass.unionByName(low)


def portfolio_cube(artifact: DataFrame) -> DataFrame:
    """Registered artifacts by interface, lifecycle and owner, with all subtotals."""
    return artifact.select(F.explode_outer("interface_types").alias("interface"), "lifecycle_state", "owner_team").cube(
        "interface", "lifecycle_state", "owner_team"
    ).agg(F.count("*").alias("artifacts"), F.grouping_id().alias("level"))


def certified_consumers(artifact: DataFrame, edge: DataFrame) -> DataFrame:
    certified = artifact.filter(F.col("lifecycle_state") == "certified").select(F.col("fqn").alias("to_fqn"), "owner_team")
    n = edge.groupBy("to_fqn").agg(F.count_distinct("from_fqn").alias("consumers"))
    return certified.join(n, "to_fqn", "left").select(
        F.col("to_fqn").alias("fqn"), "owner_team", F.coalesce("consumers", F.lit(0)).alias("consumers")
    )


def reuse_concentration(artifact: DataFrame, edge: DataFrame, n: int) -> DataFrame:
    """Share of dependencies on certified artifacts that the ``n`` most used of them serve."""
    per = certified_consumers(artifact, edge).select("fqn", "consumers")
    top = per.orderBy(F.desc("consumers"), "fqn").limit(n).agg(F.sum("consumers").alias("top")).scalar()
    return per.agg(F.sum("consumers").alias("dependencies")).withColumn("top_dependencies", top).withColumn(
        "share", rate(F.col("top_dependencies"), F.col("dependencies"))
    )


def hotspots(observed: DataFrame, canonical: DataFrame) -> DataFrame:
    """Observed duplicates per concept and source next to the suspected canonical (concept, fqn),
    and how many parallel definitions of the concept exist ungoverned."""
    per = observed.groupBy("concept", "source_system").agg(
        F.count("*").alias("objects"), F.count_if(F.col("status") == "suspected_bypass").alias("suspected_bypass")
    )
    parallel = observed.groupBy("concept").agg(F.count_distinct("physical_ref").alias("parallel_definitions"))
    return per.join(parallel, "concept").join(
        canonical.select("concept", F.col("fqn").alias("suspected_canonical")), "concept", "left"
    )


def concepts_without_canonical(observed: DataFrame, canonical: DataFrame) -> DataFrame:
    return observed.select("concept").distinct().join(canonical, "concept", "left_anti")


def observed_objects(events: DataFrame, binding: DataFrame) -> DataFrame:
    """Physical objects in use that no binding names."""
    used = events.groupBy("ref").agg(F.count("*").alias("hits"), F.max("event_ts").alias("last_seen"))
    return used.join(shuffled(ref_index(binding)), "ref", "left_anti")


def propagation_gap(artifact: DataFrame, edge: DataFrame) -> DataFrame:
    """Certified datasets that others read, but never through a semantic contract."""
    dataset = artifact.filter(
        (F.col("lifecycle_state") == "certified") & F.array_contains("interface_types", "queryable_dataset")
    ).select(F.col("fqn").alias("to_fqn"))
    contract = artifact.filter(F.array_contains("interface_types", "semantic_contract")).select(F.col("fqn").alias("from_fqn"))
    links = edge.select("from_fqn", "to_fqn").distinct()
    used = links.groupBy("to_fqn").agg(F.count("*").alias("dependents"))
    governed = salted_join(links, contract, "from_fqn", "to_fqn", how="left_semi").select("to_fqn").distinct()
    return dataset.join(used, "to_fqn").join(governed, "to_fqn", "left_anti").select(F.col("to_fqn").alias("fqn"), "dependents")


def promotion_candidates(buckets: DataFrame, min_consumers: int = 2) -> DataFrame:
    """Unregistered objects used by several known consumers."""
    return (
        buckets.filter((F.col("usage_type") == "bypass") & known(F.col("consumer_key")))
        .groupBy(F.col("artifact_fqn").alias("ref"))
        .agg(F.count_distinct("consumer_key").alias("consumers"), F.sum("events").alias("events"))
        .filter(F.col("consumers") >= min_consumers)
    )

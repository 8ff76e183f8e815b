"""Governance checks; each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reuselake.functions.predicates import as_date, spark_type
from reuselake.operators.graph import impact_closure
from reuselake.operators.skew import shuffled

# fixed values: vocabularies, the FQN pattern, legal lifecycle steps, fields of a metric's meaning
LIFECYCLES = ("local", "shared", "certified", "deprecated", "retired")
INTENTS = ("enterprise_canonical", "domain_canonical", "shared_utility")
INTERFACES = ("callable_logic", "queryable_dataset", "semantic_contract")
GATED = ("shared", "certified")
FQN_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+\.v[0-9]+$"
PHYSICAL_NAMESPACES = ("marts", "staging", "raw")
TRANSITIONS = (("local", "shared"), ("shared", "certified"), ("certified", "deprecated"), ("deprecated", "retired"))
SEMANTIC_FIELDS = (
    "filter", "expr", "aggregation", "default_grain", "window", "dimension", "numerator", "denominator"
)


def _violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(found).alias("violation"))


def check_vocab(df: DataFrame, key: str, vocab: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside the fixed vocabularies, per column."""
    return _violations(df, [key], {f"unknown_{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in vocab.items()})


def gate_metadata(artifact: DataFrame) -> DataFrame:
    """Shared and certified artifacts need owner, versioned name, lifecycle and interface.

    An artifact without a lifecycle state cannot be told to be local, so it is checked too."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    in_scope = F.col("lifecycle_state").isin(*GATED) | blank("lifecycle_state")
    return _violations(artifact.filter(in_scope), ["fqn"], {
        "missing_owner": blank("owner_team"),
        "missing_identity": ~F.coalesce(F.col("fqn").rlike(r"\.v[0-9]+$"), F.lit(False)),
        "missing_lifecycle": blank("lifecycle_state"),
        "missing_interface": F.coalesce(F.size("interface_types"), F.lit(0)) <= 0,
        "unknown_intent": ~F.col("reuse_intent").isin(*INTENTS),
        "unknown_interface": F.exists("interface_types", lambda i: ~i.isin(*INTERFACES)),
    })


def gate_fqn(artifact: DataFrame, pattern: str = FQN_PATTERN) -> DataFrame:
    """Names that do not follow the pattern, or name a physical schema."""
    return _violations(artifact, ["fqn"], {
        "bad_fqn": ~F.coalesce(F.col("fqn").rlike(pattern), F.lit(False)),
        "physical_namespace": F.element_at(F.split("fqn", r"\."), 2).isin(*PHYSICAL_NAMESPACES),
    })


def fqn_collisions(artifact: DataFrame) -> DataFrame:
    return artifact.groupBy("fqn").agg(F.count("*").alias("entries")).filter("entries > 1")


def schema_diff(contract: DataFrame, old: int, new: int, renames: DataFrame | None = None) -> DataFrame:
    """Column changes between two versions of every dataset, by meeting both on the column name.

    ``renames`` (dataset, old_name, new_name) declares renamed columns; without it a rename reads
    as a removal and an addition. Either way it breaks."""
    def side(v: int, prefix: str) -> DataFrame:
        return contract.filter(F.col("version") == v).select(
            "dataset", "column_name", F.lower("type").alias(f"{prefix}_type"), F.col("nullable").alias(f"{prefix}_null"))

    both = side(old, "old").join(side(new, "new"), ["dataset", "column_name"], "full_outer")
    change = (
        F.when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type").isNull() & (F.col("new_null") == 0), "added_required")
        .when(F.col("old_type").isNull(), "added_nullable")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
        .when((F.col("old_null") == 1) & (F.col("new_null") == 0), "tightened")
    )
    diff = both.withColumn("change", change).filter("change IS NOT NULL").select("dataset", "column_name", "change")
    if renames is not None:
        before = renames.select("dataset", F.col("old_name").alias("column_name"), F.lit(True).alias("_from"))
        after = renames.select("dataset", F.col("new_name").alias("column_name"))
        diff = (
            diff.join(before, ["dataset", "column_name"], "left")
            .withColumn("change", F.when((F.col("change") == "removed") & F.col("_from"), "renamed").otherwise(F.col("change")))
            .drop("_from")
        )
        added = diff.filter(F.col("change").startswith("added")).join(after, ["dataset", "column_name"], "left_anti")
        diff = diff.filter(~F.col("change").startswith("added")).unionByName(added)
    return diff.withColumn("breaking", F.col("change").isin("removed", "renamed", "added_required", "retyped"))


def grain_changes(grain: DataFrame, old: int, new: int) -> DataFrame:
    """Datasets whose grain columns differ between two versions."""
    per = grain.groupBy("dataset").agg(*[
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("version") == v, F.col("column_name")))), ",").alias(n)
        for v, n in ((old, "old_grain"), (new, "new_grain"))
    ])
    return per.filter((F.col("old_grain") != "") & (F.col("new_grain") != "") & (F.col("old_grain") != F.col("new_grain")))


def gate_semantic(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of meaning between two sets of metric definitions (metric, field, value).

    Any change of a meaning-bearing field breaks; of dimensions only a removal does."""
    a = old.filter(F.col("field").isin(*SEMANTIC_FIELDS)).select("metric", "field", F.trim("value").alias("value"), F.lit(1).alias("o"))
    b = new.filter(F.col("field").isin(*SEMANTIC_FIELDS)).select("metric", "field", F.trim("value").alias("value"), F.lit(1).alias("n"))
    # the same field and value on both sides cancel out; what stays has changed
    moved = a.unionByName(b, allowMissingColumns=True).groupBy("metric", "field", "value").agg(
        F.max("o").alias("o"), F.max("n").alias("n")
    ).filter("o IS NULL OR n IS NULL")
    per = moved.groupBy("metric", "field").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("o").isNotNull(), F.col("value")))), ",").alias("old_value"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n").isNotNull(), F.col("value")))), ",").alias("new_value"),
    )
    return per.filter((F.col("field") != "dimension") | (F.col("old_value") != ""))


def base_name(fqn: Column) -> Column:
    return F.regexp_replace(fqn, r"\.v[0-9]+$", "")


def version(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"\.v([0-9]+)$", 1).cast("int")


def gate_version(changes: DataFrame) -> DataFrame:
    """Outcome per changed artifact (old_fqn, new_fqn, breaking): a breaking change needs a new version."""
    same = version(F.col("old_fqn")) >= version(F.col("new_fqn"))
    return changes.filter(base_name(F.col("old_fqn")) == base_name(F.col("new_fqn"))).withColumn(
        "outcome", F.when(F.col("breaking") & same, "block").otherwise("allow")
    )


def valid_exceptions(exceptions: DataFrame, as_of) -> DataFrame:
    """Exceptions with justification and owner approval whose expiry is not past."""
    return exceptions.filter(
        F.coalesce("justified", F.lit(False)) & F.coalesce("owner_approved", F.lit(False))
        & (F.col("expiry_date") >= as_date(as_of))
    )


def gate_duplication(matches: DataFrame, exceptions: DataFrame, policy: DataFrame, as_of) -> DataFrame:
    """Outcome per match (id, lifecycle, match_kind): the policy's, and block where a review needs
    evidence that is missing. Local artifacts are not gated.

    ``policy`` (lifecycle, match_kind, outcome, evidence) is a table the user owns."""
    ok = valid_exceptions(exceptions, as_of).select("id").distinct().withColumn("_ok", F.lit(True))
    routed = matches.filter(F.col("lifecycle").isin(*GATED)).join(policy, ["lifecycle", "match_kind"]).join(ok, "id", "left")
    return routed.withColumn(
        "outcome", F.when(F.col("evidence") & F.col("_ok").isNull(), "block").otherwise(F.col("outcome"))
    ).drop("_ok", "evidence")


def gate_retired_refs(edges: DataFrame, known: DataFrame, artifact: DataFrame) -> DataFrame:
    """References to deprecated or retired artifacts: existing users of a deprecated one must
    migrate; a new reference to either is blocked."""
    state = artifact.select(F.col("fqn").alias("to_fqn"), "lifecycle_state").filter(
        F.col("lifecycle_state").isin("deprecated", "retired")
    )
    refs = edges.select("from_fqn", "to_fqn").distinct().join(state, "to_fqn")
    old = known.select("from_fqn", "to_fqn").distinct().withColumn("_old", F.lit(True))
    return refs.join(old, ["from_fqn", "to_fqn"], "left").select(
        "from_fqn", "to_fqn", "lifecycle_state",
        F.when(F.col("_old").isNull(), "block")
        .when(F.col("lifecycle_state") == "deprecated", "migrate").otherwise("remove").alias("outcome"),
    )


def deprecation_complete(deprecated: DataFrame, artifact: DataFrame, as_of) -> DataFrame:
    """Deprecated artifacts (fqn, deprecated_since, replacement, removal_after) with missing facts,
    an unregistered replacement, or a sunset that has passed."""
    known = artifact.select(F.col("fqn").alias("replacement"), F.lit(True).alias("_r")).distinct()
    return _violations(deprecated.join(known, "replacement", "left"), ["fqn"], {
        "missing_since": F.col("deprecated_since").isNull(),
        "missing_replacement": F.col("replacement").isNull(),
        "unregistered_replacement": F.col("replacement").isNotNull() & F.col("_r").isNull(),
        "missing_removal_date": F.col("removal_after").isNull(),
        "sunset_passed": F.col("removal_after") < as_date(as_of),
    })


def gate_lifecycle(snapshots: DataFrame) -> DataFrame:
    """Illegal steps between consecutive snapshots (fqn, snapshot_date, lifecycle_state)."""
    before = F.lag("lifecycle_state").over(Window.partitionBy("fqn").orderBy("snapshot_date"))
    steps = snapshots.withColumn("from_state", before).filter("from_state <> lifecycle_state")
    legal = F.lit(False)
    for a, b in TRANSITIONS:
        legal = legal | ((F.col("from_state") == a) & (F.col("lifecycle_state") == b))
    return steps.filter(~legal).select("fqn", "snapshot_date", "from_state", F.col("lifecycle_state").alias("to_state"))


def grain_violations(df: DataFrame, grain: list[str]) -> DataFrame:
    return df.groupBy(*grain).agg(F.count("*").alias("rows")).filter("rows > 1")


def contract_check(df: DataFrame, contract: list[tuple[str, str, bool]], grain: list[str]) -> DataFrame:
    """Data against its contract (column, type, nullable) and grain: (check, column, violations).

    Presence and types are read off the schema; nulls are counted in one pass over the contract's
    columns; repeated grain keys are counted after combining on the key."""
    spark = df.sparkSession
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {c: spark_type(t) for c, t, _ in contract}
    rows = [("missing_column", c, 1) for c in want if c not in have]
    rows += [("wrong_type", c, 1) for c, t in want.items() if c in have and have[c].replace("_ntz", "") != t]
    fixed = spark.createDataFrame(rows, "check string, column string, violations bigint")
    required = [c for c, _, nullable in contract if not nullable and c in have]
    out = fixed
    if required:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        out = out.unionByName(nulls.select(F.inline(F.array(*[
            F.struct(F.lit("null_value").alias("check"), F.lit(c).alias("column"), F.col(c).alias("violations")) for c in required
        ]))).filter("violations > 0"))
    if all(c in have for c in grain):
        dup = grain_violations(df.select(*grain), grain).agg(F.count("*").alias("violations"))
        out = out.unionByName(dup.filter("violations > 0").select(
            F.lit("duplicate_grain").alias("check"), F.lit(",".join(grain)).alias("column"), "violations"))
    return out


def freshness(df: DataFrame, ts: str, as_of, slo_minutes: int) -> DataFrame:
    """Age of the newest row at the as-of time, and whether it is within the agreed minutes."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    age = F.timestamp_diff("MINUTE", F.max(F.col(ts).cast("timestamp_ntz")), now)
    return df.agg(F.max(ts).alias("newest"), age.alias("age_minutes")).withColumn(
        "fresh", F.col("age_minutes") <= slo_minutes
    )


def gate_scope(artifact: DataFrame, published: DataFrame, pointers: DataFrame) -> DataFrame:
    """Published artifacts that are neither shared nor certified, and locals that carry no pointer
    although a certified artifact for their concept exists (fqn, certified_fqn, canonical_pointer)."""
    wrong = published.select("fqn").join(artifact.select("fqn", "lifecycle_state"), "fqn").filter(
        ~F.coalesce(F.col("lifecycle_state").isin(*GATED), F.lit(False))
    ).select("fqn", F.lit("published_out_of_scope").alias("violation"))
    silent = pointers.filter(F.col("certified_fqn").isNotNull() & F.col("canonical_pointer").isNull()).select(
        "fqn", F.lit("missing_canonical_pointer").alias("violation")
    )
    return wrong.unionByName(silent)


def deprecation_notices(artifact: DataFrame, edge: DataFrame) -> DataFrame:
    """Everyone downstream of a deprecated artifact, with the owner to tell."""
    reach = impact_closure(edge, artifact.filter(F.col("lifecycle_state") == "deprecated").select("fqn"))
    owner = artifact.select(F.col("fqn").alias("node"), "owner_team")
    return reach.join(shuffled(owner), "node").select(
        F.col("root").alias("deprecated_fqn"), F.col("node").alias("consumer_fqn"),
        F.col("owner_team").alias("consumer_owner"), "depth",
    )

"""Artifact manifests: scan, child tables, full refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINDING = (
    "system string, env string, object_type string, physical_ref string, attribution_key string, "
    "source_path string, runtime string, dialect string"
)
EDGE = "fqn string, relationship string"
RAW = (
    "fqn string, title string, description string, interface_types array<string>, lifecycle_state string, "
    "reuse_intent string, entry_role string, owner_team string, source_manifest string, aliases array<string>, "
    f"known_consumers array<struct<{EDGE.replace(' string', ': string')}>>, "
    f"bindings array<struct<{BINDING.replace(' string', ': string')}>>, "
    f"dependencies array<struct<{EDGE.replace(' string', ': string')}>>"
)


def read_manifests(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Every ``*.yaml``/``*.yml`` below ``root`` whose ``kind`` is the given one, one row each.

    Older key names are accepted beside the current ones. The path below ``root`` is kept.
    """
    root = root.rstrip("/")
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml}")
        .text(root, wholetext=True)
        .select("value", F.substring_index("_metadata.file_path", root + "/", -1).alias("path"))
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = [manifest_row(yaml.safe_load(v) or {}, p, kind) for v, p in zip(pdf["value"], pdf["path"])]
            yield pd.DataFrame([r for r in rows if r is not None], columns=COLUMNS)

    return files.mapInPandas(decode, RAW)


COLUMNS = [
    "fqn", "title", "description", "interface_types", "lifecycle_state", "reuse_intent", "entry_role", "owner_team",
    "source_manifest", "aliases", "known_consumers", "bindings", "dependencies",
]


def manifest_row(doc: dict, path: str, kind: str):
    """Values of one decoded manifest in the order of ``COLUMNS``; none for another kind."""
    if not isinstance(doc, dict) or doc.get("kind") != kind:
        return None
    meta, spec = doc.get("metadata") or {}, doc.get("spec") or {}

    def first(*keys, default=None):
        return next((spec[k] for k in keys if spec.get(k)), default)

    def text(value) -> str:
        return "" if value is None else str(value)

    def links(items):
        return [{"fqn": text(i.get("fqn")), "relationship": text(i.get("relationship"))} for i in items]

    bindings = [
        {
            "system": text(b.get("system")), "env": text(b.get("env")), "object_type": text(b.get("objectType")),
            "physical_ref": text(b.get("ref")), "attribution_key": text(b.get("attributionKey")),
            "source_path": b.get("source") or None, "runtime": b.get("runtime") or None, "dialect": b.get("dialect") or None,
        }
        for b in first("implementationBindings", "physicalImplementations", default=[])
    ]
    return [
        text(meta.get("fqn")), text(meta.get("title")), text(meta.get("description")).strip(),
        list(spec.get("interfaceTypes") or []), text((meta.get("lifecycle") or {}).get("state")),
        text(first("reuseIntent", "reuseScope", default="")), text(first("entryRole", default="producer")),
        text((meta.get("owner") or {}).get("team")), path, list(meta.get("aliases") or spec.get("aliases") or []),
        links(spec.get("knownConsumers") or []), bindings, links(first("declaredDependencies", "dependencies", default=[])),
    ]


def infer_runtime(system: Column, object_type: Column, default_dialect: str = "snowflake") -> tuple[Column, Column]:
    """(runtime, dialect) of a binding from the system and object type it names; first rule wins."""
    s, o = F.lower(F.coalesce(system, F.lit(""))), F.lower(F.coalesce(object_type, F.lit("")))
    warehouse, none = F.lit(default_dialect), F.lit(None).cast("string")
    # fixed values: rule, runtime, dialect in order of precedence
    rules = [
        (s.contains("databricks"), "databricks", F.lit("databricks")),
        (s.contains("spark"), "spark", F.lit("spark")),
        (s.contains("sqlmesh"), "sqlmesh", warehouse),
        (s.contains("dbt") | o.isin("macro", "model"), "dbt", warehouse),
        (s.contains("semantic") | o.isin("metric", "metric_definition", "semantic_model"), "semantic", none),
        ((s == "warehouse") | o.isin("udf", "table", "view", "function"), "warehouse", warehouse),
    ]
    runtime, dialect = F, F
    for cond, r, d in rules:
        runtime, dialect = runtime.when(cond, F.lit(r)), dialect.when(cond, d)
    return runtime.otherwise(F.when(s != "", s).otherwise("unknown")), dialect.otherwise(none)


def with_runtime(binding: DataFrame, default_dialect: str = "snowflake") -> DataFrame:
    """Bindings with runtime and dialect; values given explicitly win over the inferred ones."""
    runtime, dialect = infer_runtime(F.col("system"), F.col("object_type"), default_dialect)
    given = lambda c: F.col(c) if c in binding.columns else F.lit(None).cast("string")
    return binding.withColumns({
        "runtime": F.coalesce(given("runtime"), runtime), "dialect": F.coalesce(given("dialect"), dialect)
    })


def search_document() -> Column:
    """Text to search an artifact by: identity, words about it, its links and bindings."""
    parts = [
        F.col("fqn"), F.col("title"), F.col("description"), F.col("reuse_intent"), F.concat_ws(" ", "interface_types"),
        F.concat_ws(" ", "aliases"), F.concat_ws(" ", "dependencies.fqn"), F.concat_ws(" ", "known_consumers.fqn"),
        F.concat_ws(" ", "bindings.physical_ref"), F.concat_ws(" ", "bindings.object_type"),
    ]
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def registry_tables(raw: DataFrame, default_dialect: str = "snowflake") -> dict[str, DataFrame]:
    """The registry's tables: artifact (with search text), binding, edge."""
    artifact = raw.withColumn("body", search_document()).drop("bindings", "dependencies")
    binding = raw.select("fqn", F.posexplode("bindings").alias("ordinal", "b")).select("fqn", "ordinal", "b.*")
    edge = raw.select(F.col("fqn").alias("from_fqn"), F.explode("dependencies").alias("d")).select(
        "from_fqn", F.col("d.fqn").alias("to_fqn"), F.col("d.relationship").alias("relationship"),
        F.lit("declared").alias("source"),
    )
    return {"artifact": artifact, "binding": with_runtime(binding, default_dialect), "edge": edge}


def write_registry(tables: dict[str, DataFrame], path: str) -> None:
    """Full refresh: each table replaces what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("artifact", "binding", "edge")}

"""Source code as candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reuselake.operators.registry import pick_binding

# fixed values: folders searched and folders never searched
ROOTS = ("dwh", "finance", "sales", "marketing", "enterprise")
EXCLUDED = (
    "__pycache__", ".git", "node_modules", ".venv", "venv", "env",
    "dist", "build", "target", "_site", ".pytest_cache", "site-assets",
)


def language_of(path):
    return F.when(path.endswith(".py"), "python").otherwise("sql")


def read_code_tree(spark: SparkSession, root: str, roots=ROOTS, exclude=EXCLUDED) -> DataFrame:
    """Every SQL and Python file below the roots: logical_id (path below ``root``), title, language, text.

    Files that are not valid UTF-8, package initialisers and excluded folders are left out.
    """
    root = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,py}")
        .load(f"{root}/{{{','.join(roots)}}}")
    )
    rel = F.substring_index("path", root + "/", -1)
    folders = F.slice(F.split("logical_id", "/"), 1, F.size(F.split("logical_id", "/")) - 1)
    return (
        files.select(rel.alias("logical_id"), F.col("content").cast("string").alias("text"))
        .withColumn("title", F.substring_index("logical_id", "/", -1))
        .filter(~F.col("title").contains("__init__"))
        .filter(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in exclude])))
        .filter(F.is_valid_utf8("text"))
        .select("logical_id", "title", language_of(F.col("title")).alias("language"), "text")
    )


def registered_candidates(
    artifact: DataFrame, binding: DataFrame, code: DataFrame, preferred_language: str = ""
) -> DataFrame:
    """One candidate per artifact that has a readable source, with its governance.

    ``code`` has the columns of :func:`read_code_tree`; a binding's ``source_path`` is its id.
    """
    sources = code.select(F.col("logical_id").alias("source_path"), "text")
    chosen = pick_binding(binding.join(sources.select("source_path"), "source_path", "left_semi"), preferred_language)
    return (
        chosen.join(sources, "source_path")
        .join(artifact.select("fqn", "title", "lifecycle_state", "owner_team", "reuse_intent"), "fqn")
        .select(
            F.col("fqn").alias("logical_id"), "title", language_of(F.col("source_path")).alias("language"), "dialect", "text",
            F.col("lifecycle_state").alias("lifecycle"), F.col("owner_team").alias("owner"), "reuse_intent",
            F.col("physical_ref").alias("binding_ref"), "runtime", "env", "source_path",
        )
    )

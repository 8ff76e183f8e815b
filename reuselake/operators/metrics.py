"""Metric layer: declared models and metrics turned into DataFrame aggregations."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reuselake.functions.predicates import safe_div, within_days

# fixed values: supported time grains, finest first
GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str  # sum | count | count_distinct
    expr: str


@dataclass(frozen=True)
class SemanticModel:
    """What one row of a dataset means, and what may be grouped by and measured."""

    name: str
    dataset: str
    entity: str
    grain: tuple[str, ...]
    time: str
    dimensions: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()

    def measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        raise ValueError(f"model {self.name} has no measure {name}")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str  # within_days | not_null | eq | is_true
    value: object = None


@dataclass(frozen=True)
class Metric:
    name: str
    type: str  # sum | count_distinct | simple | ratio
    model: SemanticModel | None = None
    expr: str | None = None
    measure: str | None = None
    filters: tuple[Filter, ...] = ()
    numerator: Metric | None = None
    denominator: Metric | None = None
    grains: tuple[str, ...] = GRAINS
    default_grain: str = "month"
    dimensions: tuple[str, ...] = ()
    canonical: str | None = None

    def definition_hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


def extend(model: SemanticModel, name: str, dataset: str, dimensions: tuple[str, ...]) -> SemanticModel:
    """Model with the same entity and grain and further dimensions; nothing may be overridden."""
    clash = set(dimensions) & (set(model.dimensions) | set(model.grain) | {m.name for m in model.measures})
    if clash:
        raise ValueError(f"{name} would override {sorted(clash)} of {model.name}")
    return replace(model, name=name, dataset=dataset, dimensions=model.dimensions + tuple(dimensions))


def extended_dataset(base: DataFrame, extra: DataFrame, model: SemanticModel) -> DataFrame:
    """Rows of the extended model: extra attributes looked up on the grain."""
    return base.join(extra, list(model.grain), "left")


def aggregate(agg: str, expr: str) -> Column:
    c = F.expr(expr)
    if agg == "sum":
        return F.sum(c)
    if agg == "count":
        return F.count(c)
    if agg == "count_distinct":
        return F.count_distinct(c)
    raise ValueError(f"unknown aggregation {agg!r}")


def condition(f: Filter, as_of=None) -> Column:
    c = F.col(f.field)
    if f.op == "not_null":
        return c.isNotNull()
    if f.op == "is_true":
        return F.coalesce(c, F.lit(False))
    if f.op == "eq":
        return c == F.lit(f.value)
    if f.op == "within_days":
        if as_of is None:
            raise ValueError("a within_days filter needs an as-of date")
        return within_days(c, as_of, int(f.value))
    raise ValueError(f"unknown filter {f.op!r}")


def check_request(metric: Metric, grain: str, dims: tuple[str, ...]) -> None:
    if grain not in metric.grains or grain not in GRAINS:
        raise ValueError(f"{metric.name} does not support grain {grain!r}; choose from {metric.grains}")
    bad = [d for d in dims if d not in metric.dimensions]
    if bad:
        raise ValueError(f"{metric.name} does not allow dimensions {bad}")
    if metric.model is not None:
        unknown = [d for d in dims if d not in metric.model.dimensions]
        if unknown:
            raise ValueError(f"model {metric.model.name} has no dimensions {unknown}")


def evaluate(
    metric: Metric, datasets: dict[str, DataFrame], grain: str | None = None, dims: tuple[str, ...] = (), as_of=None
) -> DataFrame:
    """Metric per period and dimension values, in a column named after the metric."""
    grain = grain or metric.default_grain
    dims = tuple(dims)
    check_request(metric, grain, dims)
    keys = ["period", *dims]
    if metric.type == "ratio":
        num = evaluate(metric.numerator, datasets, grain, dims, as_of)
        den = evaluate(metric.denominator, datasets, grain, dims, as_of)
        n, d = metric.numerator.name, metric.denominator.name
        # each side has one row per key: stacking them meets null keys too, which a join would not
        both = num.unionByName(den, allowMissingColumns=True).groupBy(*keys).agg(
            F.max(n).alias(n), F.max(d).alias(d)
        )
        return both.withColumn(metric.name, safe_div(F.col(n), F.col(d)))
    model = metric.model
    if metric.type == "simple":
        m = model.measure(metric.measure)
        agg, expr = m.agg, m.expr
    elif metric.type in ("sum", "count_distinct"):
        agg, expr = metric.type, metric.expr
    else:
        raise ValueError(f"unknown metric type {metric.type!r}")
    rows = datasets[model.dataset]
    for f in metric.filters:
        rows = rows.filter(condition(f, as_of))
    period = F.date_trunc(grain, F.col(model.time)).cast("date").alias("period")
    return rows.groupBy(period, *dims).agg(aggregate(agg, expr).alias(metric.name))


def compare_to_canonical(
    local: Metric, canonical: Metric, datasets: dict[str, DataFrame], grain: str, dims: tuple[str, ...] = (), as_of=None
) -> DataFrame:
    """A local variant next to the canonical metric it points at."""
    if local.canonical != canonical.name:
        raise ValueError(f"{local.name} does not point at {canonical.name}")
    keys = ["period", *dims]
    a = evaluate(local, datasets, grain, dims, as_of)
    b = evaluate(canonical, datasets, grain, dims, as_of)
    return (
        a.unionByName(b, allowMissingColumns=True).groupBy(*keys)
        .agg(F.max(local.name).alias(local.name), F.max(canonical.name).alias(canonical.name))
        .withColumn("delta", F.col(local.name) - F.col(canonical.name))
    )


def materialize(values: DataFrame, metric: Metric, path: str) -> None:
    """Store metric values stamped with the hash of the definition they were computed by."""
    values.withColumn("definition_hash", F.lit(metric.definition_hash())).write.mode("overwrite").partitionBy(
        "definition_hash"
    ).parquet(path)


def read_materialized(spark: SparkSession, metric: Metric, path: str) -> DataFrame:
    """Stored values, only as far as the definition is still the one they were computed by."""
    return spark.read.parquet(path).filter(F.col("definition_hash") == metric.definition_hash())

"""Clusters and closures of edge tables by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.operators.skew import salted_join, shuffled
from reuselake.session import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of the component of every node that has an edge: (node, cluster).

    Large-star / small-star rounds (Kiveris et al. 2014): every round links neighbours to the
    smallest node seen, so chains shrink by halves instead of one step per round. Both stars are
    a minimum per node and one join back, where a hub's edges are spread over tasks.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = stored(
        both.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = None
    while True:
        mirrored = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(mirrored, low, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        met = salted_join(large, down, "u", "v")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            met.select("u", F.col("m").alias("v"))
        )
        links = stored(small.filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(links.withColumnsRenamed({"u": "node", "v": "cluster"}), "node", "left").withColumn(
        "cluster", F.coalesce("cluster", "node")
    )


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("members"))


def impact_direct(edges: DataFrame) -> DataFrame:
    """Per artifact how many it reads from and how many read from it."""
    out = edges.select(F.col("from_fqn").alias("fqn"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    inn = edges.select(F.col("to_fqn").alias("fqn"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(inn).groupBy("fqn").agg(F.sum("o").alias("upstream"), F.sum("i").alias("downstream"))


#: A node with more dependents than this has them dealt over several tasks.
HUB = 10_000


def _dealt_hops(edges: DataFrame) -> DataFrame:
    """Hops (node, next), those of a hub under several salts, with the number of salts of the node and of the next one (0: it has no hops)."""
    hops = stored(edges.select(F.col("to_fqn").alias("node"), F.col("from_fqn").alias("next")).filter("node IS NOT NULL").distinct(), "hops")
    parts = stored(hops.groupBy("node").agg(F.ceil(F.count("*") / HUB).alias("_parts")), "hop-parts")
    after = shuffled(parts.withColumnsRenamed({"node": "next", "_parts": "_next_parts"}))
    dealt = hops.join(shuffled(parts), "node").join(after, "next", "left")
    return stored(dealt.select(
        "node", "next", F.pmod(F.xxhash64("next"), F.col("_parts")).alias("_salt"), "_parts", F.coalesce("_next_parts", F.lit(0).cast("bigint")).alias("_next_parts"),
    ), "dealt-hops")


def impact_closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All artifacts that depend on each root, with the smallest number of steps.

    ``edges`` point from a dependent to what it depends on; ``roots`` has a column fqn. Each
    round joins only the newly reached rows and drops those seen before, so cycles end.
    """
    hops = _dealt_hops(edges)
    parts = hops.select("node", "_parts").distinct()
    frontier = shuffled(roots.select(F.col("fqn").alias("root"), F.col("fqn").alias("node")).distinct()).join(parts, "node")
    reached = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        asked = frontier.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        step = hops.drop("_parts").join(shuffled(asked.drop("_parts")), ["node", "_salt"])
        step = step.select("root", F.col("next").alias("node"), F.col("_next_parts").alias("_parts")).distinct()
        if reached is not None:
            step = step.join(shuffled(reached), ["root", "node"], "left_anti")
        step = stored(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        found = step.select("root", "node", "depth")
        reached = found if reached is None else reached.unionByName(found)
        frontier = step.filter("_parts > 0").select("root", "node", "_parts")
    if reached is None:
        return roots.select(F.col("fqn").alias("root"), F.col("fqn").alias("node"), F.lit(0).alias("depth")).limit(0)
    return reached

"""Joins whose big side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 8


def salted_join(big: DataFrame, small: DataFrame, on, spread, parts: int = PARTS, how: str = "inner") -> DataFrame:
    """Equality join that spreads each key of ``big`` over ``parts`` tasks.

    ``spread`` names columns of ``big`` that differ among the rows of one key. ``small`` is
    repeated ``parts`` times, so it should be the side with few rows per key. Both sides are shuffled: the repeated
    rows are unknown to the planner's size estimate, which would send them all through the driver as a broadcast.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the big side's rows once can be salted")
    on = [on] if isinstance(on, str) else list(on)
    spread = [spread] if isinstance(spread, str) else list(spread)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(parts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides both grow with the input: never a broadcast, however small its compressed files look."""
    return df.hint("merge")

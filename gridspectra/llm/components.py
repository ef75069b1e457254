"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b: every vertex's neighbours are tied to the smallest of them and itself."""
    flip = edges.select(F.col("b").alias("u"), F.col("a").alias("w"))
    ties = edges.select(F.col("a").alias("u"), F.col("b").alias("w"))
    ties = ties.unionByName(flip) if large else ties
    least = ties.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("center"), F.least("u", "m").alias("m"))
    to = ties.join(least, F.col("u") == F.col("center"))
    if large:
        out = to.where(F.col("w") > F.col("u")).select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("center").alias("a"), F.col("m").alias("b"))
        out = to.select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of `edges` (a, b): label is the smallest vertex of v's component.

    Any orderable type; loops, repeats and both directions are allowed, null ends are skipped. Labels sink by a
    logarithmic number of rounds, each written to the shared folder; nothing but a count reaches the driver.
    """
    at = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = written(at.where(F.col("a") > F.col("b")).distinct())
    while True:
        after = written(_star(_star(now, True), False))
        changed = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        discard(now)
        now = after
        if not changed:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("label"))).distinct()

"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.scale import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = (both.join(least, "u").where("v > u")
             .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return (
        small.select(F.inline(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))))
        .where("u > v").distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is the smallest node reachable.

    Self links are ignored, null ends too. Each round is a written table, so lost
    executors repeat one round at most, and the rounds grow with the logarithm of
    the longest path. Only row counts and checksums reach the driver. An empty
    edge table gives no rows.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    check = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == check or not row[0]:
            break
        check = tuple(row)
        now = materialize(_stars(now), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both.filter("v < u") if small else both
    least = side.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = side.join(least, "u").filter(F.lit(True) if small else F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges with v < u are stars around their smallest nodes: no node has two v, none is both u and v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("hub")).union(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("hub").alias("hub"))
    return not roles.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("hub") == 1)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs to (node, label): label is the smallest node reachable.

    Each round is written to the shared folder, so a lost executor costs one round. Rounds go with the
    logarithm of the longest path and end when only stars are left, which one aggregate over nodes tells; hubs
    are handled by partial minima and skew-splittable joins, never by collecting a neighbourhood. Null ends
    are ignored; an empty table gives an empty result.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        now = materialize(_star(_star(now, False), True), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())

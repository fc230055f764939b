"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpencil.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def content_key(text: Column) -> Column:
    """128 bits of a text as binary; equal for null and empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, math.ceil(rows / per_partition))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable over undirected edges, for each node of an edge.

    Alternating large-star and small-star passes: every pass is one aggregation and one join keyed by node, and
    hub nodes are split by Spark's skew join. Each pass is written to the shared folder, so the plan stays short
    and a lost executor costs one pass. Passes grow with the logarithm of the longest path.
    """
    F_ = F.col
    pairs = edges.where(F_(a).isNotNull() & F_(b).isNotNull() & (F_(a) != F_(b)))
    links = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = links.select("u", "v").union(links.select(F_("v").alias("u"), F_("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # large star: every larger neighbour of u moves to u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F_("v").alias("u"), F_("m").alias("v"))
        large = large.where("u <> v")                  # as many rows as links at most
        # small star: u and its smaller neighbours move to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F_("v") == F_("m"), F_("u")).otherwise(F_("v")).alias("u"), F_("m").alias("v"))
        links = materialize(small.where("u <> v").distinct(), "links")
        ends = links.select(F_("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            links.select(F_("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 OR up > 0 AND down > 0").count():
            return links.select(F_("u").alias("node"), F_("v").alias("component")).union(
                links.select(F_("v").alias("node"), F_("v").alias("component")).distinct())

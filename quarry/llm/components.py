"""Connected components of an edge table, in rounds of two joins each.

Every round hangs a node's larger neighbours, then its smaller ones, on the
smallest neighbour (the large-star and small-star steps of Kiveris et al., 2014);
paths halve, so the rounds grow with the logarithm of the longest path. Minima
are pre-aggregated before their shuffle and shuffled once more for their join
(``reshuffled``), so that adaptive execution splits a hub's rows over many tasks.
Each round is a written table; they end when every node hangs on its component's
smallest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, reshuffled, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(reshuffled(least, "u"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(reshuffled(least, "u"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), longs, that another is joined with, as a
    written table; a component is named by its smallest node."""
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _done(now):
        following = written(spark, _small(_large(now)), "edges")
        remove(spark, now)
        now = following
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(spark, named.unionAll(now.select("v", "v").distinct()), "components")
    remove(spark, now)
    return out

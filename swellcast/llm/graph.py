"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id it
    can reach. Alternates large-star and small-star steps until the edges form
    stars; every step is a grouped minimum and a join, so hubs are aggregated
    map-side and their joins can be split, and no group is ever collected."""
    edges = stored(_apart(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    seen = None
    while True:
        edges = stored(_small(_large(edges)), "edges")
        # done when neither step changes the edge set: compare size and an order-free digest
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    # stars: a is the centre, b < a never holds
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()


def _apart(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _apart(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b"))


def _small(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return _apart(edges.join(least, "b").select(F.col("m"), F.col("a").alias("x"))
                  .unionByName(least.select("m", F.col("b").alias("x"))).select(F.col("m").alias("a"), F.col("x").alias("b")))

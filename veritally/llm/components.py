"""Connected components by alternating large-star and small-star steps.

Every step is a group-by minimum (partially aggregated, so a vertex with very many links is no hot group) and
a join; edges are written to the shared folder after each round, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, stored


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id of the component, root != id) of every vertex that isn't a root itself.

    edges: columns a, b (long); loops, nulls and repeated edges do no harm.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges", small=True)
    mark = None
    while True:
        got = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or not got[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark, last = tuple(got), e
        e = stored(_small(_large(e).where("a > b")).where("a > b").distinct(), "edges", small=True)
        dropped(last)

"""Connected components by alternating large and small stars; links and components stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written_at


def state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return r.n, r.x


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node that has a link; links: a, b (long)."""
    edges, at = written_at(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = state(edges)
    while before[0]:
        # large star: larger neighbours move to the least of the neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last = at
        edges, at = written_at(small.filter("a <> b").distinct(), "links")
        removed(edges.sparkSession, last)  # nothing reads it any more
        after = state(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)

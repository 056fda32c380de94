"""Connected components of links between ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every id in ``links`` (two bigint columns
    ``a``, ``b``); ``component`` is the smallest id reachable.

    Large-star and small-star steps alternate until the links no longer
    change; each pair of steps is written to the shared folder. Every step is
    a minimum per id (combined map-side) joined back to the links, so an id
    with very many links is split by the join, never gathered.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
                 .union(least.select("a", "m")))
        edges = stage(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(roots.select("node", F.col("node").alias("component"))))

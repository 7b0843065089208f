"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.storage import discard, stash


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Labels each node of ``edges(a, b)`` with the smallest node it reaches.

    Alternates large-star and small-star steps, which take about log(n) rounds
    whatever the graph's diameter. Each step is one partial aggregate (so a hub
    with any share of the edges meets as one row per task) and one equi-join,
    whose hot keys adaptive execution can split. Each round is written to the
    shared folder; nothing but an edge count and one checksum reach the driver.

    Returns ``node, component``. Rows with a null end and self-loops are dropped;
    an empty table gives an empty result. Repeated edges count once.
    """
    now = stash(
        edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct(),
        tag,
    )
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a plain exchange on both sides of each join, so that a hub's rows can be dealt to many tasks
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).repartition("u")
        # large star: larger neighbours move to the smallest of the closed neighbourhood
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star over the result: smaller neighbours move to their least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.repartition("u"), "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = stash(small, tag)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(roots.select("node", F.col("node").alias("component")))

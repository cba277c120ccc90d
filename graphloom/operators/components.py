"""Weakly connected components of an edge table, without gathering a node's edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000, tidy: bool = False) -> DataFrame:
    """node, component: the smallest node that each node of an edge can reach.

    Alternates two steps until no edge changes. In the large step every node links its larger neighbours to its
    smallest; in the small step it links its smaller neighbours and itself to their smallest. What is left is a star
    around the smallest node of each component. Minima are partial aggregates joined back to the edges, so a hub's edges
    are split over tasks. Rounds grow with the logarithm of the longest path. Each round is written to the shared folder.

    tidy: collect the driver's garbage after each round, for jobs of which this is one step of many.

    Null ends are ignored; self loops give a node of its own; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    nodes = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    ordered = pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = materialize(ordered, "links"), None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        fresh = materialize(small.distinct(), "links")
        discard(links)
        links = fresh
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tidy:
            release(links.sparkSession)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("v", "node").alias("component"))

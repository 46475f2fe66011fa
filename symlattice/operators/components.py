"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.plans.scratch import discard, scratch


def _least(rows: DataFrame) -> DataFrame:
    """(u, v) -> (u, m): m is the least of u and all its neighbours."""
    return rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node that ``edges`` names; the component is its least node.

    Undirected; null ends and self loops link nothing, but a self loop's node is still returned.
    Each round is two shuffles of the edges (large star, then small star) and cuts its lineage in the
    shared folder. The number of rounds grows with the logarithm of the longest path. An aggregate
    with map-side combine finds each minimum, so that a hub's links never meet in one task unsummed.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = scratch(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u is linked to the least one in u's neighbourhood
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        low = _least(large)
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, links = links, scratch(small)
        discard(old)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )

"""Trust banners: freshness, coverage and resolution quality of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED_SHARE = 0.6
#: Labels of the freshness axis from best to worst.
TRUST_RANKS = ("fresh", "stale", "rebuilding", "missing")
#: Reasons of edges whose target should be in the graph.
INTERNAL_REASONS = ("import-binding", "same-file", "unique-global")


def counts(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(files, "files").crossJoin(one(nodes, "nodes")).crossJoin(one(edges, "edges"))


def trust(files: Column, state: Column, indexed_head: Column, head: Column) -> Column:
    """Freshness from the file count, the store's state, and the commits indexed and checked out (null: none)."""
    return (
        F.when(files == 0, "missing")
        .when(state == "rebuilding", "rebuilding")
        .when(indexed_head.isNotNull() & head.isNotNull(), F.when(indexed_head == head, "fresh").otherwise("stale"))
        .when(indexed_head.isNull() & head.isNotNull(), "stale")
        .otherwise("fresh")
    )


def resolve_quality(edges: DataFrame, nodes: DataFrame, least: float = RESOLVED_SHARE) -> DataFrame:
    """One row: considered, resolved, quality (ok or partial).

    Considered are call and heritage edges with an internal reason, and unresolved ones whose raw name some node has.
    """
    some = edges.where("kind in ('calls', 'extends', 'implements')")
    named = nodes.select(F.col("name").alias("raw_name"), F.lit(True).alias("named")).distinct()
    inside = F.col("reason").isin(*INTERNAL_REASONS) | ((F.col("reason") == "unresolved") & F.coalesce("named", F.lit(False)))
    total = some.join(named, "raw_name", "left").where(inside).agg(F.count(F.lit(1)).alias("considered"), F.coalesce(F.sum(F.col("resolved").cast("long")), F.lit(0)).alias("resolved"))
    good = (F.col("considered") == 0) | (F.col("resolved") >= least * F.col("considered"))
    return total.withColumn("quality", F.when(good, "ok").otherwise("partial"))


def merge(banners: DataFrame, *by: str) -> DataFrame:
    """Banners (trust, coverage, resolve, files, nodes, edges) of a group as one: the worst of each axis, counts summed.

    Without ``by`` there is always one row, and no banner at all is a missing graph. A null trust is missing.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TRUST_RANKS)), F.col("trust")), F.lit(0))
    rank = F.when(rank == 0, len(TRUST_RANKS)).otherwise(rank)
    worst = F.coalesce(F.max(rank), F.lit(len(TRUST_RANKS)))
    any_of = lambda c, bad, good: F.when(F.coalesce(F.max((F.col(c) == bad).cast("int")), F.lit(0)) == 1, bad).otherwise(good)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return banners.groupBy(*by).agg(
        F.element_at(F.array(*map(F.lit, TRUST_RANKS)), worst.cast("int")).alias("trust"),
        any_of("coverage", "sampled", "exhaustive").alias("coverage"),
        any_of("resolve", "partial", "ok").alias("resolve"),
        total("files"),
        total("nodes"),
        total("edges"),
    )


def with_members(members: DataFrame, banners: DataFrame, key: str) -> DataFrame:
    """A banner for each member; one that can't be read is missing, and is never left out."""
    joined = members.join(banners, key, "left")
    fill = {"trust": "missing", "coverage": "exhaustive", "resolve": "ok", "files": 0, "nodes": 0, "edges": 0}
    return joined.select(*members.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def render(b: dict) -> str:
    """The signature line of a banner row."""
    return "trust: {trust} · coverage: {coverage} · resolve: {resolve}  ({files} files, {nodes} symbols, {edges} edges)".format(**b)


def render_group(b: dict, repos: int) -> str:
    return f"{render(b)}  [group: {repos} repos]"

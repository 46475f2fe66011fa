"""Traversals and neighbourhoods of the property graph.

Edges have edge_id (their order), src_id, dst_id (null: open), kind, raw_name, resolved, conf, reason, file_path and line;
nodes have id, kind, name, qualified_name, file_path, start_line, end_line, exported, signature and node_seq (their order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.plans.scratch import scratch

MAX_DEPTH = 4
SPINE_HOPS = 4
HOP = ("file_path", "line", "conf", "reason")


def _first_rows(df: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each key: an aggregate with map-side combine, no window over the group."""
    least = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("row")))
    return df.groupBy(*by).agg(least.alias("m")).select(*by, "m.row.*")


def blast_hops(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Callers of the seeds, breadth first: depth, rank, src_id and the call site by which each was first reached.

    ``seeds``: (id, seed_seq); seeds themselves are left out. ``rank`` (the seed's number, then
    the edges of the path) orders the hops of one depth as a queue would: by the caller from which a node was reached, then by edge. Each level is one join of the frontier to the calls, so the work is that of the
    edges touched; nothing is collected.
    """
    calls = edges.where("kind = 'calls' and dst_id is not null").select("edge_id", "src_id", "dst_id", *HOP)
    frontier = seeds.groupBy("id").agg(F.array(F.min("seed_seq").cast("long")).alias("rank"))
    seen, hops = frontier.select("id"), None
    for depth in range(1, max_depth + 1):
        reached = calls.join(frontier.withColumnRenamed("id", "dst_id"), "dst_id").join(seen.withColumnRenamed("id", "src_id"), "src_id", "left_anti")
        reached = reached.withColumn("rank", F.concat("rank", F.array(F.col("edge_id").cast("long"))))
        first = _first_rows(reached, ["src_id"], [F.col("rank")], ["rank", *HOP])
        level = scratch(first.select(F.lit(depth).alias("depth"), "rank", "src_id", *HOP))
        frontier = level.select(F.col("src_id").alias("id"), "rank")
        seen = seen.union(frontier.select("id"))
        hops = level if hops is None else hops.union(level)
    return hops


def with_nodes(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hops with the caller's name; a caller that is no node (module scope) stays, with a null name."""
    return hops.join(nodes.select(F.col("id").alias("src_id"), "name", "qualified_name", "kind"), "src_id", "left")


def blast_depths(hops: DataFrame) -> DataFrame:
    """Number of hops and their rendered rows, by depth."""
    who = F.coalesce("qualified_name", F.lit("<module>"))
    row = F.concat(who, F.lit("  "), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit("  ["), "reason", F.lit("]"), F.when(F.col("conf") == "weak", "  ⟨weak⟩").otherwise(""))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))), lambda x: x.row)
    return hops.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), listed.alias("rows"))


def direct_and_deeper(hops: DataFrame) -> DataFrame:
    """One row: how many hops are direct callers, and how many deeper."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return hops.agg(count(F.col("depth") == 1).alias("direct"), count(F.col("depth") > 1).alias("deeper"))


def first_calls(edges: DataFrame) -> DataFrame:
    """For each caller its first call by line, then by edge."""
    calls = edges.where("kind = 'calls'")
    return _first_rows(calls, ["src_id"], [F.col("line"), F.col("edge_id")], ["dst_id", "raw_name", "resolved"])


def spine(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int = SPINE_HOPS) -> DataFrame:
    """(id, spine, n_hops): the path of first calls from each start, at most ``hops`` long.

    A hop without target, unresolved, or to a label in ``<>`` is unnamed: the second one ends the path before it.
    A path also ends with a hop without target or to a node that it has passed. Starts without calls give no row.
    """
    labels = nodes.groupBy(F.col("id").alias("dst_id")).agg(F.max_by("qualified_name", "node_seq").alias("label"))
    step = first_calls(edges).join(labels, "dst_id", "left").withColumn("label", F.coalesce("label", "raw_name"))
    unnamed = F.col("dst_id").isNull() | ~F.col("resolved") | F.col("label").startswith("<")
    step = step.select(F.col("src_id").alias("cur"), F.col("dst_id").alias("next"), F.concat("label", F.lit("  `"), "raw_name", F.lit("`")).alias("text"), unnamed.cast("int").alias("unnamed"))
    state = starts.select("id", F.col("id").alias("cur"), F.array("id").alias("passed"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("blanks"))
    for _ in range(hops):
        joined = state.join(step, "cur", "left")
        take = F.col("text").isNotNull() & (F.col("blanks") + F.col("unnamed") <= 1)
        goes_on = take & F.col("next").isNotNull() & ~F.array_contains("passed", F.col("next"))
        state = joined.select(
            "id",
            F.when(goes_on, F.col("next")).alias("cur"),  # null: the path has ended
            F.when(goes_on, F.concat("passed", F.array("next"))).otherwise(F.col("passed")).alias("passed"),
            F.when(take, F.concat("path", F.array("text"))).otherwise(F.col("path")).alias("path"),
            F.when(take, F.col("blanks") + F.col("unnamed")).otherwise(F.col("blanks")).alias("blanks"),
        )
    named = state.where(F.size("path") > 0).join(labels.select(F.col("dst_id").alias("id"), F.col("label").alias("start")), "id", "left")
    text = F.concat(F.coalesce("start", F.col("id").cast("string")), F.lit(" → "), F.array_join("path", " → "))
    return named.select("id", text.alias("spine"), F.size("path").cast("long").alias("n_hops"))


def _of(ids: DataFrame, column: str) -> DataFrame:
    return ids.select(F.col("id").alias(column)).distinct()


def members(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Children of each id by ``contains`` edges; order by start_line."""
    inside = edges.where("kind = 'contains'").join(_of(ids, "src_id"), "src_id").select("src_id", "dst_id")
    return inside.join(nodes.withColumnRenamed("id", "dst_id"), "dst_id").select(F.col("src_id").alias("id"), F.col("dst_id").alias("member_id"), "name", "kind", "start_line")


def callees(edges: DataFrame, nodes: DataFrame, ids: DataFrame, kind: str = "calls") -> DataFrame:
    """Outgoing edges of a kind: the target's label or the raw name, reason, and a mark for open or weak ones; order by line."""
    out = edges.where(F.col("kind") == kind).join(_of(ids, "src_id"), "src_id")
    target = nodes.select(F.col("id").alias("dst_id"), F.col("qualified_name").alias("target"))
    mark = F.when(~F.col("resolved"), "unresolved").when(F.col("conf") == "weak", "weak").otherwise("")
    return out.join(target, "dst_id", "left").select(F.col("src_id").alias("id"), "edge_id", F.coalesce("target", "raw_name").alias("label"), "reason", mark.alias("mark"), "file_path", "line")


def heritage(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """What each id extends and implements; order by kind."""
    out = edges.where("kind in ('extends', 'implements')").join(_of(ids, "src_id"), "src_id")
    target = nodes.select(F.col("id").alias("dst_id"), F.col("qualified_name").alias("target"))
    return out.join(target, "dst_id", "left").select(F.col("src_id").alias("id"), "kind", F.coalesce("target", "raw_name").alias("label"), "resolved", "line")


def uses(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Inbound references with the user's name, ``<module>`` where that is no node; order by file, line."""
    into = edges.where("kind = 'references'").join(_of(ids, "dst_id"), "dst_id")
    user = nodes.select(F.col("id").alias("src_id"), F.col("qualified_name").alias("user"))
    return into.join(user, "src_id", "left").select(F.col("dst_id").alias("id"), F.coalesce("user", F.lit("<module>")).alias("user"), "file_path", "line")


#: The kinds of edges that tie symbols to routes, flows and clusters.
ROUTE_KINDS = ("handles_route", "step_in", "member_of")


def routes_touching(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct peers of each id over route, flow and cluster edges, in either direction."""
    some = edges.where(F.col("kind").isin(*ROUTE_KINDS)).select("kind", "src_id", "dst_id")
    peer = nodes.select(F.col("id").alias("peer"), "name", "qualified_name")
    out = some.join(_of(ids, "src_id"), "src_id").select(F.col("src_id").alias("id"), "kind", F.col("dst_id").alias("peer"))
    into = some.join(_of(ids, "dst_id"), "dst_id").select(F.col("dst_id").alias("id"), "kind", F.col("src_id").alias("peer"))
    return out.union(into).join(peer, "peer").select("id", "kind", "name", "qualified_name").distinct()

"""Clusters and flows derived from the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.operators.components import connected_components
from symlattice.operators.labels import PACKED, pack, sweeps
from symlattice.plans.prefix import ordered_cumsum
from symlattice.plans.scratch import discard, scratch

ROUNDS, LEAST_MEMBERS = 10, 3
MAX_CHAIN, MAX_FLOWS, LEAST_STEPS = 8, 50, 2
#: A task of label propagation takes small components together until they have so many nodes.
LEAST_TASK_NODES = 4096
#: Node kinds that take part.
SYMBOL_KINDS = ("function", "class", "method")


def derive_input(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of functions, classes and methods, and the resolved calls between them."""
    ids = nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).select("id").distinct()
    calls = edges.where("kind = 'calls' and resolved and dst_id is not null").select("edge_id", "src_id", "dst_id", "conf")
    calls = calls.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return ids, calls


def aggregate_conf(conf: str = "conf"):
    """``strong`` only if all are."""
    return F.when(F.min((F.col(conf) == "strong").cast("int")) == 1, "strong").otherwise("weak")


def propagate(neighbours: dict, rounds: int = ROUNDS) -> dict:
    """Labels after at most ``rounds`` sweeps in id order, each node at once taking the commonest label around it (ties: the least)."""
    label = {n: n for n in neighbours}
    for _ in range(rounds):
        moved = False
        for n in sorted(neighbours):
            tally: dict = {}
            for m in neighbours[n]:
                tally[label[m]] = tally.get(label[m], 0) + 1
            if tally:
                best = min(tally, key=lambda x: (-tally[x], x))
                moved |= best != label[n]
                label[n] = best
        if not moved:
            break
    return label


def label_propagation(calls: DataFrame) -> DataFrame:
    """(id, label) of all symbols with a call to or from another one, as :func:`propagate` finds them.

    A label depends on a node's neighbours alone, and further rounds on a component that has settled change
    nothing; so components are independent. Nodes are numbered by component and id, and a task sweeps over whole
    components whose numbers follow each other. Sorting and packing of the links is dealt over all tasks; a sweep
    itself is sequential by definition, so that the largest component is the largest task. It holds 24 bytes a
    node of its components, and 4 bytes a link end on its disk.
    """
    spark = calls.sparkSession
    pairs = scratch(calls.where("src_id <> dst_id").select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).distinct())
    parts = scratch(connected_components(pairs, "a", "b"))
    numbered = scratch(ordered_cumsum(parts.withColumn("one", F.lit(1)), ["component", "node"], "one", "n").select("node", "component", "n"))
    span = max(LEAST_TASK_NODES, -(-numbered.count() // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a component's least node comes first: its number tells the task of all
    task = numbered.where("node = component").select("component", F.floor(F.col("n") / span).alias("task"))
    a = numbered.join(task, "component").select(F.col("node").alias("a"), F.col("n").alias("u"), "task")
    b = numbered.select(F.col("node").alias("b"), F.col("n").alias("v"))
    links = scratch(pairs.join(a, "a").join(b, "b").select("task", "u", "v"))
    discard(pairs, parts)
    both = links.union(links.select("task", F.col("v").alias("u"), F.col("u").alias("v")))
    packed = scratch(both.repartitionByRange("u", "v").sortWithinPartitions("u", "v").mapInArrow(pack, PACKED))
    discard(links)
    found = scratch(packed.repartition("task").sortWithinPartitions("task", "first", "last").mapInArrow(sweeps(ROUNDS), "n long, label long"))
    name = numbered.select(F.col("n").alias("label"), F.col("node").alias("label_id"))
    out = scratch(found.join(numbered, "n").join(name, "label").select(F.col("node").alias("id"), F.col("label_id").alias("label")))
    discard(packed, found, numbered)
    return out


def communities(calls: DataFrame, nodes: DataFrame, least: int = LEAST_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """Clusters (number, hub, name, size, conf) and their members (number, id).

    Kept are clusters of at least ``least`` members with at least as many distinct internal pairs (a self call
    counts as one). The hub has most calls in and out, all edges counted; ties go to the least id. Numbers follow the least member.
    """
    labels = label_propagation(calls)
    a, b = labels.select(F.col("id").alias("src_id"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst_id"), F.col("label").alias("lb"))
    inner = calls.join(a, "src_id").join(b, "dst_id").where("la = lb")
    pairs = inner.groupBy("la").agg(F.count_distinct(F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")).alias("n_pairs"), aggregate_conf().alias("conf"))
    degree = calls.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    sized = labels.join(degree, "id").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"), F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("hub"))
    kept = sized.join(pairs, F.col("label") == F.col("la")).where((F.col("size") >= least) & (F.col("n_pairs") >= F.col("size")))
    named = nodes.groupBy("id").agg(F.max_by("qualified_name", "node_seq").alias("name"))
    numbered = ordered_cumsum(kept.withColumn("one", F.lit(1)), ["first"], "one", "number")
    out = numbered.select("number", "label", F.col("hub.id").alias("hub"), "size", "conf").join(named.withColumnRenamed("id", "hub"), "hub", "left")
    return out.select("number", "hub", "name", "size", "conf"), labels.join(out.select("number", "label"), "label").select("number", "id")


def entrypoints(calls: DataFrame) -> DataFrame:
    """Callers that nobody calls; a call to itself counts."""
    return calls.select(F.col("src_id").alias("id")).distinct().join(calls.select(F.col("dst_id").alias("id")).distinct(), "id", "left_anti")


def flows(calls: DataFrame, max_chain: int = MAX_CHAIN, max_flows: int = MAX_FLOWS) -> DataFrame:
    """(number, id, steps, conf): from each of the first entry points a greedy walk to the least target not yet passed.

    At most ``max_chain`` steps, at least LEAST_STEPS; of edges to the same target the weak one is last in order.
    """
    starts = entrypoints(calls).orderBy("id").limit(max_flows)
    out = calls.select("src_id", "dst_id", "conf").distinct()
    state = starts.select("id", F.array("id").alias("steps"), F.array().cast("array<string>").alias("confs"), F.col("id").alias("cur"))
    for _ in range(max_chain - 1):
        # one join and one aggregate a step: a walk without a way on keeps its row, with a null target
        ahead = state.join(out, F.col("cur") == F.col("src_id"), "left")
        fresh = F.col("dst_id").isNotNull() & ~F.array_contains("steps", F.col("dst_id"))
        best = ahead.groupBy("id", "steps", "confs").agg(F.min(F.when(fresh, F.struct("dst_id", "conf"))).alias("to"))
        moved = F.col("to").isNotNull()
        state = best.select("id", F.when(moved, F.concat("steps", F.array("to.dst_id"))).otherwise(F.col("steps")).alias("steps"), F.when(moved, F.concat("confs", F.array("to.conf"))).otherwise(F.col("confs")).alias("confs"), F.when(moved, F.col("to.dst_id")).alias("cur"))
    long = state.where(F.size("steps") >= LEAST_STEPS)
    conf = F.when(F.array_contains("confs", "weak"), "weak").otherwise("strong")
    return long.select((F.row_number().over(Window.orderBy("id")) - 1).alias("number"), "id", "steps", conf.alias("conf"))  # at most ``max_flows`` rows


def derived_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and attributes of clusters and flows, as they are stored. Labels fall back to the id of what has no node."""
    calls = scratch(derive_input(nodes, edges)[1])  # read by each step of the walks
    clusters, members = communities(calls, nodes)
    walks = flows(calls)
    one = nodes.groupBy("id").agg(F.max_by(F.struct("qualified_name", "file_path"), "node_seq").alias("n")).select("id", "n.*")
    number = F.col("number").cast("string")
    cid, pid = F.concat(F.lit("#community:"), number), F.concat(F.lit("#process:"), number)

    def node(df: DataFrame, key: str, node_id, kind: str, prefix: str) -> DataFrame:
        label = F.concat(F.lit(prefix), F.coalesce("qualified_name", F.col(key).cast("string")))
        joined = df.join(one.withColumnRenamed("id", key), key, "left")
        return joined.select(node_id.alias("id"), F.lit(kind).alias("kind"), label.alias("name"), label.alias("qualified_name"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(False).alias("exported"), F.lit("").alias("signature"))

    def edge(df: DataFrame, target, kind: str, why: str, line) -> DataFrame:
        joined = df.join(one, "id", "left")
        return joined.select(F.col("id").alias("src_id"), target.alias("dst_id"), F.lit(kind).alias("kind"), F.lit("").alias("raw_name"), F.lit(True).alias("resolved"), "conf", F.lit(why).alias("reason"), F.lit("heuristic").alias("provenance"), F.coalesce("file_path", F.lit("")).alias("file_path"), line.cast("int").alias("line"))

    steps = walks.select("number", "conf", F.posexplode("steps").alias("step", "id"))
    all_nodes = node(clusters, "hub", cid, "community", "").unionByName(node(walks, "id", pid, "process", "flow:"))
    all_edges = edge(members.join(clusters.select("number", "conf"), "number"), cid, "member_of", "community", F.lit(0)).unionByName(edge(steps, pid, "step_in", "process", F.col("step")))
    attrs = clusters.select(cid.alias("node_id"), F.lit("community_size").alias("key"), F.col("size").cast("string").alias("value"))
    return all_nodes, all_edges, attrs

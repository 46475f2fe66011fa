"""The commands: build, keep up and ask the graph of a repository or of a group of them."""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.functions.paths import STORE_DIR
from symlattice.operators import banner, changes, derive, fold, freshness, graph, lookup, resolve, routes, search
from symlattice.plans.prefix import ordered_cumsum
from symlattice.plans.scratch import scratch, shared_dir
from symlattice.sources import config, git
from symlattice.sources.facts import extract_facts, fact_tables
from symlattice.sources.groups import Groups
from symlattice.sources.store import SCHEMAS, GraphStore
from symlattice.sources.tree import hit_lines, scan_tree, source_lines
from symlattice.streaming import watch

BRIEF_ROWS, SUGGESTIONS = 40, 8


@dataclass
class View:
    """What is known of one symbol; ``found`` tells an answer from a miss, whatever the texts say."""

    found: bool
    name: str
    node: dict = field(default_factory=dict)
    snippet: str | None = None
    spine: list[str] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    heritage: list[str] = field(default_factory=list)
    blast: list[tuple[int, list[str]]] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    callees: list[str] = field(default_factory=list)
    routes: list[str] = field(default_factory=list)
    same_name: int = 0
    others: list[View] = field(default_factory=list)
    text_only: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)

    def gap(self) -> str | None:
        """Why this can't stand in for a text search."""
        if self.same_name > lookup.SAME_NAME_MOST:
            return f"{self.same_name} symbols share this name"
        if len(self.text_only) > lookup.TEXT_ONLY_MOST:
            return f"{len(self.text_only)} files mention it outside the graph"
        return None


class Engine:
    """One repository. ``store`` defaults to a folder inside it."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, os.path.realpath(root)
        self.store = GraphStore(spark, store or os.path.join(self.root, STORE_DIR))

    # -- building -------------------------------------------------------------------------------------------

    def is_dirty(self) -> bool:
        return bool(freshness.dirty(self.store.read("files"), scan_tree(self.spark, self.root)).first().dirty)

    def init(self) -> str:
        return self.ensure()

    def ensure(self, force: bool = False) -> str:
        """Bring the graph up to date: ``wrote``, ``skipped``, or ``busy`` if another process is at it."""
        with self.store.lock() as got:
            if not got:
                return "busy"
            self.store.set_meta(reindex_state="rebuilding")
            try:
                wrote = force or not self.store.exists() or self.is_dirty()
                if wrote:
                    self._write()
            finally:
                self.store.set_meta(reindex_state="idle")
            self.store.set_meta(indexed_head=git.head(self.root))
            return "wrote" if wrote else "skipped"

    def _write(self) -> None:
        files = scan_tree(self.spark, self.root, content=True)
        facts = scratch(extract_facts(files))
        t = fact_tables(facts)
        lines = scratch(source_lines(files.join(facts.select("path"), "path", "left_semi")))
        nodes, edges, attrs = build_graph(facts, t, lines, config.load_config(self.root))
        nodes, edges = scratch(nodes), scratch(edges)
        d_nodes, d_edges, d_attrs = derive.derived_rows(nodes, edges)
        top_node, top_edge = (nodes.agg(F.max("node_seq")).first()[0] or 0), (edges.agg(F.max("edge_id")).first()[0] or 0)
        d_nodes = ordered_cumsum(d_nodes.withColumn("one", F.lit(1)), ["kind", "id"], "one", "n").select(*d_nodes.columns, (F.col("n") + top_node + 1).alias("node_seq"))
        d_edges = ordered_cumsum(d_edges.withColumn("one", F.lit(1)), ["kind", "dst_id", "line", "src_id"], "one", "n").select(*d_edges.columns, (F.col("n") + top_edge + 1).alias("edge_id"))
        now = int(time.time() * 1000)
        stored = files.join(facts.select("path", "hash"), "path").select("path", "hash", "mtime_ms", "size", "language", F.lit(now).alias("indexed_at"))
        self.store.write(
            {
                "files": stored,
                "nodes": nodes.unionByName(d_nodes),
                "edges": edges.unionByName(d_edges),
                "bindings": t["bindings"],
                "node_attrs": attrs.unionByName(d_attrs),
                "vectors": search.hash_vectors(nodes),
                "lines": lines,
            }
        )
        self.store.set_meta(coverage="exhaustive")

    def watch(self, **options):
        """Keep the graph up to date until the query that is returned is stopped."""
        return watch_engines([self], **options)

    # -- asking ---------------------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        """One row: trust, coverage, resolve, files, nodes, edges."""
        files, nodes, edges = (self.store.read(t) for t in ("files", "nodes", "edges"))
        meta, head = self.store.meta(), git.head(self.root)
        text = lambda v: F.lit(v).cast("string")
        quality = banner.resolve_quality(edges, nodes).select(F.col("quality").alias("resolve"))
        row = banner.counts(files, nodes, edges).crossJoin(quality)  # one row each
        trust = banner.trust(F.col("files"), text(meta.get("reindex_state")), text(meta.get("indexed_head")), text(head))
        return row.select(trust.alias("trust"), F.lit(meta.get("coverage", "exhaustive")).alias("coverage"), "resolve", "files", "nodes", "edges")

    def banner(self) -> str:
        return banner.render(self.status().first().asDict())

    def search(self, query: str, limit: int = search.SEARCH_LIMIT) -> DataFrame:
        nodes, vectors = self.store.read("nodes"), self.store.read("vectors")
        return search.search_rows(nodes, search.hybrid_search(nodes, query, limit, vectors)).orderBy("rank")

    def search_text(self, query: str, label: str | None = None) -> str:
        mark = f"[{label}] " if label else ""
        rows = [f"{mark}{'★' if r.exported else ' '} {r.kind} {r.qualified_name}  {r.file_path}:{r.start_line}" for r in self.search(query).collect()]
        return "\n".join(rows) + "\n" if rows else f"{mark}no symbol matching `{query}`."

    def explore(self, name: str, detail: str = "full") -> View:
        nodes, edges, lines = (self.store.read(t) for t in ("nodes", "edges", "lines"))
        found = lookup.pick_symbol(nodes, name).collect()
        if not found:
            rows = self.search_text(name).splitlines()
            return View(False, name, suggestions=[r for r in rows if not r.startswith("no symbol")][:SUGGESTIONS])
        view = self._gather(found[0].asDict(), nodes, edges)
        if detail == "brief":
            if 1 < view.same_name <= lookup.SAME_NAME_MOST:
                rest = nodes.where((F.col("name") == name) & (F.col("id") != view.node["id"])).orderBy(F.desc("exported"), "file_path", "start_line").collect()
                view.others = [self._gather(r.asDict(), nodes, edges) for r in rest]
            view.text_only = [r.mention for r in lookup.text_only_mentions(lines, nodes, edges, name).orderBy("path").collect()]
        return view

    def _gather(self, node: dict, nodes: DataFrame, edges: DataFrame) -> View:
        one = self.spark.createDataFrame([(node["id"], 0)], "id string, seed_seq long")
        hops = graph.with_nodes(graph.blast_hops(edges, one), nodes)
        mark = lambda m: f"  ⟨{m}⟩" if m else ""
        path = self.store.read("lines").where(F.col("path") == node["file_path"])
        whole = path.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("text"))  # one file
        code = lookup.snippet(whole, node["file_path"], node["start_line"], node["end_line"]).collect()
        return View(
            True,
            node["name"],
            node,
            code[0].snippet if code else None,
            [r.spine for r in graph.spine(edges, nodes, one.select("id")).collect()],
            [r.asDict() for r in graph.members(edges, nodes, one).orderBy("start_line").collect()],
            [f"{r.kind} {r.label}" + ("" if r.resolved else "  ⟨unresolved⟩") for r in graph.heritage(edges, nodes, one).orderBy("kind").collect()],
            [(r.depth, list(r.rows)) for r in graph.blast_depths(hops).orderBy("depth").collect()],
            [f"{r.user}  {r.file_path}:{r.line}" for r in graph.uses(edges, nodes, one).orderBy("file_path", "line").collect()],
            [f"{r.label}  :{r.line}  [{r.reason}]{mark(r.mark)}" for r in graph.callees(edges, nodes, one).orderBy("line", "edge_id").collect()],
            [f"{r.kind} {r.qualified_name}" for r in graph.routes_touching(edges, nodes, one).orderBy("kind", "qualified_name").collect()],
            nodes.where(F.col("name") == node["name"]).count(),
        )

    def changes(self, spec: str = "unstaged", ref: str | None = None, diff: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
        """Changed symbols, affected ones, and whether something couldn't be mapped, for the tree's diff or a given one."""
        text = git.diff_text(self.root, spec, ref) if diff is None else diff
        hunks = scratch(changes.parse_hunks(git.diff_lines(self.spark, text)))
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        changed, hit, partial = changes.impact(nodes, edges, hunks)
        return changed.orderBy("file_path", "start_line"), hit.orderBy("depth", "file_path", "start_line"), bool(partial.first().partial)

    def fold(self, hits: str, head: int | None = None, cut: str | None = None, log: str | None = None, tag: str | None = None, strip: str | None = None) -> tuple[str, dict]:
        """Hit lines of this repository, folded by symbol, or the text as it came, and figures; with ``log`` a JSON line of them is appended."""
        out = fold.fold_text(hits, lambda: fold.fold(hit_lines(self.spark, hits), self.store.read("nodes")), head, cut, strip)
        return _logged(out, log, tag, head, cut)


def _logged(out: tuple[str, dict], log: str | None, tag: str | None, head: int | None, cut: str | None) -> tuple[str, dict]:
    if log and out[0]:
        with contextlib.suppress(OSError), open(log, "a", encoding="utf-8") as file:  # a log that can't be written costs no answer
            file.write(json.dumps({"ts": int(time.time() * 1000)} | fold.log_line(*out, tag, head, cut)) + "\n")
    return out


def nearest_root(path: str) -> str | None:
    """The closest folder above an existing path that has a store."""
    real = os.path.realpath(path)
    if not os.path.exists(real):
        return None
    while (above := os.path.dirname(real)) != real:
        real = above
        if os.path.exists(os.path.join(real, STORE_DIR, "_CURRENT")):
            return real
    return None


def fold_by_path(spark: SparkSession, hits: str, cwd: str, head: int | None = None, cut: str | None = None, log: str | None = None, tag: str | None = None, strip: str | None = None) -> tuple[str, dict]:
    """Hit lines folded by the symbols of whatever repositories their paths (from ``cwd``) lie in: each file's is the nearest with a store above it."""

    def folded() -> tuple[str | None, dict]:
        lines = hit_lines(spark, hits)
        written = [r.path for r in fold.parse_hits(lines).where("parsed").select("path").distinct().collect()]  # of at most 4 MiB of input
        files = [(p, root, os.path.relpath(os.path.realpath(os.path.join(cwd, p)), root)) for p in written if (root := nearest_root(os.path.join(cwd, p)))]
        known = spark.createDataFrame(files, "path string, root string, rel string")
        nodes = spark.createDataFrame([], SCHEMAS["nodes"])
        for root in sorted({root for _, root, _ in files}):
            own = known.where(F.col("root") == root).select("path", F.col("rel").alias("file_path"))
            found = GraphStore(spark, os.path.join(root, STORE_DIR)).read("nodes").join(F.broadcast(own), "file_path")  # the text's paths
            nodes = nodes.unionByName(found.withColumn("file_path", F.col("path")).drop("path"))
        return fold.fold(lines, nodes, known.select("path"))

    return _logged(fold.fold_text(hits, folded, head, cut, strip), log, tag, head, cut)


def build_graph(facts: DataFrame, t: dict[str, DataFrame], lines: DataFrame, cfg: resolve.ResolveConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (the last of those that repeat an id), edges and attributes from facts."""
    symbols, calls, bindings = scratch(t["symbols"]), t["calls"], scratch(t["bindings"])
    files = facts.select("path")
    modules = scratch(resolve.resolve_modules(bindings, files, cfg))
    found = scratch(routes.bind_handlers(routes.all_routes(lines), symbols))
    r_nodes, r_edges, attrs = routes.route_nodes(found)
    last = F.lit(1 << 60)
    every = symbols.withColumnRenamed("seq", "node_seq").unionByName(r_nodes.withColumn("node_seq", last + F.col("start_line")))
    nodes = every.groupBy("id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "id"]), F.struct("node_seq", "file_path")).alias("n")).select("id", "n.*")
    nodes = ordered_cumsum(nodes.withColumn("one", F.lit(1)), ["node_seq", "file_path", "id"], "one", "n").drop("node_seq", "one").withColumnRenamed("n", "node_seq")
    columns = ["order", *resolve.EDGE]
    sections = [
        r_edges,
        resolve.contains_edges(symbols),
        resolve.resolve_calls(calls, symbols, bindings, modules),
        resolve.resolve_heritage(t["heritage"], symbols, bindings, modules),
        resolve.resolve_refs(t["refs"], symbols, bindings, modules),
        routes.dispatch_edges(lines, calls, symbols),
    ]
    return nodes, resolve.all_edges([s.select(*columns) for s in sections]), attrs


def watch_engines(engines: list[Engine], checkpoint: str | None = None, **options):
    """Watch the folders of all ``engines``: a burst of changes in one rebuilds that one alone."""
    spark, by_root = engines[0].spark, {e.root: e for e in engines}
    checkpoint = checkpoint or f"{shared_dir(spark)}/symlattice/watch-{uuid.uuid4().hex}"
    return watch.watch_trees(spark, list(by_root), lambda root: by_root[root].ensure(), checkpoint, **options)


class GroupEngine:
    """Several repositories as one scope; every answer says whose it is, and no member is left out of the banner."""

    def __init__(self, spark: SparkSession, roots: list[str]):
        self.members = {os.path.basename(r): Engine(spark, r) for r in roots}

    @classmethod
    def of(cls, spark: SparkSession, registry: Groups, root: str, group: str | None = None) -> GroupEngine:
        return cls(spark, registry.scope(root, group))

    def ensure(self, force: bool = False) -> dict[str, str]:
        """What became of each member; a failure of one doesn't keep the others from being built."""
        done, failed = {}, {}
        for label, e in self.members.items():
            try:
                done[label] = e.ensure(force)
            except Exception as error:  # noqa: BLE001  reported together below
                failed[label] = error
        if failed:
            raise RuntimeError("; ".join(f"{k}: {v}" for k, v in failed.items()))
        return done

    def watch(self, **options):
        return watch_engines(list(self.members.values()), **options)

    def status(self) -> DataFrame:
        rows = None
        for label, e in self.members.items():
            one = e.status().withColumn("repo", F.lit(label))
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def banner(self) -> str:
        return banner.render_group(banner.merge(self.status()).first().asDict(), len(self.members))

    def search_text(self, query: str) -> str:
        return "\n".join(e.search_text(query, label).rstrip("\n") for label, e in self.members.items())

    def explore(self, name: str, detail: str = "full") -> dict[str, View]:
        return {label: e.explore(name, detail) for label, e in self.members.items()}

    def refusal(self, views: dict[str, View], name: str) -> str | None:
        """One member's gap is the group's; so are many mentions in members without the symbol."""
        for v in views.values():
            if v.found and v.gap():
                return v.gap()
        stray = sum(self.members[k].store.read("lines").where(lookup.has_word(F.col("line"), name)).select("path").distinct().count() for k, v in views.items() if not v.found)
        return f"{stray} files in other repos mention it" if stray > lookup.TEXT_ONLY_MOST else None

    def changes(self) -> dict[str, tuple[DataFrame, DataFrame, bool]]:
        return {label: e.changes() for label, e in self.members.items()}

"""Operators on small inputs with known answers."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from symlattice.functions import paths, text
from symlattice.operators import banner, changes, components, derive, fold, graph, labels, lookup, resolve, search
from symlattice.plans.prefix import ordered_cumsum
from symlattice.sources import config, python_source, script_source, tree
from symlattice.streaming import watch

EDGE = "edge_id long, src_id string, dst_id string, kind string, raw_name string, resolved boolean, conf string, reason string, file_path string, line long"
NODE = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, exported boolean, signature string, node_seq long"


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, "calls", b or "?", b is not None, c, "same-file", "f.ts", i) for i, (a, b, c) in enumerate(pairs)], EDGE)


def nodes(spark, names):
    return spark.createDataFrame([(n, "function", n, n, "f.ts", i * 10 + 1, i * 10 + 9, True, f"{n}()", i) for i, n in enumerate(names)], NODE)


def test_blast_of_a_chain_and_a_diamond(spark):
    seed = spark.createDataFrame([("a", 0)], "id string, seed_seq long")
    chain = edges(spark, [("b", "a", "strong"), ("c", "b", "weak")])
    assert {(r.src_id, r.depth) for r in graph.blast_hops(chain, seed).collect()} == {("b", 1), ("c", 2)}
    assert {r.src_id for r in graph.blast_hops(chain, seed, 1).collect()} == {"b"}
    diamond = edges(spark, [("b", "a", "strong"), ("c", "a", "strong"), ("d", "c", "strong"), ("d", "b", "weak"), ("a", "d", "strong")])
    rows = {r.src_id: r for r in graph.blast_hops(diamond, seed).collect()}
    assert set(rows) == {"b", "c", "d"} and rows["d"].depth == 2 and rows["d"].conf == "weak"
    named = graph.with_nodes(graph.blast_hops(chain, seed), nodes(spark, ["a", "b"])).collect()
    assert {r.src_id: r.name for r in named} == {"b": "b", "c": None}


def test_spine_stops_at_the_second_unnamed_hop(spark):
    e = edges(spark, [("a", "b", "strong"), ("b", "c", "strong"), ("c", None, "weak")])
    got = graph.spine(e, nodes(spark, ["a", "b", "c"]), spark.createDataFrame([("a",)], "id string")).first()
    assert got.spine == "a → b  `b` → c  `c` → ?  `?`" and got.n_hops == 3


def test_components_and_communities(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for p in pairs for x in p}

    triangle = [("a", "b", "strong"), ("b", "c", "strong"), ("c", "a", "strong"), ("e0", "e1", "strong"), ("e1", "e2", "strong"), ("e2", "e3", "weak")]
    n = nodes(spark, ["a", "b", "c", "d", "e0", "e1", "e2", "e3"])
    _, calls = derive.derive_input(n, edges(spark, triangle))
    clusters, members = derive.communities(calls, n)
    assert [(r["size"], r.conf, r.hub) for r in clusters.collect()] == [(3, "strong", "a")]
    assert {r.id for r in members.collect()} == {"a", "b", "c"}
    flow = derive.flows(calls).collect()
    assert [(r.steps, r.conf) for r in flow] == [(["e0", "e1", "e2", "e3"], "weak")]


def test_label_propagation_by_component_equals_the_whole(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(55)})
    pairs = [(a, b) for a, b in pairs if a != b]
    around = {}
    for a, b in pairs:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    calls = spark.createDataFrame([(a, b) for a, b in pairs], "src_id long, dst_id long")
    assert {r.id: r.label for r in derive.label_propagation(calls).collect()} == derive.propagate(around)


def _link_batches(pairs, rows):
    ends = np.array(sorted([*pairs, *((b, a) for a, b in pairs)]))
    for i in range(0, len(ends), rows):
        part = ends[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int64)), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["task", "u", "v"])


def test_sweeps_over_chunks_equal_one_node_after_the_other(monkeypatch):
    rng = random.Random(5)
    for trial in range(60):
        n = rng.choice([5, 30, 200])
        pairs = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(rng.choice([n, 4 * n]))}
        pairs |= {(0, i) for i in range(1, n)} if trial % 3 == 0 else {(i, i + 1) for i in range(n)}
        pairs = sorted((a, b) for a, b in pairs if a != b)
        around = {}
        for a, b in pairs:
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
        ids = sorted(around)
        number = {x: i for i, x in enumerate(ids)}
        monkeypatch.setattr(labels, "CHUNK", rng.choice([1, 4, 16, 100, 65536]))
        monkeypatch.setattr(labels, "ATTEMPTS", rng.choice([0, 1, 2, 32]))
        packed = labels.pack(_link_batches([(number[a], number[b]) for a, b in pairs], rng.choice([1, 7, 1000])))
        got = {ids[r["n"]]: ids[r["label"]] for out in labels.sweeps(10)(packed) for r in out.to_pylist()}
        assert got == derive.propagate(around)


def test_sweeps_hold_nodes_and_not_links():
    n = 1500  # each linked with all others: 2.2 million link ends, 18 MB of numbers alone

    def packed():
        for u in range(n):
            row = pa.RecordBatch.from_arrays([pa.array(np.zeros(n - 1, np.int64)), pa.array(np.full(n - 1, u)), pa.array(np.delete(np.arange(n), u))], ["task", "u", "v"])
            yield from labels.pack(iter([row]))

    tracemalloc.start()
    out = [x for batch in labels.sweeps(10)(packed()) for x in batch.column("label").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(out)) == 1 and len(out) == n and peak < 12e6


def test_label_propagation_deals_components_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(derive, "LEAST_TASK_NODES", 1)
    rng = random.Random(3)
    pairs = sorted({(f"n{a:03}", f"n{b:03}") for a, b in (sorted((rng.randrange(300), rng.randrange(300))) for _ in range(260)) if a != b})
    around = {}
    for a, b in pairs:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    calls = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs[:50]), ("n000", "n000"), ("x", "x"), (None, "n001")], "src_id string, dst_id string")
    got = [(r.id, r.label) for r in derive.label_propagation(calls).collect()]
    assert len(got) == len(around) and dict(got) == derive.propagate(around)
    assert derive.label_propagation(calls.limit(0)).count() == 0


def test_running_sum_over_a_total_order(spark):
    rows = [(random.Random(i).choice("ab"), i, i % 5) for i in range(500)]
    got = {r.k: r.before for r in ordered_cumsum(spark.createDataFrame(rows, "g string, k long, v long"), ["g", "k"], "v", "before").collect()}
    total = 0
    for _, k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_hunks(spark):
    diff = "diff --git a/x b/x\n--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n@@ -20,3 +22,0 @@\n--- a/y.ts\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- a/z.ts\n+++ b/z.ts\n@@ broken @@\n"
    lines = spark.createDataFrame(list(enumerate(diff.split("\n"))), "ord long, line string")
    rows = [(r.file_path, r.start, r.end, r.unmappable) for r in changes.parse_hunks(lines).collect()]
    assert set(rows) == {("x.ts", 3, 6, False), ("x.ts", 12, 12, False), (None, None, None, True), ("z.ts", None, None, True)}


def test_merge_and_trust(spark):
    b = spark.createDataFrame([("fresh", "exhaustive", "ok", 1, 2, 3), ("stale", "sampled", "ok", 1, 1, 1)], "trust string, coverage string, resolve string, files long, nodes long, edges long")
    assert tuple(banner.merge(b).first()) == ("stale", "sampled", "ok", 2, 3, 4)
    assert banner.merge(b.where("false")).first().trust == "missing"


def test_text_functions(spark):
    doc = spark.createDataFrame([("getUserById user_id HTTPServer2x",)], "d string")
    row = doc.select(text.tokens(F.col("d")).alias("t"), text.trigrams(F.col("d")).alias("g"), text.fnv_bucket(F.lit("abc")).alias("b"), text.fnv_bucket(F.lit("é")).alias("e")).first()
    assert row.t == ["get", "user", "by", "id", "user", "id", "httpserver2x"] and row.g[:2] == ["get", "etu"] and row.b == 75
    h = 0xCBF29CE484222325
    for x in "é".encode():
        h = (h ^ x) * 0x100000001B3 % (1 << 64)
    assert row.e == h % 256
    lines = spark.createDataFrame([("the cat",), ("then",), ("_the",), ("(the)",), ("éthe",)], "l string")
    assert [r.l for r in lines.where(text.has_word(F.col("l"), "the")).collect()] == ["the cat", "(the)"]


def test_paths(spark):
    rows = spark.createDataFrame([("a/./b/../c.ts",), ("../x.TSX",), ("src/.git/x.py",), ("m.d.mts",), ("n.rs",)], "p string")
    got = rows.select(paths.normalize(F.col("p")).alias("n"), paths.lang_of(F.col("p")).alias("l"), paths.tracked(F.col("p")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("a/c.ts", "ts", True), ("x.TSX", "tsx", True), ("src/.git/x.py", "py", False), ("m.d.mts", "ts", True), ("n.rs", None, False)]


def test_modules(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.tsx",), ("packages/core/src/index.ts",), ("src/u/v.js",), ("base/k.ts",)], "path string")
    asked = spark.createDataFrame([("src/m.ts", s) for s in ("./a", "./a.js", "./lib", "../src/a", "@/u/v", "core", "core/src/index", "k", "ext", "./none")], "file_path string, source_module string")
    cfg = resolve.ResolveConfig({"@/*": ["../src/*"]}, "base", {"core": "packages/core"})
    got = {r.source_module: r.target for r in resolve.resolve_modules(asked, files, cfg).collect()}
    assert got == {"./a": "src/a.ts", "./a.js": "src/a.ts", "./lib": "src/lib/index.tsx", "../src/a": "src/a.ts", "@/u/v": "src/u/v.js", "core": "packages/core/src/index.ts", "core/src/index": "packages/core/src/index.ts", "k": "base/k.ts", "ext": None, "./none": None}


def test_exports_follow_barrels_in_order(spark):
    symbols = spark.createDataFrame([("b#x", "function", "x", "b.ts", True, 1), ("c#x", "function", "x", "c.ts", True, 2), ("c#only", "class", "Only", "d.ts", True, 3)], "id string, kind string, name string, file_path string, exported boolean, seq long")
    binds = [(1, "a.ts", "*", "./e", "*", "star-reexport"), (2, "a.ts", "*", "./b", "*", "star-reexport"), (3, "e.ts", "*", "./c", "*", "star-reexport"), (4, "a.ts", "y", "./b", "x", "named-reexport"), (5, "f.ts", "D", "./d", "default", "named-reexport"), (6, "loop.ts", "*", "./loop", "*", "star-reexport")]
    bindings = spark.createDataFrame(binds, "bind_seq long, file_path string, local_name string, source_module string, imported_name string, kind string")
    files = spark.createDataFrame([(f"{x}.ts",) for x in ("a", "b", "c", "d", "e", "f", "loop")], "path string")
    asked = spark.createDataFrame([("a.ts", "x"), ("a.ts", "y"), ("f.ts", "D"), ("d.ts", "default"), ("loop.ts", "z"), ("e.ts", "x")], "file string, want string")
    got = {(r.file, r.want): r.id for r in resolve.resolve_exports(asked, symbols, bindings, resolve.resolve_modules(bindings, files)).collect()}
    assert got == {("a.ts", "x"): "b#x", ("a.ts", "y"): "b#x", ("f.ts", "D"): "c#only", ("d.ts", "default"): "c#only", ("e.ts", "x"): "c#x"}


def test_lookup_and_gap(spark):
    n = nodes(spark, ["f", "g"]).withColumn("file_path", F.concat("name", F.lit(".ts")))
    lines = spark.createDataFrame([("f.ts", 1, "function f"), ("z.ts", 3, "f = 1"), ("z.ts", 5, "(f)"), ("y.ts", 1, "of fg")], "path string, line_no long, line string")
    e = edges(spark, [("g", "f", "strong")])
    assert [r.mention for r in lookup.text_only_mentions(lines, n, e, "f").collect()] == ["z.ts:3  (+1 lines)"]
    assert tuple(lookup.grep_gap(lines, n, e, "f").first()) == (1, 1, None)
    files = spark.createDataFrame([("p", "é" * 30 + "\nb\nc")], "path string, text string")
    assert lookup.snippet(files, "p", 1, 2, 11).first().snippet == "é" * 5 + "\n…"


def test_search_falls_back_and_fuses(spark):
    n = nodes(spark, ["getUser", "setUser", "other"])
    assert [r.id for r in search.text_ranked(n, "etUse", 5).orderBy("rank").collect()] == ["getUser", "setUser"]
    assert [r.id for r in search.text_ranked(n, "other", 5).collect()] == ["other"]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    assert [r.id for r in search.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.id for r in search.hybrid_search(n, "user").orderBy("rank").collect()][-1] == "other"


def test_tail_view_and_cut():
    assert fold.parse_cut("1,3-4,6-,-2") == [(1, 1), (3, 4), (6, None), (1, 2)] and fold.parse_cut("0") is None and fold.parse_cut("4-2") is None and fold.parse_cut("x") is None
    assert fold.tail_view("abcdef\nxyz\nq\n", 2, "2-3") == "bc\nyz\n"


def test_debounce():
    events = pd.DataFrame([("r", "a", 0), ("r", "b", 100), ("r", "a", 900), ("r", "a", 5000), ("r", "b", 5010), ("r", "c", 5020), ("r", "d", 6900)], columns=["root", "path", "ms"])
    events = pd.concat([events, events.assign(root="s")], ignore_index=True)
    want = [[r, *x] for r in "rs" for x in ([2, 0, 300], [1, 900, 1200], [4, 5000, 7000])]
    for size in (1, 3, 20):  # a batch of events may end anywhere
        got = pd.concat(list(watch.debounce_pass(events.iloc[i : i + size] for i in range(0, len(events), size))))
        assert got.values.tolist() == want


def test_events_belong_to_the_first_root_that_wants_them(spark):
    paths = ["/w/a/x.ts", "/w/a/sub/y.py", "/w/a/notes.txt", "/w/b.ts", "/w/ab/x.ts", "/w/a/.git/h.ts", "/w/a/gen/z.ts", "/v/z.ts", "x.ts", None]
    events = spark.createDataFrame([(p,) for p in paths], "path string")
    found = lambda *a: {(r.root, r.path) for r in watch.attribute(events, *a).collect()}
    assert found(["/w/a", "/w/"]) == {("/w/a", "x.ts"), ("/w/a", "sub/y.py"), ("/w/a", "gen/z.ts"), ("/w", "b.ts"), ("/w", "ab/x.ts")}
    assert found(["/w", "/w/a"], {"/w": [("^a/gen/", True)]}) == {("/w", "a/x.ts"), ("/w", "a/sub/y.py"), ("/w/a", "gen/z.ts"), ("/w", "b.ts"), ("/w", "ab/x.ts")}
    assert found([]) == set()


def test_streaming_debounce(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")
    spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a")], "root string, path string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("root string, path string").json(source)
    q = watch.debounced(stream).writeStream.format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            rows = spark.sql("select * from flushes").collect()
            if len(rows) == 2:
                break
        assert {(r.root, r.n_paths) for r in rows} == {("r", 2), ("s", 1)}
    finally:
        q.stop()


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "src", "paths": {"a/*": ["x/*"], "b": ["y"]}}}')
    (tmp_path / "tsconfig.json").write_text('{ /* c */ "extends": "./base.json", // d\n "compilerOptions": {"paths": {"b": ["z"],},},}')
    (tmp_path / "package.json").write_text('{"name": "top", "workspaces": {"packages": ["pk/*"]}}')
    (tmp_path / "pk" / "one").mkdir(parents=True)
    (tmp_path / "pk" / "one" / "package.json").write_text('{"name": "@s/one"}')
    cfg = config.load_config(str(tmp_path))
    assert cfg.paths == {"a/*": ["x/*"], "b": ["z"]} and cfg.base_url == "src" and cfg.packages == {"top": ".", "@s/one": "pk/one"}
    assert config.parse_jsonc('{"u": "http://x", "v": [1,2,],}') == {"u": "http://x", "v": [1, 2]}


def test_ignore_files(tmp_path):
    for name in ("a.ts", "build/x.ts", "src/build/y.ts", "src/gen/z.ts", "src/keep.ts", "src/no.ts", "_priv.py", ".hid/q.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("build/\nsrc/gen\n")
    (tmp_path / "src" / ".gitignore").write_text("*.ts\n!keep.ts\n")
    assert [p for p, _, _ in tree.walk(str(tmp_path)) if not p.endswith(".gitignore")] == [".hid/q.ts", "_priv.py", "a.ts", "src/keep.ts"]


def test_python_facts():
    f = python_source.extract("m.py", "import a.b\nfrom .c import *\n@dec(1)\nclass K(B, m.C, meta=1):\n    def go(self):\n        def inner(): pass\n        inner(); self.x()\nasync def top(a: int): return K()\n")
    assert [(s["kind"], s["qualified_name"], s["start_line"], s["exported"]) for s in f.symbols] == [("class", "K", 4, True), ("method", "K.go", 5, False), ("function", "inner", 6, False), ("function", "top", 8, True)]
    assert [(c["name"], c["member"]) for c in f.calls] == [("dec", False), ("inner", False), ("x", True), ("K", False)]
    assert [b["raw_name"] for b in f.heritage] == ["B", "m.C"] and [b["kind"] for b in f.bindings] == ["namespace", "star-reexport"]
    assert f.symbols[3]["signature"] == "async def top(a" and not python_source.extract("m.py", "def (").symbols


def test_script_facts():
    src = 'import D, { a as b } from "./m";\nexport * as ns from "./n";\nexport const f = async (x) => { b(x); D.go(); };\nclass A extends B implements C<E> {\n  m() { return new D(f); }\n}\nconst t = `x ${b(1)} y`;\ninterface I { k(v: D): void }\nfunction g({ p }) { return <A p={p} />; }\n'
    f = script_source.extract("x.tsx", src)
    assert [(s["kind"], s["qualified_name"], s["exported"]) for s in f.symbols] == [("function", "f", True), ("class", "A", False), ("method", "A.m", False), ("const", "t", False), ("interface", "I", False), ("function", "g", False)]
    assert [(c["name"], c["member"], c["line"]) for c in f.calls] == [("b", False, 3), ("go", True, 3), ("b", False, 7)]
    assert [(h["kind"], h["raw_name"]) for h in f.heritage] == [("extends", "B"), ("implements", "C"), ("implements", "E")]
    assert {(r["name"], r["line"]) for r in f.refs} >= {("D", 5), ("f", 5), ("D", 8), ("A", 9)}
    assert [(b["local_name"], b["imported_name"], b["kind"]) for b in f.bindings] == [("D", "default", "default"), ("b", "a", "named"), ("ns", "*", "namespace-reexport")]
    assert not script_source.extract("x.js", "class A extends B {}").heritage

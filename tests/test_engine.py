import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from symlattice.plans import render
from symlattice.plans.engine import Engine, GroupEngine, fold_by_path
from symlattice.sources.groups import Groups


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as file:
            file.write(text)


def git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.email=a@b.c", "-c", "user.name=n", *args], check=True, capture_output=True)


TREE = {
    "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}}',
    "src/a.ts": "export function helper(x: number) {\n  return x;\n}\n",
    "src/b.ts": 'import { helper } from "./a";\nexport function caller() {\n  return helper(1);\n}\n',
    "src/index.ts": 'export * from "./a";\n',
    "src/c.ts": 'import { helper as h } from "@/index";\nimport ext from "lib";\nexport class Box {\n  open() { h(2); ext(); this.open(); }\n}\n',
    "src/server.ts": 'app.get("/ping", pong);\nfunction pong() { caller(); }\n',
    "src/note.ts": "// the helper is mentioned here\n",
    "tool.py": "from os import path\n\ndef helper_py():\n    return path.join('a')\n",
    "pkg/__init__.py": "def dunder():\n    pass\n",
    "node_modules/x.ts": "export function ignoredFn() {}\n",
    ".gitignore": "node_modules/\n.symlattice/\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    write(root, TREE)
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    e = Engine(spark, root)
    assert e.ensure() == "wrote" and e.ensure() == "skipped"
    return e


def test_status_is_fresh_until_the_commit_moves(engine):
    row = engine.status().first()
    assert (row.trust, row.coverage, row.resolve, row.files) == ("fresh", "exhaustive", "ok", 8)
    assert engine.banner().startswith("trust: fresh · coverage: exhaustive · resolve: ok")


def test_edges_have_the_right_confidence(engine):
    rows = {(r.src_id.split("#")[1], r.raw_name, r.reason, r.resolved) for r in engine.store.read("edges").where("kind = 'calls'").collect()}
    assert ("caller@2", "helper", "import-binding", True) in rows
    assert ("open@4", "h", "import-binding", True) in rows  # through an alias and a barrel
    assert ("open@4", "ext", "external-import", False) in rows
    assert ("pong@2", "caller", "unique-global", True) in rows
    assert not engine.store.read("nodes").where("name = 'ignoredFn'").count()


def test_explore(engine):
    v = engine.explore("helper")
    assert v.found and v.node["file_path"] == "src/a.ts" and v.snippet.startswith("export function helper")
    depths = dict(v.blast)
    assert any("caller" in r for r in depths[1]) and any("Box.open" in r for r in depths[1]) and any("pong" in r for r in depths[2])
    text = render.explore(v)
    assert text.index("call-path spine") < text.index("blast radius") < text.index("calls →") < text.index("routes")
    brief = engine.explore("helper", "brief")
    assert any(m.startswith("src/note.ts:1") for m in brief.text_only) and "callers ←" in render.explore(brief, "brief")
    missing = engine.explore("nothingLikeIt")
    assert not missing.found and "no symbol named" in render.explore(missing)


def test_routes_and_members(engine):
    v = engine.explore("pong")
    assert any("GET /ping" in r for r in v.routes)
    assert [m["name"] for m in engine.explore("Box").members] == ["open"]
    assert engine.store.read("node_attrs").where("key = 'method' and value = 'GET'").count() == 1


def test_search(engine):
    names = [r.name for r in engine.search("helper").collect()]
    assert names[0] in ("helper", "helper_py") and "helper" in names
    assert "helper" in engine.search_text("helper")


def test_changes_of_an_edit(engine):
    path = os.path.join(engine.root, "src/a.ts")
    with open(path, "w") as file:
        file.write(TREE["src/a.ts"].replace("return x;", "return x + 1;"))
    changed, affected, partial = engine.changes()
    assert [r.name for r in changed.collect()] == ["helper"] and not partial
    assert {(r.depth, r.name) for r in affected.collect()} == {(1, "caller"), (1, "open"), (2, "pong")}
    assert "## changed" in render.changed(changed.collect(), affected.collect(), partial)
    assert engine.is_dirty()
    write(engine.root, {"src/a.ts": TREE["src/a.ts"]})


def test_fold(engine):
    hits = "".join(f"src/c.ts:{4 if i % 2 else 3}:some text with helper in it number {i}\n" for i in range(40))
    text, stats = engine.fold(hits)
    assert stats["hits"] == 40 and "method open" in text and len(text) < len(hits)
    assert engine.fold("src/c.ts:4:x\n") == ("src/c.ts:4:x\n", {"reason": "small"})
    assert engine.fold("no hit line at all\n" * 60)[1] == {"reason": "unparsed"}


def test_fold_takes_the_nearest_store_of_each_path(spark, tmp_path):
    outer, inner = str(tmp_path / "o"), str(tmp_path / "o/inner")
    write(outer, {"a.py": "def first():\n    x = 1\n    return x\n"})
    write(inner, {"b.py": "def second():\n    x = 2\n    return x\n", "c.py": "# x\n"})
    GroupEngine(spark, [outer, inner]).ensure()
    write(str(tmp_path), {"loose.py": "x\n", "o/notes.txt": "x\n"})
    hits = "".join(f"{p}:{n}:a line\x0b with x {i}\n" for i in range(20) for p, n in (("o/a.py", 2), ("o/inner/b.py", 3), ("o/inner/c.py", 1), ("loose.py", 1), ("o/notes.txt", 1), ("gone.py", 9)))
    log = str(tmp_path / "log")
    text, stats = fold_by_path(spark, hits, str(tmp_path), log=log, tag="t")
    assert text.splitlines()[0].startswith("fold: 120 hits in 6 files") and stats["symbols"] == 4
    # files of a repository that has no symbol for them are at its top level; files of no repository keep their first lines
    body = text[text.index("\n") + 1 :].replace("a line\x0b with", "…")
    assert "o/a.py\n  1-3 function first ×20" in body and "o/inner/b.py\n  1-3 function second ×20" in body
    assert "o/inner/c.py\n  (top level) ×20" in body and "o/notes.txt\n  (top level) ×20" in body
    assert "loose.py\n  L1: " in body and "gone.py\n  L9: " in body and body.count("+17 more") == 2
    one = "".join(f"o/a.py:2:some text {i}\n" for i in range(10))
    assert fold_by_path(spark, one, str(tmp_path), log=log, strip="o/a.py") == (one.replace("o/a.py:", ""), {"reason": "small"})
    assert fold_by_path(spark, hits, str(tmp_path), head=2, log=log)[1] == {"reason": "small"}
    assert fold_by_path(spark, hits, str(tmp_path / "none"))[1] == {"reason": "no-graph"} and fold_by_path(spark, "", "/") == ("", {"reason": "empty"})
    logged = [json.loads(x) for x in open(log)]
    assert [(x.get("tag"), x["folded"], x.get("pass")) for x in logged] == [("t", True, None), (None, False, "small"), (None, False, "small")]
    assert logged[0]["hits"] == 120 and logged[0]["raw_chars"] == len(hits.encode()) and logged[1]["raw_chars"] == len(one) - 70 and all("ts" in x for x in logged)


def test_lock_and_reading_never_create(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "none"))
    assert not e.store.exists() and e.store.read("nodes").count() == 0 and not os.path.exists(e.store.path)
    assert e.status().first().trust == "missing"
    with e.store.lock() as first, e.store.lock() as second:
        assert first and not second


def test_groups(spark, engine, tmp_path):
    a, b = str(tmp_path / "ws/a"), str(tmp_path / "ws/b")
    write(a, {"x.py": "def shared():\n    pass\n"})
    write(b, {"y.py": "def shared():\n    return 1\n\ndef other():\n    return shared()\n"})
    groups = Groups(str(tmp_path / "groups.json"))
    groups.add("g", a)
    groups.add("g", b)
    groups.add("g", b)
    assert Groups(groups.path).roots("g") == [os.path.realpath(a), os.path.realpath(b)]
    assert groups.scope(str(tmp_path / "ws")) == groups.roots("g") and groups.scope(a) == [os.path.realpath(a)]
    with pytest.raises(ValueError):
        groups.roots("unknown")
    g = GroupEngine.of(spark, groups, str(tmp_path / "ws"))
    assert g.ensure() == {"a": "wrote", "b": "wrote"}
    views = g.explore("shared")
    assert all(v.found for v in views.values()) and g.refusal(views, "shared") is None
    assert "[group: 2 repos]" in g.banner() and "[a] " in g.search_text("shared")
    assert g.status().where(F.col("repo") == "b").first().nodes >= 2


def test_watch_rebuilds_what_changed(spark, tmp_path):
    import time

    roots = [str(tmp_path / "one"), str(tmp_path / "two")]
    for root in roots:
        write(root, {"a.py": "def first():\n    pass\n", ".gitignore": "gen/\n"})
    group = GroupEngine(spark, roots)
    group.ensure()
    said = []
    query = group.watch(checkpoint=str(tmp_path / "cp"), interval="200 milliseconds", report=said.append)
    try:
        for _ in range(60):  # the first look at the folders is what later ones are held against
            time.sleep(0.5)
            if "Waiting" in query.status["message"]:
                break
        write(roots[1], {"b.py": "def second():\n    pass\n", "gen/c.py": "def third():\n    pass\n", "notes.txt": "x"})
        for _ in range(120):
            time.sleep(0.5)
            if group.members["two"].store.read("nodes").where("name = 'second'").count():
                break
        assert query.exception() is None
        assert group.members["two"].store.read("nodes").where("name = 'second'").count() == 1
        assert [x for x in said if x.startswith("↻")] == ["↻ 1 file changed in two → ensure"]
    finally:
        query.stop()

"""Which searches are lookups of names, and what of a shell command can be answered or folded."""

import os
import subprocess

import pytest

from symlattice.plans import intent, shell

R = "/r"


@pytest.mark.parametrize(
    ("pattern", "names"),
    [
        (r"\bPoint\b", ["Point"]), (r"^Point\(", ["Point"]), ("export default async function load(", ["load"]), ("type A|interface A", ["A"]), (r"A\|B", ["A", "B"]), (r"(A|B)\(", ["A", "B"]),
        ("todo", None), ("a.b", None), ("A|B|C|D|E", None), ("A.*B", None), ("", None), ("const x =", ["x"]), (r"x\s*=", ["x"]),
    ],
)
def test_names_of_patterns(spark, pattern, names):
    assert intent.names_in(pattern) == names
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(pattern,)], "p string").select(intent.names_column(F.col("p"))).first()[0] == names


def shape(text):
    found = intent.lookup_of(text, R)
    return found and ("|".join(found.names), found.folder)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("rg load", ("load", R)), ("grep -rn Point lib/", ("Point", "/r/lib")), ("cd /x && rg Point", ("Point", "/x")), ("rg -t py Point", ("Point", R)), ("rg -nw Point", ("Point", R)),
        ("rg -g '*.ts' Point", ("Point", R)), ("rg -g '*.txt' Point", None), ("grep -rn --include=*.css Point .", None), ("grep -rn --include='*.{ts,tsx}' Point .", ("Point", "/r")),
        ("rg -i Point", None), ("rg -x Point", None), ("rg -e Point", None), ("rg --count Point", None), ("rg Point | head", None), ("rg Point nowhere elsewhere", None), ("ls Point", None),
        ("rg -t sql Point", None), ("grep -rn -A 3 Point lib", ("Point", "/r/lib")), ('grep -rn "$P" lib', None), ("grep -rn Point $D", None), ('grep -rn Point "a/(b)/c"', ("Point", "/r/a/(b)/c")),
        ("cd x; rg Point", None), ("rg", None), ("", None),
    ],
)
def test_one_command(text, want):
    assert shape(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "echo '== a; b =='; rg -n X lib && grep -rn 'x|y' . || true", "cd /x && grep -rn X lib 2>&1 | head -5\nls", "f=$(rg -l \"a; b\" lib | head -1); echo \"$(date; ls)\" && (cd y; ls); rg X",
        "cat <<'END' | wc -l; echo x\n;; && rg X\nEND\nrg X", "a `b; c` \\; d", "cat <<-E\n\tbody\n\tE\nls", "", "x=\"a 'b\" ; y",
    ],
)
def test_a_chain_is_the_command_again(text):
    assert "".join(p.text + p.separator for p in shell.chain(text)) == text


@pytest.mark.parametrize("text", ["echo $(rg X", "rg X &", "cat <<E\nX", "echo 'open", 'echo "open', "echo `open", "(a; b", "a )"])
def test_what_is_not_closed_is_not_read(text):
    with pytest.raises(shell.Unreadable):
        shell.chain(text)
    assert intent.plan_of(text, R) is None and intent.lookup_of(text, R) is None and intent.fold_of(text) is None


@pytest.mark.parametrize(
    ("text", "names", "only"),
    [
        ("rg X lib | head -30", ["X"], True), ('cd /x && grep -rn "X" lib --include=*.ts 2>/dev/null | head -n 20', ["X"], True), ("echo == ; grep -rn X lib; rg Y", ["X", "Y"], False),
        ("rg X lib | grep -v test | head", ["X"], True), ("grep -rn X lib | grep -v '[.]test[.]' | grep -vE \"spec|mock\"", ["X"], True), ("rg -l X lib | sort -u | wc -l", ["X"], True),
        ("grep -rn X lib | cut -d':' -f1 | uniq", ["X"], True), ("rg X lib | sort -k2", None, None), ("rg X lib | grep import", None, None), ("rg X lib > out.txt", None, None), ("rg X lib | wc -c", None, None),
        ("rg X lib | awk '{print $1}'", None, None), ("git grep -n X main", None, None), ("cat a | grep X", None, None), ("echo $(rg X)", None, None), ("cat <<E\nrg X\nE", None, None),
        ("f=$(rg -l Y lib | head -1); rg X lib", ["X"], False), ('d="lib/a b"\nrg X "$d"', ["X"], False), ("d=$(pwd); rg X $d", None, None), ("for d in a b; do rg X $d; done", None, None), ("cd $HOME; rg X", None, None),
        ("rg X lib | cut -c1-9 > o", None, None), ("V=1 rg X", None, None), ("rg -i X; ls", None, None),
    ],
)
def test_plans(text, names, only):
    plan = intent.plan_of(text, R, lambda d: None)
    assert (plan and ["|".join(x.names) for _, x in plan.hits], plan and plan.only) == (names, only)


def test_plans_follow_folders_and_variables():
    assert intent.plan_of("cd /x; rg X sub; ls", R).hits[0][1].folder == "/x/sub"
    assert intent.plan_of('d="lib/a b"; rg X "$d"', R).hits[0][1].folder == "/r/lib/a b"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("rg -n X lib", ("rg -n X lib", "", None)), ("grep -rn 'a|b' lib 2>/dev/null | head -20", ("grep -rn 'a|b' lib 2>/dev/null", "| head -20", None)), ("rg -n X $D", ("rg -n X $D", "", None)),
        ('grep -rn "x > y (z)" lib | cut -c1-170 | head', ('grep -rn "x > y (z)" lib', "| cut -c1-170 | head", None)), ("grep -n X a.ts", ("grep -n X a.ts", "", "a.ts")), ("grep -n X *.ts", ("grep -n X *.ts", "", None)),
        ("grep -nE 'a|b' $F | head -4", ("grep -nE 'a|b' $F", "| head -4", "$F")), ("grep -n -m 5 X a.ts", ("grep -n -m 5 X a.ts", "", None)), ("rg -l X", None), ("grep -rc X lib", None), ("rg -on X", None), ("rg -C3 X", None),
        ("rg --json X", None), ("rg X -r Y", None), ("rg X | wc -l", None), ("rg X | cut -d: -f1", None), ("rg X | sort", None), ("rg X > o", None), ("rg X | head > o", None), ("rg X $(cat l)", None), ("cat a | grep X", None), ("git grep X", None),
    ],
)
def test_folds(text, want):
    fold = intent.fold_of(text)
    assert (fold and (fold.head, fold.tail, fold.file)) == want


@pytest.mark.parametrize(
    ("tail", "want"),
    [("", (None, None)), ("| head -30", (30, None)), ("| head", (10, None)), ("| head -n 40", (40, None)), ("| head -n -5", (None, None)), ("| cut -c1-150 | head -40", (40, "1-150")), ("| head -50 | head -20", (20, None)), ("| cut -c 1-80", (None, "1-80"))],
)
def test_limits(tail, want):
    assert intent.Fold("", tail, None).limits() == want


def test_tool_lookups():
    assert intent.tool_lookup({"pattern": "X", "path": "lib"}, R) == intent.Lookup(["X"], "/r/lib")
    for other in ({"-i": True}, {"multiline": True}, {"output_mode": "count"}, {"type": "sql"}, {"glob": "*.md"}, {"pattern": "X.*Y"}):
        assert intent.tool_lookup({"pattern": "X"} | other, R) is None
    assert intent.tool_lookup({"pattern": "X", "glob": "**/*.{js,ts}", "type": "py"}, R)


def test_sessions(tmp_path):
    os.mkdir(tmp_path / "lib")
    os.mkdir(tmp_path / "app")
    (tmp_path / "lib" / "a.ts").write_text("X\nhit\n")
    cwd = str(tmp_path)
    known = intent.Session(lambda n: f"trust: fresh\n\n## function `{n}`\n" if n in "XY" else None, lambda d: cwd if d.startswith(cwd) else None)
    ask = lambda text: known.decide({"tool": "shell", "input": {"command": text}, "cwd": cwd})
    found = ask("rg 'X|Y'")["answer"]
    assert found.count("## ") == 2 and found.count("trust:") == 1
    assert "plan" in ask("rg 'X|Y'")  # the same again goes to the search
    assert "answer" in ask("grep -rn X lib app nowhere 2>/dev/null") and "plan" in ask("grep -rn X lib/a.ts app")
    assert known.decide({"tool": "search", "input": {"pattern": "Z"}, "cwd": cwd}) == {"allow": True} == known.decide({"tool": "shell", "input": None})
    text = "echo BEFORE; rg -n 'Y\\(' lib | head -3 && rg -n hit lib; echo AFTER"
    kept = []

    def keep(answer):
        kept.append(answer)
        (tmp_path / "kept").write_text(answer)
        return str(tmp_path / "kept")

    new = known.rewritten(ask(text)["plan"], keep, "/bin/folder", "/tmp/log")
    assert new.startswith(f"echo BEFORE; cat '{tmp_path}/kept' && rg -n hit lib | '/bin/folder' fold --tag ") and new.endswith("; echo AFTER") and len(kept) == 1
    again = known.rewritten(ask(text)["plan"], keep, "/bin/folder", "/tmp/log")
    assert again.startswith("echo BEFORE; rg -n 'Y\\(' lib | '/bin/folder' fold --tag ") and "&& rg -n hit lib; echo" in again  # answered and folded ones run raw
    one = known.rewritten(ask("grep -n hit lib/a.ts | cut -c1-30 | head -8")["plan"], keep, "cat", "/tmp/log")
    assert one.startswith("grep -H -n hit lib/a.ts | 'cat' fold --tag ") and one.endswith(" --strip-path lib/a.ts --head 8 --cut 1-30 | cut -c1-30 | head -8")
    assert [m["kind"] for m in known.metrics].count("answer") == 3
    ran = subprocess.run(["bash", "-c", new.split(" && ")[0]], cwd=cwd, capture_output=True, text=True)
    assert ran.stdout.startswith("BEFORE") and "## function `Y`" in ran.stdout
    assert known.decide({"tool": "search", "input": {"pattern": "X" * 9}, "cwd": cwd}) == {"allow": True}

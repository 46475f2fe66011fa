"""Which text searches the graph can answer, read from a search tool's input or a shell command.

A command is read once into pipelines of words (``plans/shell.py``); what it looks up, whether its lines can be folded and what
reads on from it are questions to that list. ``Session.decide`` never raises: what can't be read is left alone.
"""

from __future__ import annotations

import hashlib
import os
import re
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from symlattice.plans.shell import Command, Part, Token, Unreadable, chain

#: Limits of an answer, markers that are looked up as text, file patterns and types that count as code.
MAX_NAMES, MAX_ANSWER, MAX_REWRITES = 4, 6000, 4
MARKERS = ("TODO", "FIXME", "HACK", "XXX")
CODE_TYPES = ("ts", "js", "tsx", "jsx", "py", "python", "typescript", "javascript")
CODE_ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "py")
BRACED_ENDINGS = ("ts", "tsx", "js", "jsx", "py")
#: Programs that search, flags with a value of their own, flags that change what is asked, and such whose output isn't lines.
SEARCHERS = ("rg", "grep", "ugrep", "ag")
GLOB_FLAGS, TYPE_FLAGS = ("-g", "--glob", "--include"), ("-t", "--type")
VALUE_FLAGS = (*GLOB_FLAGS, *TYPE_FLAGS, "-T", "--type-not", "-A", "-B", "-C", "-m", "--max-count", "--exclude")
OTHER_SHORT, OTHER_LONG = "eifvcx", ("regexp", "ignore-case", "file", "invert-match", "line-regexp", "count")
FOLDED = ("rg", "grep", "ugrep")
NO_LINES_SHORT = "olLcqABCz"
NO_LINES_LONG = (
    "only-matching", "files-with-match", "files-with-matches", "files-without-match", "files-without-matches", "count", "count-matches", "quiet", "json", "files", "replace",
    "context", "after-context", "before-context", "null", "null-data", "passthru", "stats", "no-filename",
)
RECURSE_SHORT, RECURSE_LONG = "rRd", ("recursive", "dereference-recursive", "directories")
#: What may stand around a name in a pattern, as regular expressions of literal dressing.
BEFORE = (r"\^", r"\\b", r"\\<", r"\\?\(")
AFTER = (r"\\b", r"\\>", r"\\s[*+]?", r"\s", r"\\?[()]", "=")
MODIFIERS = ("export", "default", "async")
DECLARATORS = ("function", "function*", "const", "let", "var", "class", "type", "interface", "enum")

_any = "|".join
_words = lambda names: _any(re.escape(n) for n in names)
#: Steps that undress one branch of a pattern, each a regular expression whose match goes.
UNDRESS = (f"^(?:{_any(BEFORE)})+", "^" + "".join(rf"(?:{m}\s+)?" for m in MODIFIERS) + rf"(?:{_words(DECLARATORS)})\s+", f"(?:{_any(AFTER)})+$")
OR = r"\\?\|"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def names_in(pattern: str) -> list[str] | None:
    """The names that a search pattern looks up, if each of its branches is one: at most MAX_NAMES."""
    found: dict[str, None] = {}
    for branch in re.split(OR, pattern):
        bare = branch.strip()
        for dressing in UNDRESS:
            bare = re.sub(dressing, "", bare)
        found[bare] = None
    fits = len(found) <= MAX_NAMES and all(re.fullmatch(IDENTIFIER, n) and n.upper() not in MARKERS for n in found)
    return list(found) if fits else None


def names_column(pattern: Column) -> Column:
    """``names_in`` as a column; null where the pattern is no lookup of names."""

    def undressed(branch: Column) -> Column:
        bare = F.trim(branch)
        for dressing in UNDRESS:
            bare = F.regexp_replace(bare, dressing, "")
        return bare

    names = F.array_distinct(F.transform(F.split(pattern, OR), undressed))
    fits = F.forall(names, lambda n: n.rlike(f"^{IDENTIFIER}$") & ~F.upper(n).isin(*MARKERS))
    return F.when(fits & (F.size(names) <= MAX_NAMES), names)


def about_code(glob: str) -> bool:
    """Whether a file pattern names code: by an ending, or by one within braces."""
    return bool(re.search(rf"\.(?:{_any(CODE_ENDINGS)})\b", glob) or re.search(rf"\{{[^}}]*\b(?:{_any(BRACED_ENDINGS)})\b", glob))


@dataclass
class Lookup:
    """Names that are looked up, and the folder (or file) where."""

    names: list[str]
    folder: str


def _at(path: str, folder: str) -> str:
    return os.path.normpath(os.path.join(folder, os.path.expanduser(path)))


def tool_lookup(given: dict, cwd: str) -> Lookup | None:
    """A search tool's input as a lookup; None if it asks for more than names in code."""
    names = names_in(str(given.get("pattern") or ""))
    other = given.get("-i") or given.get("multiline") or given.get("output_mode") == "count"
    kind, glob = given.get("type"), given.get("glob")
    if names is None or other or kind and str(kind) not in CODE_TYPES or glob and not about_code(str(glob)):
        return None
    return Lookup(names, _at(str(given["path"]), cwd) if given.get("path") else cwd)


def _cluster(word: str, letters: str) -> bool:
    """Whether short flags put together hold one of ``letters``, before anything that isn't a letter."""
    run = re.match(r"-([A-Za-z]+)", word)
    return bool(run and set(run[1]) & set(letters))


def _long(word: str, names: tuple[str, ...]) -> bool:
    return word.startswith("--") and word[2:].split("=")[0] in names


def command_lookup(command: Command, folder: str, known: dict[str, str], scope_of: Callable[[str], str | None] = lambda d: d) -> Lookup | None:
    """A search command as a lookup. Several paths must be folders of one repository; such as don't exist are passed over."""
    values = [w.value(known) for w in command.words]
    if len(values) < 2 or None in values or values[0] not in SEARCHERS or command.words[0].text != values[0]:
        return None
    plain: list[str] = []
    rest = iter(values[1:])
    for w in rest:
        if w in VALUE_FLAGS:
            value = next(rest, "")
            fits = about_code(value) if w in GLOB_FLAGS else value in CODE_TYPES if w in TYPE_FLAGS else True
        elif w.startswith("-"):
            name, _, value = w.partition("=")
            fits = about_code(value) if name in ("--include", "--glob") and value else not (_cluster(w, OTHER_SHORT) or _long(w, OTHER_LONG))
        else:
            plain.append(w)
            fits = True
        if not fits:
            return None
    names = names_in(plain[0]) if plain else None
    if names is None:
        return None
    paths = [_at(p, folder) for p in plain[1:]]
    if len(paths) > 1:
        paths = [p for p in paths if os.path.exists(p)]
        if not paths or any(not os.path.isdir(p) for p in paths) or len({scope_of(p) for p in paths}) > 1:
            return None
    return Lookup(names, paths[0] if paths else folder)


def _literal(command: Command) -> list[str] | None:
    """Words without variables, or None; a command whose output goes elsewhere has none."""
    values = [w.value({}) for w in command.words]
    return None if None in values or not command.quiet() else values


def trims(command: Command) -> bool:
    """Whether a command that reads on from a search only takes lines or characters away, orders or counts lines."""
    words = _literal(command)
    if not words:
        return False
    program, args = words[0], words[1:]
    if program in ("head", "tail"):
        number = args[1:] if args[:1] == ["-n"] else args
        return number == [] or len(number) == 1 and bool(re.fullmatch(r"-?\d+", number[0]))
    if program in ("sort", "uniq"):
        return args == [] or program == "sort" and args == ["-u"]
    if program in ("grep", "rg"):
        return len(args) == 2 and bool(re.fullmatch("-[a-zA-Z]+", args[0])) and "v" in args[0]
    return program == "cut" and bool(args) or program == "wc" and args == ["-l"]


def pipeline_lookup(part: Part, folder: str, known: dict[str, str], scope_of: Callable[[str], str | None] = lambda d: d) -> Lookup | None:
    """What a pipeline looks up, if nothing but trims reads on from it."""
    first, *readers = part.commands
    if not first.quiet() or not all(map(trims, readers)):
        return None
    return command_lookup(first, folder, known, scope_of)


def lookup_of(text: str, cwd: str, scope_of: Callable[[str], str | None] = lambda d: d) -> Lookup | None:
    """One search command as a lookup, a ``cd`` before it allowed."""
    try:
        parts = chain(text.strip())
    except Unreadable:
        return None
    *before, last = parts
    if len(last.commands) > 1 or last.commands[0].redirects or len(before) > 1 or before and before[0].separator != "&&":
        return None
    folder: str | None = cwd
    if before:
        folder = _moved(before[0], cwd, {})
    return command_lookup(last.commands[0], folder, {}, scope_of) if folder else None


def _moved(part: Part, folder: str | None, known: dict[str, str]) -> str | None:
    """Where a ``cd`` leads; None if that can't be told."""
    to = [w.value(known) for w in part.commands[0].words[1:]]
    return _at(to[0], folder) if folder and len(part.commands) == 1 and len(to) == 1 and to[0] is not None else None


@dataclass
class Fold:
    """A search whose lines can be folded: its command, what reads on (limits alone), and its file, if it reads one."""

    head: str
    tail: str
    file: str | None

    def limits(self) -> tuple[int | None, str | None]:
        """(lines, characters) that the tail leaves: the least number, the last list."""
        lines, characters = None, None
        for c in chain(self.tail.lstrip()[1:])[0].commands if self.tail.strip() else ():
            program, *args = _literal(c) or [""]
            number = re.fullmatch(r"(-n ?)?(-?)(\d+)?", " ".join(args)) if program == "head" else None
            if number and not (number[1] and number[2]):
                lines = min(lines if lines is not None else 1 << 62, int(number[3] or 10))
            elif program == "cut":
                characters = "".join(args).removeprefix("-c")
        return lines, characters


def _limit(command: Command) -> bool:
    """Whether a command only limits lines (head) or characters (cut -c)."""
    words = _literal(command) if not command.redirects else None
    joined = " ".join(words or [])
    return bool(re.fullmatch(r"head( -n ?)?( ?-?\d+)?|cut -c ?[\d,-]+", joined))


def fold_of(text: str) -> Fold | None:
    """How a pipeline's lines can be folded: None if it doesn't put out matching lines, or if more than limits reads on."""
    try:
        parts = chain(text)
    except Unreadable:
        return None
    if len(parts) != 1:
        return None
    search, *readers = parts[0].commands
    words = search.words
    if len(words) < 2 or words[0].text not in FOLDED or not search.quiet() or not all(map(_limit, readers)) or any(w.runs_code for w in words):
        return None
    program, recursive, plain, flags = words[0].text, False, [], True
    for w in words[1:]:
        if flags and w.text == "--":
            flags = False
        elif flags and w.text.startswith("-"):
            if _cluster(w.text, NO_LINES_SHORT + ("r" if program == "rg" else "")) or _long(w.text, NO_LINES_LONG):
                return None
            recursive |= _cluster(w.text, RECURSE_SHORT) or _long(w.text, RECURSE_LONG)
        else:
            plain.append(w.text)
    end = readers[0].tokens[0].start if readers else len(text)
    cut = text.rindex("|", 0, end) if readers else len(text)
    one = program != "rg" and not recursive and len(plain) == 2 and not set(plain[1]) & set("*?[{")
    return Fold(text[:cut].rstrip(), text[cut:], plain[1] if one else None)


@dataclass
class Plan:
    """What of a command can be answered (part number, lookup) or folded (part number, folder, fold). only: one lookup and nothing else."""

    parts: list[Part]
    hits: list[tuple[int, Lookup]] = field(default_factory=list)
    folds: list[tuple[int, str, Fold]] = field(default_factory=list)
    only: bool = False


def plan_of(text: str, cwd: str, scope_of: Callable[[str], str | None] = lambda d: d) -> Plan | None:
    """What of a chain of commands can be answered or folded. ``cd`` and literal variables are followed; beyond a ``cd`` that can't be, nothing is touched."""
    try:
        plan = Plan(chain(text))
    except Unreadable:
        return None
    folder: str | None = cwd
    known: dict[str, str] = {}
    others = 0
    for i, part in enumerate(plan.parts):
        words = part.commands[0].words
        if not words and len(part.commands) == 1:
            others += bool(part.text.strip())
            continue
        first = words[0] if words else Token("word", "", 0, 0)
        assigned = re.match(r"([A-Za-z_]\w*)=", first.text)
        if first.text == "cd":
            folder = _moved(part, folder, known)
            continue
        if assigned or first.text in ("for", "read"):
            name = assigned[1] if assigned else words[1].text if len(words) > 1 else ""
            known.pop(name, None)
            value = first.value(known) if assigned and len(words) == 1 and not part.commands[1:] and not part.commands[0].redirects else None
            if value is not None:
                known[name] = value.split("=", 1)[1]
            others += 1
            continue
        lookup = pipeline_lookup(part, folder, known, scope_of) if folder else None
        if lookup:
            plan.hits.append((i, lookup))
        others += not lookup
        fold = fold_of(part.text.strip()) if folder and scope_of(folder) else None
        if fold:
            plan.folds.append((i, folder, fold))
    plan.only = not others and len(plan.hits) == 1
    return plan if plan.hits or plan.folds else None


@dataclass
class Session:
    """What was answered and folded so far: a question that comes again goes to the text search, a fold is then shown raw once."""

    explore: Callable[[str], str | None]
    scope_of: Callable[[str], str | None] = lambda d: d
    answered: set = field(default_factory=set)
    folded: set = field(default_factory=set)
    #: A row for each answer and fold: kind, names or tag, characters.
    metrics: list[dict] = field(default_factory=list)

    def answer(self, lookup: Lookup) -> str | None:
        """The graph's answer: a brief text for each name, all of which must be known; the first's trust line stands for all."""
        asked = (lookup.folder, *lookup.names)
        texts = [] if asked in self.answered else [self.explore(n) for n in lookup.names]
        if not texts or not all(t and re.search(r"(?m)^## ", t) for t in texts):
            return None
        self.answered.add(asked)
        text = "\n".join([texts[0], *(re.sub(r"\Atrust: .*\n+", "", t) for t in texts[1:])])
        self.metrics.append({"kind": "answer", "of": "|".join(lookup.names), "characters": len(text)})
        return text if len(text) <= MAX_ANSWER else f"{text[:MAX_ANSWER]}\n… (truncated; explore {lookup.names[0]} for the rest)"

    def rewritten(self, plan: Plan, keep: Callable[[str], str], fold_program: str, log: str) -> str | None:
        """The command with answered parts read from files (``keep`` stores a text and gives its path) and others folded; None if it stays as it is."""
        texts = [p.text for p in plan.parts]
        changed = 0
        done: set[int] = set()

        def put(i: int, new: str) -> None:
            old = texts[i]
            lead, trail = len(old) - len(old.lstrip()), len(old.rstrip())
            texts[i] = old[:lead] + new + old[trail:]

        for i, lookup in plan.hits:
            inside = lookup.folder and self.scope_of(lookup.folder)
            text = self.answer(lookup) if inside and changed < MAX_REWRITES else None
            if text:
                put(i, f"cat {_quoted(keep(text))}")
                changed += 1
                done.add(i)
        for i, folder, fold in plan.folds:
            tag = hashlib.sha256(f"{folder}\n{plan.parts[i].text.strip()}".encode()).hexdigest()[:12]
            if i in done or changed >= MAX_REWRITES:
                continue
            if tag in self.folded:
                self.folded.remove(tag)
                continue
            self.folded.add(tag)
            lines, characters = fold.limits()
            head = re.sub(r"^(\S+)", r"\1 -H", fold.head, count=1) if fold.file else fold.head
            options = ["--tag", tag, "--log", _quoted(log)]
            options += ["--strip-path", fold.file] if fold.file else []
            options += ["--head", str(lines)] if lines is not None else []
            options += ["--cut", characters] if characters else []
            put(i, " ".join([head, "|", _quoted(fold_program), "fold", *options, *([fold.tail] if fold.tail else [])]))
            self.metrics.append({"kind": "fold", "of": tag, "characters": len(fold.head)})
            changed += 1
        return "".join(t + p.separator for t, p in zip(texts, plan.parts, strict=True)) if changed else None

    def decide(self, event: dict) -> dict:
        """{"allow": True}, {"answer": text}, or {"plan": Plan} for an event (tool, input, cwd)."""
        try:
            given, cwd, tool = event.get("input") or {}, event.get("cwd") or os.getcwd(), event.get("tool")
            plan = plan_of(str(given.get("command") or ""), cwd, self.scope_of) if tool == "shell" else None
            lookup = tool_lookup(given, cwd) if tool == "search" else plan.hits[0][1] if plan and plan.only else None
            text = self.answer(lookup) if lookup and self.scope_of(lookup.folder) else None
            return {"answer": text} if text else {"plan": plan} if plan else {"allow": True}
        except Exception:  # noqa: BLE001  a search is never stopped by a failure here
            return {"allow": True}


def _quoted(path: str) -> str:
    return "'" + path + "'" if "'" not in path else shlex.quote(path)

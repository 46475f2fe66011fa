"""Facts of TypeScript and JavaScript source, by a token scanner.

There is no parser for these languages here; tokens, matched brackets and a stack of scopes give declarations, calls,
uses, imports and base classes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from symlattice.sources.facts import FileFacts

_TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\#[A-Za-z_$][\w$]*)"""
    r"""|(?P<number>\d[\w.]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<punct>=>|\?\.(?!\d)|\.\.\.|[{}()\[\];,<>=:?.@`]|[^\s\w])""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words of the languages that are never names of functions or values.
_WORDS = frozenset(
    "if for while switch catch return typeof instanceof void delete new in of do else case default break continue throw try finally with yield await async "
    "function class extends implements interface type enum const let var import export from as static get set public private protected readonly abstract override declare namespace module "
    "this super null true false undefined keyof infer is satisfies any string number boolean object unknown never symbol bigint".split()
)
_SOFT = frozenset("type of from as async get set static is declare module namespace any string number boolean object unknown never symbol".split())
#: After these a slash begins a regular expression, and ``{`` an object.
_EXPRESSION_WORDS = frozenset("return typeof instanceof void delete new in of do else case throw yield await default".split())


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line: int


def tokenize(text: str) -> list[Token]:
    """Tokens without space and comments. A template's literal parts are strings, its expressions tokens within ``${`` and ``}``."""
    out: list[Token] = []
    at, line, templates, depth = 0, 1, [], 0

    def literal(start: int) -> int:
        """The end of a template part that starts after a backtick or a closing brace."""
        i = start
        while i < len(text) and text[i] != "`" and text[i : i + 2] != "${":
            i += 2 if text[i] == "\\" else 1
        return min(i, len(text))

    while at < len(text):
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (not out or (out[-1].kind == "punct" and out[-1].text not in (")", "]", "}")) or out[-1].text in _EXPRESSION_WORDS):
            m = _REGEX.match(text, at)
            if m:
                out.append(Token("string", m.group(), at, line))
                at = m.end()
                continue
        in_template = False
        if text[at] == "`":
            in_template, begin = True, at + 1
        elif text[at] == "}" and templates and templates[-1] == depth:
            templates.pop()
            depth -= 1
            out.append(Token("punct", "}", at, line))
            in_template, begin = True, at + 1
        if in_template:
            end = literal(begin)
            out.append(Token("string", "`" + text[begin:end] + "`", at, line))
            line += text.count("\n", at, end)
            if text[end : end + 2] == "${":
                depth += 1
                templates.append(depth)
                out.append(Token("punct", "{", end, line))
                at = end + 2
            else:
                at = end + 1
            continue
        m = _TOKEN.match(text, at)
        kind, value = m.lastgroup, m.group()
        if kind not in ("space", "comment"):
            out.append(Token(kind, value, at, line))
            depth += (value == "{") - (value == "}") if kind == "punct" else 0
        line += value.count("\n")
        at = m.end()
    return out


def match_brackets(tokens: list[Token]) -> dict[int, int]:
    """Opening token -> closing token of round, square and curly brackets; an unclosed one ends with the file."""
    pairs, stack, close = {}, [], {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in close.values():
            stack.append(i)
        elif t.text in close:
            while stack:
                j = stack.pop()
                pairs[j] = i
                if tokens[j].text == close[t.text]:
                    break
    for j in stack:
        pairs[j] = len(tokens) - 1
    return pairs


class _Scanner:
    def __init__(self, path: str, text: str):
        self.text, self.t = text, tokenize(text)
        self.pair = match_brackets(self.t)
        self.facts = FileFacts(path)
        self.skip: set[int] = set()  # tokens that declare, import or are parameters

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and (self.t[i].text not in _WORDS or self.t[i].text in _SOFT)

    def signature(self, a: int, b: int) -> str:
        """Source from token ``a`` to the first brace or line end, at most to token ``b``."""
        end = self.t[b].at + len(self.t[b].text)
        return re.split(r"[{\n]", self.text[self.t[a].at : end], maxsplit=1)[0]

    def after_types(self, i: int) -> int:
        """The token after ``<...>`` that begins at ``i``; ``i`` itself if there are no type arguments."""
        if self.word(i) != "<":
            return i
        level, j = 0, i
        while j < len(self.t) and j < i + 400:
            w = self.word(j)
            if w in "([{" and w:
                j = self.pair.get(j, j)
            elif w == "<":
                level += 1
            elif w == ">":
                level -= 1
                if not level:
                    return j + 1
            elif w in (";", "&&", "||") or w == "}":
                return i
            j += 1
        return i

    def statement_end(self, i: int, last: int) -> int:
        """The last token of an expression that starts at ``i``: before a comma or semicolon, or a line end where no operator asks for more."""
        j = i
        while j <= last:
            w = self.word(j)
            if w in ("(", "[", "{"):
                j = self.pair.get(j, j)
            elif w in (",", ";", ")", "]", "}"):
                return j - 1
            nxt = j + 1
            if nxt <= last and self.t[nxt].line > self.t[j].line and self._ends(j) and self._begins(nxt):
                return j
            j += 1
        return last

    def _ends(self, j: int) -> bool:
        t = self.t[j]
        return t.kind in ("name", "number", "string") and t.text not in _EXPRESSION_WORDS or t.text in (")", "]", "}", ">")

    def _begins(self, j: int) -> bool:
        t = self.t[j]
        return t.kind in ("name", "number", "string") and t.text not in ("instanceof", "in", "of", "as", "extends") or t.text in ("{", "@", "}")

    def exported(self, i: int) -> bool:
        j = i - 1
        while self.word(j) in ("async", "declare", "abstract", "default"):
            j -= 1
        return self.word(j) == "export"

    # -- scopes ---------------------------------------------------------------------------------------------

    def block(self, a: int, b: int, owner: str | None, cls: tuple[str, str] | None, body: str = "") -> None:
        """Tokens ``a`` to ``b`` in a scope. ``body``: ``class`` or ``object`` where methods may be declared."""
        i = a
        while i <= b:
            i = self.one(i, b, owner, cls, body)

    def one(self, i: int, b: int, owner: str | None, cls: tuple[str, str] | None, body: str) -> int:
        t, w = self.t[i], self.word(i)
        if t.kind == "name" and self.word(i - 1) not in (".", "?."):
            if w == "import" and self.word(i + 1) not in ("(", "."):
                return self.imports(i, b)
            if w == "export":
                return self.export(i, b)
            if w == "function" or (w == "async" and self.word(i + 1) == "function"):
                return self.function(i, b, owner, cls)
            if w == "class" and not body == "class":
                return self.class_(i, b, owner, cls)
            if w in ("const", "let", "var") and self.word(i + 1) != "enum":
                return self.variables(i, b, owner, cls)
            if w in ("interface", "enum") and self.is_name(i + 1) and not body:
                return self.type_(i, b, owner, cls, w)
            if w == "type" and self.is_name(i + 1) and not body and self.word(self.after_types(i + 2)) == "=":
                return self.type_(i, b, owner, cls, w)
        if body and (t.kind in ("name", "string", "number") or w == "["):
            done = self.method(i, b, owner, cls, body)
            if done:
                return done
        if w == "{":
            end = self.pair.get(i, b)
            self.block(i + 1, min(end, b + 1) - 1, owner, cls, "object" if self.object_at(i) else "")
            return end + 1
        if w in ("(", "["):
            end = self.pair.get(i, b)
            arrow = w == "(" and self.arrow_after(end)
            if arrow:
                self.parameters(i, end)
            self.block(i + 1, min(end, b + 1) - 1, owner, cls)
            return end + 1
        if self.is_name(i):
            self.use(i, owner)
        return i + 1

    def arrow_after(self, end: int) -> bool:
        if self.word(end + 1) == "=>":
            return True
        if self.word(end + 1) != ":":
            return False
        j = end + 2
        while j < min(len(self.t), end + 60) and self.word(j) not in ("=>", ";", ",", "{", ")", "=", "?"):
            j = self.pair.get(j, j) + 1
        return self.word(j) == "=>"

    def object_at(self, i: int) -> bool:
        """Whether the brace at ``i`` opens an object rather than a block."""
        p = self.word(i - 1)
        return p in ("=", "(", ",", ":", "[", "?", "&", "|", "...") or p in _EXPRESSION_WORDS - {"do", "else"}

    def parameters(self, a: int, b: int) -> None:
        """Plain parameter names between brackets aren't uses."""
        level = 0
        for i in range(a + 1, b):
            w = self.word(i)
            level += (w in ("(", "[", "{")) - (w in (")", "]", "}"))
            if not level and self.is_name(i) and self.word(i - 1) in ("(", ",", "...", "public", "private", "protected", "readonly"):
                self.skip.add(i)

    # -- declarations ---------------------------------------------------------------------------------------

    def function(self, i: int, b: int, owner: str | None, cls) -> int:
        j = i + (2 if self.word(i) == "async" else 1)
        j += self.word(j) == "*"
        named = self.is_name(j)
        k = self.after_types(j + named)
        if self.word(k) != "(":
            return j
        close = self.pair.get(k, b)
        self.parameters(k, close)
        body = self.body_after(close, b)
        end = self.pair.get(body, b) if body else close
        statement = self.statement_at(i)
        inner = owner
        if named and statement and body:
            inner = self.facts.symbol("function", self.word(j), self.t[i].line, self.t[min(end, b)].line, self.exported(i), self.signature(i, min(end, b)))
        if named:
            self.skip.add(j)
        self.block(k, min(end, b), inner, cls)
        return end + 1

    def statement_at(self, i: int) -> bool:
        p = self.word(i - 1)
        return i == 0 or p in (";", "{", "}", ")", "export", "default", "declare", "async") or (self.t[i - 1].line < self.t[i].line and p not in ("=", "(", ",", ":", "[", "?", "=>", "return"))

    def body_after(self, close: int, b: int) -> int | None:
        """The brace that opens the body after a parameter list; None for a declaration without one."""
        j = close + 1
        if self.word(j) == ":":
            j += 1
            while j <= b and self.word(j) not in (";", "=>"):
                if self.word(j) == "{" and self.word(j - 1) not in (":", "|", "&", "<", ",", "=>", "extends", "is"):
                    return j
                j = self.pair.get(j, j) + 1
            return None
        return j if j <= b and self.word(j) == "{" else None

    def class_(self, i: int, b: int, owner: str | None, cls) -> int:
        j = i + 1
        named = self.is_name(j) and self.word(j) not in ("extends", "implements")
        k = self.after_types(j + named)
        brace = k
        while brace <= b and self.word(brace) != "{":
            nxt = self.after_types(brace)
            brace = nxt if nxt > brace else self.pair.get(brace, brace) + 1
        if brace > b:
            return i + 1
        end = self.pair.get(brace, b)
        start = i - (self.word(i - 1) == "abstract")
        declared = named and (self.statement_at(start) or self.word(i - 1) == "abstract")
        inner = cls
        if named:
            self.skip.add(j)
        if declared:
            made = self.facts.symbol("class", self.word(j), self.t[start].line, self.t[min(end, b)].line, self.exported(start), self.signature(start, min(end, b)))
            self.bases(k, brace, made)
            inner = (self.word(j), made)
        for x in range(k, brace):
            if self.is_name(x):
                self.use(x, owner)
        self.block(brace + 1, min(end, b + 1) - 1, owner, inner, "class")
        return end + 1

    def bases(self, a: int, brace: int, made: str) -> None:
        """Names in the clauses of a class, those of type arguments included; only typed source has such clauses."""
        if self.facts.path.lower().rsplit(".", 1)[-1] not in ("ts", "tsx", "mts", "cts"):
            return
        kind, i = None, a
        while i < brace:
            w = self.word(i)
            if w in ("extends", "implements") and self.word(i - 1) != ".":
                kind = w
            elif kind and self.is_name(i):
                j = i
                while self.word(j + 1) == "." and self.is_name(j + 2):
                    j += 2
                self.facts.base(made, kind, self.text[self.t[i].at : self.t[j].at + len(self.t[j].text)], self.t[i].line)
                i = j
            i += 1

    def method(self, i: int, b: int, owner: str | None, cls, body: str) -> int | None:
        """A method that starts at ``i`` (its modifiers included): the token after it. None if there is none."""
        j = i
        if body == "class" and self.word(i - 1) not in ("{", "}", ";", "]", ")") and self.t[i - 1].line == self.t[i].line:
            return None
        if body == "object" and self.word(i - 1) not in ("{", ","):
            return None
        while self.word(j) in ("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare") and self.word(j + 1) not in ("(", "=", ":", ";", "<", ",", "}", "?"):
            j += 1
        j += self.word(j) == "*"
        name = j
        after = self.pair.get(j, j) + 1 if self.word(j) == "[" else j + 1
        after += self.word(after) in ("?", "!")
        k = self.after_types(after)
        if self.word(k) != "(" or self.word(j) in ("if", "for", "while", "switch", "catch", "return"):
            return None
        close = self.pair.get(k, b)
        brace = self.body_after(close, b)
        if brace is None:
            if body == "class":
                self.skip.add(name)  # a signature
            return None
        end = self.pair.get(brace, b)
        label = self.text[self.t[name].at : self.t[after - 1].at + len(self.t[after - 1].text)].rstrip("?!")
        inner = self.facts.symbol("method", label, self.t[i].line, self.t[min(end, b)].line, False, self.signature(i, min(end, b)), f"{cls[0]}.{label}" if cls else None)
        self.parameters(k, close)
        self.skip.add(name)
        self.block(k, min(end, b), inner, cls)
        return end + 1

    def variables(self, i: int, b: int, owner: str | None, cls) -> int:
        exported, j = self.exported(i), i + 1
        while j <= b:
            end = self.statement_end(j, b)
            if self.is_name(j):
                self.skip.add(j)
                eq = j + 1
                while eq <= end and self.word(eq) != "=":
                    nxt = self.after_types(eq)
                    eq = nxt if nxt > eq else self.pair.get(eq, eq) + 1
                value = eq + 1
                start = value + (self.word(value) == "async")
                arrow = self.word(start) == "function" or (self.is_name(start) and self.word(start + 1) == "=>")
                opening = self.after_types(start)
                arrow = arrow or (self.word(opening) == "(" and self.arrow_after(self.pair.get(opening, b)))
                inner, made = owner, None
                if eq < end and arrow and self.word(eq + 1 + (self.word(eq + 1) == "async")) is not None:
                    made = "function"
                elif owner is None and cls is None:
                    made = "const"
                if made:
                    symbol = self.facts.symbol(made, self.word(j), self.t[j].line, self.t[end].line, exported, self.signature(j, end))
                    inner = symbol if made == "function" else owner
                if self.is_name(start) and self.word(start + 1) == "=>":
                    self.skip.add(start)
                self.block(j, end, inner, cls)
            else:
                self.block(j, end, owner, cls)
            if self.word(end + 1) != ",":
                return end + 1
            j = end + 2
        return j

    def type_(self, i: int, b: int, owner: str | None, cls, kind: str) -> int:
        name = i + 1
        self.skip.add(name)
        if kind == "type":
            end = self.statement_end(i + 2, b)
        else:
            brace = name + 1
            while brace <= b and self.word(brace) != "{":
                brace += 1
            end = min(self.pair.get(brace, b), b)
            if kind == "interface":
                for x in range(brace + 1, end):
                    if self.word(x - 1) in ("{", ";", ",", "}", ")") or self.t[x].line > self.t[x - 1].line:
                        self.skip.add(x)  # a member's name
        start = i - (self.word(i - 1) == "const")
        made = self.facts.symbol(kind, self.word(name), self.t[start].line, self.t[end].line, self.exported(start), self.signature(start, end))
        if kind == "enum":
            for x in range(name + 1, end + 1):
                if self.is_name(x) and self.word(x + 1) in ("=", ",", "}"):
                    self.skip.add(x)
        self.block(name + 1, end, owner if kind == "enum" else made, cls)
        return end + 1

    # -- uses -----------------------------------------------------------------------------------------------

    def use(self, i: int, owner: str | None) -> None:
        w, before = self.word(i), self.word(i - 1)
        member = before in (".", "?.")
        after = i + 1 + (self.word(i + 1) == "?.")
        k = self.after_types(after)
        called = self.word(k) == "(" and i not in self.skip
        if called and w == "async" and self.arrow_after(self.pair.get(k, k)):
            return
        if called and before != "new" and not self.new_before(i):
            if w not in _WORDS or w in _SOFT or member:
                self.facts.call(owner, w, member, self.t[self.chain_start(i)].line)
            return
        if member or i in self.skip or w in _SOFT:
            return
        if before == "/" and self.word(i - 2) == "<":
            return  # a closing tag
        if self.word(i + 1) == ":" and before in ("{", ",") and not self.word(i + 2) == "=":
            return  # a key
        self.facts.ref(owner, w, self.t[i].line)

    def chain_start(self, i: int) -> int:
        while self.word(i - 1) in (".", "?.") and i >= 2 and self.t[i - 2].kind == "name":
            i -= 2
        return i

    def new_before(self, i: int) -> bool:
        return self.word(self.chain_start(i) - 1) == "new"

    # -- modules --------------------------------------------------------------------------------------------

    def module(self, i: int) -> str:
        return self.word(i).strip("\"'`") if i < len(self.t) and self.t[i].kind == "string" else ""

    def specifiers(self, brace: int) -> list[tuple[str, str]]:
        """(name, alias) between braces."""
        out, i, end = [], brace + 1, self.pair.get(brace, brace)
        while i < end:
            i += self.word(i) == "type" and self.word(i + 1) not in (",", "}", "as")
            if self.t[i].kind in ("name", "string"):
                name = alias = self.word(i).strip("\"'")
                if self.word(i + 1) == "as":
                    alias = self.word(i + 2).strip("\"'")
                    i += 2
                out.append((name, alias))
            i += 1
        return out

    def imports(self, i: int, b: int) -> int:
        end = i + 1
        while end <= b and self.t[end].kind != "string" and self.word(end) != ";":
            end = self.pair.get(end, end) + 1
        module = self.module(end)
        j = i + 1
        if self.word(j) == "type" and self.word(j + 1) not in ("from", ","):
            j += 1
        while j < end:
            if self.word(j) == "{":
                for name, alias in self.specifiers(j):
                    self.facts.bind(module, alias, name, "named")
                j = self.pair.get(j, j)
            elif self.word(j) == "*" and self.word(j + 1) == "as":
                self.facts.bind(module, self.word(j + 2), "*", "namespace")
                j += 2
            elif self.t[j].kind == "name" and self.word(j) != "from":
                self.facts.bind(module, self.word(j), "default", "default")
            j += 1
        return end + 1

    def export(self, i: int, b: int) -> int:
        j = i + 1
        j += self.word(j) == "type" and self.word(j + 1) in ("{", "*")
        if self.word(j) == "{":
            end = self.pair.get(j, b)
            if self.word(end + 1) == "from":
                module = self.module(end + 2)
                for name, alias in self.specifiers(j):
                    self.facts.bind(module, alias, name, "named-reexport")
                return end + 3
            return j
        if self.word(j) == "*":
            if self.word(j + 1) == "as":
                self.facts.bind(self.module(j + 4), self.word(j + 2), "*", "namespace-reexport")
                return j + 5
            self.facts.bind(self.module(j + 2), "*", "*", "star-reexport")
            return j + 3
        if self.word(j) == "default" and j + 1 <= b and self.t[j + 1].kind == "string":
            self.facts.bind(self.module(j + 1), "*", "*", "star-reexport")
        return j


def extract(path: str, text: str) -> FileFacts:
    """Symbols, calls, uses, imports and base classes. Uses of names that the file neither declares nor imports are dropped."""
    scan = _Scanner(path, text)
    if scan.t:
        try:
            scan.block(0, len(scan.t) - 1, None, None)
        except RecursionError:
            pass  # what was read so far
    known = {s["name"] for s in scan.facts.symbols} | {x["local_name"] for x in scan.facts.bindings}
    kept: list[dict] = []
    for r in scan.facts.refs:
        if r["name"] in known and (not kept or kept[-1] != r):
            kept.append(r)
    scan.facts.refs = kept
    return scan.facts

"""A shell command read into words, operators and redirections, with the place of each in the text.

Only what is needed to tell what a command does is understood: quoting, variables, substitutions and subshells (as
opaque pieces), redirections, here-documents. What can't be read raises :class:`Unreadable`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

OPERATORS = ("&&", "||", "|&", ";;", "|", ";", "&", "\n")
_NAME = re.compile(r"[A-Za-z_]\w*")
_REDIRECT = re.compile(r"(\d*)(&>>|&>|>>|>&|<&|>\||<>|>|<<<|<)")
_PLAIN = re.compile(r"[^\s'\"\\$`()|;&<>]+")
_IN_QUOTES = re.compile(r"[^\"\\$`]+")


class Unreadable(ValueError):
    """The command isn't closed, or does what isn't followed here."""


@dataclass(frozen=True)
class Piece:
    """A part of a word. kind: text, quoted, variable (text: its name), or code (a substitution or a subshell)."""

    kind: str
    text: str


@dataclass(frozen=True)
class Token:
    """kind: word, operator, redirect (pieces: where to; text: how), or body (of a here-document)."""

    kind: str
    text: str
    start: int
    end: int
    pieces: tuple[Piece, ...] = ()

    def value(self, known: dict[str, str]) -> str | None:
        """What the shell makes of the word; None if that isn't known here."""
        out = [known.get(p.text) if p.kind == "variable" else None if p.kind == "code" else p.text for p in self.pieces]
        return None if None in out else "".join(out)

    @property
    def runs_code(self) -> bool:
        return any(p.kind == "code" for p in self.pieces)


class Reader:
    """One pass over a command."""

    def __init__(self, text: str):
        self.text, self.at, self.endings = text, 0, []

    def until(self, close: str) -> None:
        """Move past ``close``, over whatever is nested on the way."""
        opens = {"(": ")", "`": "`", '"': '"'}
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == close:
                return
            if c == "\\":
                self.at += 1
            elif c == "'" and close == ")":
                self.single()
            elif c in opens and close != "`" and (close == ")" or c == "`" or c == "(" and self.text[self.at - 2] == "$"):
                self.until(opens[c])
        raise Unreadable(f"no {close}")

    def single(self) -> str:
        end = self.text.find("'", self.at)
        if end < 0:
            raise Unreadable("no '")
        inner, self.at = self.text[self.at : end], end + 1
        return inner

    def dollar(self) -> Piece:
        """What a ``$`` at the place stands for."""
        begin, self.at = self.at, self.at + 1
        name = _NAME.match(self.text, self.at)
        if self.text.startswith("(", self.at):
            self.at += 1
            self.until(")")
        elif name:
            self.at = name.end()
            return Piece("variable", name[0])
        elif self.text.startswith("{", self.at):
            end = self.text.find("}", self.at)
            if end < 0:
                raise Unreadable("no }")
            inner, self.at = self.text[self.at + 1 : end], end + 1
            return Piece("variable" if _NAME.fullmatch(inner) else "code" if "`" in inner or "$(" in inner else "variable", inner)
        else:
            return Piece("variable", "$")  # its value is never known
        return Piece("code", self.text[begin : self.at])

    def double(self) -> Iterator[Piece]:
        yield Piece("quoted", "")
        while self.at < len(self.text):
            c = self.text[self.at]
            run = _IN_QUOTES.match(self.text, self.at)
            if run:
                self.at = run.end()
                yield Piece("quoted", run[0])
            elif c == '"':
                self.at += 1
                return
            elif c == "$":
                yield self.dollar()
            elif c == "`":
                begin, self.at = self.at, self.at + 1
                self.until("`")
                yield Piece("code", self.text[begin : self.at])
            else:  # within double quotes a backslash stays but before what it is needed for
                escaped = self.text[self.at + 1 : self.at + 2]
                yield Piece("quoted", escaped if escaped in ("$", "`", '"', "\\") else c + escaped)
                self.at += 2
        raise Unreadable('no "')

    def pieces(self) -> tuple[Piece, ...]:
        """The parts of the word that begins at the place; none, if there is no word."""
        out: list[Piece] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            run = _PLAIN.match(self.text, self.at)
            if run:
                self.at = run.end()
                out.append(Piece("text", run[0]))
            elif c == "$":
                out.append(self.dollar())
            elif c == "\\" and self.at + 1 < len(self.text):
                if self.text[self.at + 1] != "\n":
                    out.append(Piece("quoted", self.text[self.at + 1]))
                self.at += 2
            elif c == "\\":
                self.at += 1
                out.append(Piece("text", c))
            elif c in "'\"`(":
                begin, self.at = self.at, self.at + 1
                if c == "'":
                    out.append(Piece("quoted", self.single()))
                elif c == '"':
                    out.extend(self.double())
                else:
                    self.until(")" if c == "(" else c)
                    out.append(Piece("code", self.text[begin : self.at]))
            elif c == ")":
                raise Unreadable("( was not open")
            else:
                break
        return tuple(out)

    def here_document(self, begin: int) -> Token:
        self.at += 2
        if self.text.startswith("-", self.at):
            self.at += 1
        while self.text[self.at : self.at + 1] in (" ", "\t"):
            self.at += 1
        word = self.pieces()
        if not word or any(p.kind in ("variable", "code") for p in word):
            raise Unreadable("what ends the here-document?")
        self.endings.append("".join(p.text for p in word))
        return Token("redirect", "<<", begin, self.at, word)

    def bodies(self) -> Iterator[Token]:
        """Here-documents whose lines begin at the place."""
        for ending in self.endings:
            begin = self.at
            while True:
                if self.at > len(self.text) or self.at == len(self.text) and self.at:
                    raise Unreadable(f"no {ending}")
                stop = self.text.find("\n", self.at)
                line = self.text[self.at : stop if stop >= 0 else len(self.text)]
                last = line.lstrip("\t") == ending
                # the line break after the last line is left: it ends the command
                self.at = (stop if stop >= 0 else len(self.text)) + (0 if last else 1)
                if last:
                    break
            yield Token("body", ending, begin, self.at)
        self.endings = []

    def tokens(self) -> Iterator[Token]:
        text = self.text
        while self.at < len(text):
            begin = self.at
            if text[begin] != "\n" and text[begin].isspace():
                self.at += 1
            elif text.startswith("<<", begin) and not text.startswith("<<<", begin):
                yield self.here_document(begin)
            elif how := _REDIRECT.match(text, begin):
                self.at = how.end()
                while text[self.at : self.at + 1] in (" ", "\t"):
                    self.at += 1
                yield Token("redirect", how[0], begin, self.at, self.pieces())
            elif text[begin] == "\n" and self.endings:
                self.at += 1
                yield from self.bodies()
            elif operator := next((o for o in OPERATORS if text.startswith(o, begin)), None):
                self.at += len(operator)
                yield Token("operator", operator, begin, self.at)
            else:
                word = self.pieces()
                # digits right before an arrow belong to it
                yield Token("word", text[begin : self.at], begin, self.at, word)
        if self.endings:
            raise Unreadable(f"no {self.endings[0]}")


def read(text: str) -> list[Token]:
    return list(Reader(text).tokens())


@dataclass(frozen=True)
class Command:
    """A simple command of a pipeline."""

    tokens: tuple[Token, ...]

    @property
    def words(self) -> list[Token]:
        return [t for t in self.tokens if t.kind == "word"]

    @property
    def redirects(self) -> list[Token]:
        return [t for t in self.tokens if t.kind != "word"]

    def quiet(self) -> bool:
        """Whether all that is redirected, after the words, is what goes to standard error."""
        kinds = [t.kind for t in self.tokens]
        ends = [(t.text.split()[0], "".join(p.text for p in t.pieces)) for t in self.redirects if t.kind == "redirect"]
        return "body" not in kinds and kinds == sorted(kinds, key=lambda k: k != "word") and all(e in (("2>", "/dev/null"), ("2>&", "1")) for e in ends)


@dataclass(frozen=True)
class Part:
    """A pipeline of a chain: its text, the separator after it, and its commands."""

    text: str
    separator: str
    start: int
    commands: tuple[Command, ...]


def chain(text: str) -> list[Part]:
    """The pipelines of a command; their texts and separators put together are the command again. Background jobs aren't read."""
    parts: list[Part] = []
    begin, held, commands = 0, [], []
    tokens = read(text)
    for t in [*tokens, Token("operator", "", len(text), len(text))]:
        if t.kind != "operator":
            held.append(t)
            continue
        if t.text in ("&", "|&", ";;"):
            raise Unreadable(t.text)
        commands.append(Command(tuple(held)))
        held = []
        if t.text != "|":
            parts.append(Part(text[begin : t.start], t.text, begin, tuple(commands)))
            begin, commands = t.end, []
    return parts

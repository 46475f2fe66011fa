"""Facts of Python source, by the standard library's parser."""

from __future__ import annotations

import ast

from symlattice.sources.facts import FileFacts


class _Reader(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.facts, self.lines = FileFacts(path), text.split("\n")
        self.owner: str | None = None
        self.class_name: str | None = None
        self.class_body = False

    def _signature(self, node: ast.stmt) -> str:
        first = self.lines[node.lineno - 1].encode()[node.col_offset :].decode(errors="ignore")
        return first.split(":", 1)[0]

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = self.class_name is not None and self.owner is None
        exported = self.class_name is None and self.owner is None
        qualified = f"{self.class_name}.{node.name}" if inside else None
        for d in node.decorator_list:
            self.visit(d)
        made = self.facts.symbol("method" if inside else "function", node.name, node.lineno, node.end_lineno or node.lineno, exported, self._signature(node), qualified)
        self._below(node, made, None, skip=node.decorator_list)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        exported = self.class_name is None and self.owner is None
        made = self.facts.symbol("class", node.name, node.lineno, node.end_lineno or node.lineno, exported, self._signature(node))
        for b in node.bases:
            if isinstance(b, ast.Name | ast.Attribute):
                self.facts.base(made, "extends", ast.unparse(b), b.lineno)
        self._below(node, None, node.name, skip=node.decorator_list)

    def _below(self, node: ast.AST, owner: str | None, class_name: str | None, skip: list) -> None:
        before = self.owner, self.class_name
        self.owner, self.class_name = owner, class_name
        for child in ast.iter_child_nodes(node):
            if child not in skip:
                self.visit(child)
        self.owner, self.class_name = before

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.facts.call(self.owner, node.func.id, False, node.lineno)
        elif isinstance(node.func, ast.Attribute):
            self.facts.call(self.owner, node.func.attr, True, node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.facts.bind(a.name, a.asname or a.name, "*", "namespace")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name == "*":
                self.facts.bind(module, "*", "*", "star-reexport")
            else:
                self.facts.bind(module, a.asname or a.name, a.name, "named")


def extract(path: str, text: str) -> FileFacts:
    """Functions, methods, classes and their bases, calls and imports. Text that is no Python (any more) gives no facts."""
    reader = _Reader(path, text)
    try:
        reader.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return FileFacts(path)
    return reader.facts

"""Project configuration: path aliases and workspace packages."""

from __future__ import annotations

import fnmatch
import json
import os
import re

from symlattice.operators.resolve import ResolveConfig

EXTENDS_DEPTH = 8
#: Where packages are looked for when a root package names no workspaces.
DEFAULT_WORKSPACES = ("packages/*", "apps/*", "libs/*")
_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)


def parse_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas; {} if it can't be read or is no object."""
    once = _JSONC.sub(lambda m: m[1] or "", text)
    try:
        found = json.loads(_JSONC.sub(lambda m: m[1] or "", once))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _read(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as file:
            return parse_jsonc(file.read())
    except (OSError, UnicodeDecodeError):
        return {}


def compiler_paths(root: str, name: str = "tsconfig.json", depth: int = 0) -> tuple[dict[str, list[str]], str | None]:
    """Aliases and base folder of a configuration and what it extends; its own keys come before a parent's."""
    own = _read(os.path.join(root, name))
    paths, base = {}, None
    parent = own.get("extends")
    if isinstance(parent, str) and depth < EXTENDS_DEPTH and own:
        paths, base = compiler_paths(root, os.path.normpath(os.path.join(os.path.dirname(name), parent)), depth + 1)
    options = own.get("compilerOptions") or {}
    if isinstance(options.get("baseUrl"), str):
        base = options["baseUrl"]
    for pattern, targets in (options.get("paths") or {}).items():
        if isinstance(targets, list):
            paths[pattern] = [t for t in targets if isinstance(t, str)]
    return paths, base


def workspace_packages(root: str) -> dict[str, str]:
    """Package names and their folders; the root's own package is ``.``."""
    top = _read(os.path.join(root, "package.json"))
    spaces = top.get("workspaces")
    spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
    patterns = [p for p in spaces if isinstance(p, str)] if isinstance(spaces, list) else list(DEFAULT_WORKSPACES)
    out = {top["name"]: "."} if isinstance(top.get("name"), str) else {}
    for pattern in patterns:
        folder, _, last = pattern.strip("/").rpartition("/")
        if "*" not in last:
            found = [pattern.strip("/")]
        else:
            where = os.path.join(root, folder)
            found = [f"{folder}/{d}".strip("/") for d in sorted(os.listdir(where) if os.path.isdir(where) else []) if fnmatch.fnmatch(d, last)]
        for d in found:
            name = _read(os.path.join(root, d, "package.json")).get("name")
            if isinstance(name, str):
                out[name] = d
    return out


def load_config(root: str) -> ResolveConfig:
    paths, base = compiler_paths(root)
    return ResolveConfig(paths, base, workspace_packages(root))

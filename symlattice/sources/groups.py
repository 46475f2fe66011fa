"""Named groups of repositories, in a JSON file."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

GROUP_VARIABLE = "SYMLATTICE_GROUP"


class Groups:
    """A registry; a missing file is an empty one. Every change is written at once, by a rename."""

    def __init__(self, path: str):
        self.path = path
        self.groups: dict[str, list[str]] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                self.groups = {k: list(v.get("roots", [])) for k, v in json.load(file).get("groups", {}).items()}

    def _save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        body = {"version": 1, "groups": {k: {"roots": v} for k, v in sorted(self.groups.items())}}
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(self.path)), delete=False, encoding="utf-8") as file:
            json.dump(body, file, indent=2)
        os.replace(file.name, self.path)

    def list(self) -> list[tuple[str, list[str]]]:
        return sorted(self.groups.items())

    def add(self, group: str, root: str) -> None:
        """Add a folder that exists, under its canonical path; twice is once."""
        if not os.path.isdir(root):
            raise ValueError(f"no such folder: {root}")
        roots = self.groups.setdefault(group, [])
        if os.path.realpath(root) not in roots:
            roots.append(os.path.realpath(root))
        self._save()

    def remove(self, group: str, root: str) -> None:
        if os.path.realpath(root) not in self.roots(group):
            raise ValueError(f"{root} is not in group {group}")
        self.groups[group].remove(os.path.realpath(root))
        self._save()

    def remove_group(self, group: str) -> None:
        self.roots(group)
        del self.groups[group]
        self._save()

    def roots(self, group: str) -> list[str]:
        if group not in self.groups:
            raise ValueError(f"no group named {group}")
        return list(self.groups[group])

    def scope(self, root: str, group: str | None = None) -> list[str]:
        """The repositories meant: those of an explicit group, of the variable's, of the group whose members all lie right in ``root``, else ``root``."""
        named = group or os.environ.get(GROUP_VARIABLE, "").strip()
        if named:
            roots = self.roots(named)
            if not roots:
                raise ValueError(f"group {named} is empty")
            return roots
        real = os.path.realpath(root)
        if any(real in roots for roots in self.groups.values()):
            return [real]
        above = [roots for roots in self.groups.values() if roots and all(os.path.dirname(r) == real for r in roots)]
        return above[0] if len(above) == 1 else [real]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g, r) for g, roots in self.list() for r in roots], "grp string, root string")

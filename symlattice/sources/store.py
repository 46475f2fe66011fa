"""The graph of one repository as Parquet tables, replaced whole by one rename."""

from __future__ import annotations

import json
import os
import shutil
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = "1"
LOCK_SECONDS = 120
_NODE = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, exported boolean, signature string, node_seq long"
_EDGE = "edge_id long, src_id string, dst_id string, kind string, raw_name string, resolved boolean, conf string, reason string, provenance string, file_path string, line int"
SCHEMAS = {
    "files": "path string, hash string, mtime_ms long, size long, language string, indexed_at long",
    "nodes": _NODE,
    "edges": _EDGE,
    "bindings": "bind_seq long, file_path string, local_name string, source_module string, imported_name string, kind string",
    "node_attrs": "node_id string, key string, value string",
    "vectors": "id string, node_seq long, bucket int, weight long",
    "lines": "path string, line_no long, line string",
}


class GraphStore:
    """Tables below ``path``: each version in a folder of its own, and a file that names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return os.path.exists(os.path.join(self.path, "_CURRENT"))

    def _folder(self) -> str:
        with open(os.path.join(self.path, "_CURRENT"), encoding="utf-8") as file:
            return os.path.join(self.path, file.read().strip())

    def read(self, table: str) -> DataFrame:
        """A table of the current version, with its fixed schema; an empty one if nothing is stored. Never creates anything."""
        folder = os.path.join(self._folder(), table) if self.exists() else ""
        if not os.path.isdir(folder):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(folder)

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables as a new version and make it the current one; what isn't given is carried over. Older versions go."""
        name = f"v{time.time_ns()}"
        old = self._folder() if self.exists() else None
        for table, schema in SCHEMAS.items():
            target = os.path.join(self.path, name, table)
            if table in tables:
                columns = [c.split()[0] for c in schema.split(", ")]
                kinds = [c.split()[1] for c in schema.split(", ")]
                df = tables[table]
                df.select(*[df[c].cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)]).write.parquet(target)
            elif old and os.path.isdir(os.path.join(old, table)):
                shutil.copytree(os.path.join(old, table), target)
        self._replace("_CURRENT", name)
        for other in os.listdir(self.path):
            if other.startswith("v") and other != name and os.path.isdir(os.path.join(self.path, other)):
                shutil.rmtree(os.path.join(self.path, other), ignore_errors=True)

    def _replace(self, name: str, text: str) -> None:
        os.makedirs(self.path, exist_ok=True)
        made = os.path.join(self.path, f".{name}.{os.getpid()}")
        with open(made, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(made, os.path.join(self.path, name))

    def meta(self) -> dict[str, str]:
        try:
            with open(os.path.join(self.path, "_meta.json"), encoding="utf-8") as file:
                return json.load(file)
        except (OSError, ValueError):
            return {}

    def set_meta(self, **values: str | None) -> None:
        """Set keys; None removes one."""
        merged = self.meta() | {"schema_version": SCHEMA_VERSION} | values
        self._replace("_meta.json", json.dumps({k: v for k, v in merged.items() if v is not None}))

    def count(self, table: str) -> int:
        return self.read(table).count()

    @contextmanager
    def lock(self):
        """One writer at a time: yields whether the lock was got. One that is old or can't be read is taken over, once."""
        os.makedirs(self.path, exist_ok=True)
        name, got = os.path.join(self.path, "lock"), False
        for _ in range(2):
            try:
                with os.fdopen(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as file:
                    file.write(json.dumps({"pid": os.getpid(), "at": time.time()}))
                got = True
                break
            except FileExistsError:
                if not self._stale(name):
                    break
                os.unlink(name)
        try:
            yield got
        finally:
            if got and os.path.exists(name):
                os.unlink(name)

    @staticmethod
    def _stale(name: str) -> bool:
        try:
            with open(name, encoding="utf-8") as file:
                return time.time() - float(json.load(file)["at"]) > LOCK_SECONDS
        except FileNotFoundError:
            return False
        except (OSError, ValueError, KeyError, TypeError):
            return True

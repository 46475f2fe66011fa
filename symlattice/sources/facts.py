"""What is read from one source file, and the table that holds it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, language string, hash string,"
    "symbols array<struct<id:string,kind:string,name:string,qualified_name:string,start_line:int,end_line:int,exported:boolean,signature:string>>,"
    "calls array<struct<from_id:string,name:string,member:boolean,line:int>>,"
    "refs array<struct<from_id:string,name:string,line:int>>,"
    "heritage array<struct<src_id:string,kind:string,raw_name:string,line:int>>,"
    "bindings array<struct<local_name:string,source_module:string,imported_name:string,kind:string>>"
)


def module_id(path: str) -> str:
    return f"{path}#<module>"


def symbol_id(path: str, name: str, line: int) -> str:
    return f"{path}#{name}@{line}"


def cut_bytes(text: str, most: int = 200) -> str:
    """At most ``most`` bytes of a text, no character cut through."""
    return text.encode()[:most].decode(errors="ignore")


@dataclass
class FileFacts:
    path: str
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    heritage: list[dict] = field(default_factory=list)
    bindings: list[dict] = field(default_factory=list)

    def symbol(self, kind: str, name: str, start: int, end: int, exported: bool, signature: str, qualified: str | None = None) -> str:
        made = symbol_id(self.path, name, start)
        self.symbols.append({"id": made, "kind": kind, "name": name, "qualified_name": qualified or name, "start_line": start, "end_line": end, "exported": exported, "signature": cut_bytes(signature.strip())})
        return made

    def call(self, owner: str | None, name: str, member: bool, line: int) -> None:
        self.calls.append({"from_id": owner or module_id(self.path), "name": name, "member": member, "line": line})

    def ref(self, owner: str | None, name: str, line: int) -> None:
        self.refs.append({"from_id": owner or module_id(self.path), "name": name, "line": line})

    def base(self, src_id: str, kind: str, raw: str, line: int) -> None:
        self.heritage.append({"src_id": src_id, "kind": kind, "raw_name": raw, "line": line})

    def bind(self, module: str, local: str, imported: str, kind: str) -> None:
        if local and module:
            self.bindings.append({"local_name": local, "source_module": module, "imported_name": imported, "kind": kind})


def extract(path: str, language: str, text: str) -> FileFacts:
    """Facts of a file in a known language. Source that can't be parsed gives what could be read of it."""
    from symlattice.sources import python_source, script_source

    return python_source.extract(path, text) if language == "py" else script_source.extract(path, text)


def extract_facts(files: DataFrame) -> DataFrame:
    """One row of facts for each file (path, language, content binary). Files that aren't UTF-8 are left out."""
    import hashlib

    def run(batches):
        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf.path, pdf.language, pdf.content, strict=True):
                try:
                    text = bytes(content).decode()
                except UnicodeDecodeError:
                    continue
                f = extract(path, language, text)
                rows.append((path, language, hashlib.sha256(bytes(content)).hexdigest(), f.symbols, f.calls, f.refs, f.heritage, f.bindings))
            yield pd.DataFrame(rows, columns=["path", "language", "hash", "symbols", "calls", "refs", "heritage", "bindings"])

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """Symbols, calls, refs, heritage and bindings as flat tables with an order (``seq`` and its like): path, then place in the file.

    The order is two numbers in one, the file's rank and the place within it, so that no global sort of rows is needed.
    """
    names = {"symbols": "seq", "calls": "call_seq", "refs": "ref_seq", "heritage": "seq", "bindings": "bind_seq"}
    from symlattice.plans.prefix import ordered_cumsum

    order = ordered_cumsum(facts.select("path").withColumn("one", F.lit(1)), ["path"], "one", "file_rank").select("path", "file_rank")
    placed = facts.join(order, "path")
    out = {}
    for table, seq in names.items():
        rows = placed.select(F.col("path").alias("file_path"), "file_rank", F.posexplode(table).alias("at", "x"))
        out[table] = rows.select("file_path", (F.col("file_rank") * (1 << 24) + F.col("at")).alias(seq), "x.*")
    return out

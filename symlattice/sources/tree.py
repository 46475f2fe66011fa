"""Source trees as tables of files."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.functions.paths import LANGUAGES, STORE_DIR, lang_of, tracked
from symlattice.functions.text import lines_of


def glob_regex(pattern: str) -> str:
    """A gitignore pattern without its leading and trailing slash, as a regular expression over path parts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i + 1] if c == "\\" and i + 1 < len(pattern) else c), i + (2 if c == "\\" else 1)
    return out


def ignore_rules(folder: str, text: str) -> list[tuple[str, bool]]:
    """(regex over paths from the root, ignored?) for each line of the ignore file in ``folder`` ("" for the root)."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        pattern = line[1:] if keep else line
        only_folder, pattern = pattern.endswith("/"), pattern.rstrip("/")
        anchored = "/" in pattern
        pattern = pattern.lstrip("/")
        start = "^" + (re.escape(folder) + "/" if folder else "") + ("" if anchored else "(?:.*/)?")
        rules.append((start + glob_regex(pattern) + ("/.*$" if only_folder else "(?:/.*)?$"), not keep))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path, or a folder above it, says so. Rules of deeper folders come last."""
    out = F.lit(False)
    for regex, says in rules:
        out = F.when(path.rlike(regex), F.lit(says)).otherwise(out)
    return out


def walk(root: str) -> list[tuple[str, int, int]]:
    """(path, mtime_ms, size) of the files below a folder; what ignore files rule out isn't entered. A file that can't be looked at has zeros."""
    out: list[tuple[str, int, int]] = []

    def enter(rel: str, rules: list[tuple[re.Pattern, bool]]) -> None:
        here = os.path.join(root, rel) if rel else root
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return
        if any(e.name == ".gitignore" for e in entries):
            try:
                with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as file:
                    rules = rules + [(re.compile(regex), says) for regex, says in ignore_rules(rel, file.read())]
            except OSError:
                pass
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            folder = e.is_dir(follow_symlinks=False)
            says = False
            for regex, rule in rules:
                if regex.search(path + "/" if folder else path):
                    says = rule
            if says or e.name in (".git", STORE_DIR):
                continue
            if folder:
                enter(path, rules)
            elif e.is_file():
                try:
                    stat = e.stat()
                    out.append((path, int(stat.st_mtime * 1000), stat.st_size))
                except OSError:
                    out.append((path, 0, 0))

    enter("", [])
    return out


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, mtime_ms, size, language[, content]) of the tracked files below ``root``, ignore files honoured.

    A folder is walked by the driver, which reads names and times alone; contents are read by the executors, to whom the
    folder must be mounted. (Spark's own listing leaves out names that begin with ``_`` or a dot.) Of a path with
    a scheme, Spark lists and reads the files.
    """
    if re.match(r"^[a-z0-9]+://", root):
        return _listed(spark, root, content)
    known = re.compile(rf"\.({'|'.join(e for ends in LANGUAGES.values() for e in ends)})$", re.I)
    rows = [r for r in walk(root) if known.search(r[0])]
    files = spark.createDataFrame(rows, "path string, mtime_ms long, size long").where(tracked(F.col("path"))).withColumn("language", lang_of(F.col("path")))
    if not content:
        return files

    def read(batches):
        for pdf in batches:
            contents = []
            for path in pdf.path:
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        contents.append(file.read())
                except OSError:
                    contents.append(None)
            yield pdf.assign(content=contents)

    return files.mapInPandas(read, "path string, mtime_ms long, size long, language string, content binary").where("content is not null")


def _listed(spark: SparkSession, root: str, content: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    columns = [rel.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), lang_of(rel).alias("language")]
    return files.where(tracked(rel)).select(*columns, *(["content"] if content else []))


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of files with content."""
    text = F.decode("content", "UTF-8")
    return files.select("path", F.posexplode(lines_of(text)).alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def hit_lines(spark: SparkSession, text: str) -> DataFrame:
    """(ord, raw) of a text of hits, such as a search tool prints."""
    lines = text.removesuffix("\n").split("\n")
    return spark.createDataFrame([(i, line.removesuffix("\r")) for i, line in enumerate(lines, 1)], "ord long, raw string")

"""Folding text-search hits by the symbol around them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.functions.text import clip, line_list
from symlattice.plans.prefix import ordered_cumsum

PASS_BELOW, MAX_ROWS, MAX_LOOSE, MAX_INPUT = 500, 40, 3, 4 << 20


def parse_hits(lines: DataFrame) -> DataFrame:
    """(ord, path, line, text, parsed) of lines (ord, raw): the first ``:digits:`` ends the path. Empty lines are left out."""
    pattern = r"^(.+?):([0-9]+):(.*)$"
    number = F.expr("try_cast(nullif(h_line, '') as bigint)")
    rows = lines.where("raw <> ''").withColumn("h_line", F.regexp_extract("raw", pattern, 2))
    return rows.select("ord", F.regexp_extract("raw", pattern, 1).alias("path"), number.alias("line"), F.regexp_extract("raw", pattern, 3).alias("text"), number.isNotNull().alias("parsed"))


def symbol_spans(nodes: DataFrame) -> DataFrame:
    """(path, span_seq, kind, name, start, end): nodes with lines, those of routes included."""
    some = nodes.where("kind not in ('community', 'process') and start_line > 0")
    return some.select(F.col("file_path").alias("path"), F.col("node_seq").alias("span_seq"), "kind", "name", F.col("start_line").alias("start"), F.col("end_line").alias("end"))


def enclosing(hits: DataFrame, spans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Hits with in_graph and the innermost span around each (null: top level): shortest, then latest start, then first.

    Files of the graph are those of ``known`` (path), or, without it, those that have spans. A range join within a file; the innermost of the spans of a hit is an aggregate, not a window.
    """
    known = (spans if known is None else known).select("path").distinct().withColumn("in_graph", F.lit(True))
    around = hits.select("ord", "path", "line").join(spans, "path").where("start <= line and line <= end")
    best = around.groupBy("ord").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("late"), F.col("span_seq"), "kind", "name", "start", "end")).alias("s"))
    best = best.select("ord", F.struct("s.span_seq", "s.kind", "s.name", "s.start", "s.end").alias("owner"))
    return hits.join(known, "path", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False))).join(best, "ord", "left")


def fold_groups(owned: DataFrame) -> DataFrame:
    """One row for each file and owner, of files in the graph: path, owner, n, lines (in hit order), text of the first, first_ord."""
    some = owned.where("in_graph").groupBy("path", "owner").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"), F.min_by("text", "ord").alias("text"), F.min("ord").alias("first_ord"))
    return some.select("path", "owner", "n", F.transform("l", lambda x: x.line).alias("lines"), "text", "first_ord")


def loose_lines(owned: DataFrame, most: int = MAX_LOOSE) -> DataFrame:
    """The first hits of files outside the graph: path, ord, line, text, place (from 1) and n, the file's hits."""
    rest = owned.where("not in_graph")
    place = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    total = rest.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return rest.withColumn("place", place).where(F.col("place") <= most).join(total, "path").select("path", "ord", "line", "text", "place", "n")


def fold_rows(owned: DataFrame) -> DataFrame:
    """All rows of a folded answer: path, file_ord, row_ord, head, count, lines, text, in_graph, more (loose hits beyond the shown)."""
    files = owned.groupBy("path").agg(F.min("ord").alias("file_ord"))
    head = F.when(F.col("owner").isNull(), "(top level)").otherwise(F.concat(F.col("owner.start").cast("string"), F.lit("-"), F.col("owner.end").cast("string"), F.lit(" "), "owner.kind", F.lit(" "), "owner.name"))
    grouped = fold_groups(owned).select("path", F.col("first_ord").alias("row_ord"), head.alias("head"), F.col("n").alias("count"), line_list(F.col("lines")).alias("lines"), clip(F.col("text")).alias("text"), F.lit(True).alias("in_graph"), F.lit(0).cast("long").alias("more"))
    last = F.when(F.col("place") == F.least(F.lit(MAX_LOOSE), F.col("n")), F.greatest(F.lit(0), F.col("n") - MAX_LOOSE)).otherwise(0)
    loose = loose_lines(owned).select("path", F.col("ord").alias("row_ord"), F.lit("").alias("head"), F.lit(1).cast("long").alias("count"), F.col("line").cast("string").alias("lines"), clip(F.col("text")).alias("text"), F.lit(False).alias("in_graph"), last.cast("long").alias("more"))
    return grouped.unionByName(loose).join(files, "path")


def fold_cap(rows: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """Rows with shown (the row is within the cap): once ``most`` rows are out, the rest of a graph file and all later files are cut.

    A file outside the graph is shown whole once it has begun.
    """
    placed = ordered_cumsum(rows.withColumn("one", F.lit(1)), ["file_ord", "row_ord"], "one", "at").withColumn("at", F.col("at") + 1).drop("one")
    begun = F.min("at").over(Window.partitionBy("path"))
    return placed.withColumn("shown", F.when(F.col("in_graph"), F.col("at") <= most).otherwise(begun <= most))


def cut_counts(capped: DataFrame) -> DataFrame:
    """One row: rows and files that the cap leaves out."""
    return capped.where("not shown").agg(F.count(F.lit(1)).alias("cut_rows"), F.count_distinct("path").alias("cut_files"))


def fold(lines: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> tuple[str | None, dict]:
    """The folded text of hit lines (ord, raw), and figures; or None and the reason for which there is none: unparsed, no-graph."""
    hits = parse_hits(lines)
    if hits.where("not parsed").limit(1).count():
        return None, {"reason": "unparsed"}
    owned = enclosing(hits, symbol_spans(nodes), known)
    capped = fold_cap(fold_rows(owned)).orderBy("at").collect()  # of at most 4 MiB of input
    if not any(r.in_graph for r in capped):
        return None, {"reason": "no-graph"}
    n_hits, files = sum(r["count"] for r in capped if r.in_graph) + sum(1 + r.more for r in capped if not r.in_graph), {r.path for r in capped}
    out, last = [f"fold: {n_hits} hits in {len(files)} files, by enclosing symbol (repeat the grep once for raw lines)"], None
    for r in capped:
        if not r.shown:
            continue
        if r.path != last:
            out.append(r.path)
            last = r.path
        out.append(f"  {r.head} ×{r['count']} L{r.lines}: {r.text}" if r.in_graph else f"  L{r.lines}: {r.text}")
        if r.more:
            out.append(f"  +{r.more} more")
    hidden = [r for r in capped if not r.shown]
    if hidden:
        out.append(f"… +{len(hidden)} more rows in {len({r.path for r in hidden})} files")
    return "\n".join(out) + "\n", {"hits": n_hits, "files": len(files), "symbols": sum(r.in_graph for r in capped)}


def fold_text(text: str, folded: Callable[[], tuple[str | None, dict]], head: int | None = None, cut: str | None = None, strip: str | None = None) -> tuple[str, dict]:
    """A text of hits, folded if that is smaller, and figures; or as it came, without a leading ``strip:`` in its lines, and the reason.

    Reasons: empty, small, huge, not-smaller and those of ``folded``, which is called only if its result is needed. ``head`` and ``cut``
    are what comes after in the caller's pipe; sizes are compared as they leave it.
    """
    size = lambda x: len(tail_view(x, head, cut).encode())
    if not text:
        return "", {"reason": "empty"}
    if len(text.encode()) > MAX_INPUT:
        return text, {"reason": "huge"}
    plain = re.sub(rf"(?m)^{re.escape(strip)}:", "", text) if strip else text
    if size(plain) <= PASS_BELOW:
        return plain, {"reason": "small"}
    out, stats = folded()
    if out is None:
        return plain, stats
    if len(out.encode()) >= len(text.encode()) or size(out) >= size(plain):
        return plain, {"reason": "not-smaller"}
    return out, {"raw_chars": size(plain), "out_chars": size(out), **stats}


def log_line(text: str, stats: dict, tag: str | None = None, head: int | None = None, cut: str | None = None) -> dict:
    """What is logged of a fold: sizes and figures, and why a text went out as it came."""
    seen = len(tail_view(text, head, cut).encode())
    figures = {"raw_chars": seen, "out_chars": seen, "folded": "reason" not in stats, "hits": 0, "files": 0, "symbols": 0}
    figures |= {k: v for k, v in stats.items() if k in figures}
    return ({"tag": tag} if tag else {}) | figures | ({"pass": stats["reason"]} if "reason" in stats else {})


def parse_cut(cut: str) -> list[tuple[int, int | None]] | None:
    """``N``, ``N-``, ``-M`` and ``N-M``, comma-separated and 1-based; None if it is no such list."""
    out = []
    for part in cut.split(","):
        a, dash, b = part.partition("-")
        if not dash:
            b = a
        if any(x and not x.isdecimal() for x in (a, b)) or not (a or dash):
            return None
        low, high = int(a) if a else 1, int(b) if b else None
        if low < 1 or high is not None and low > high:
            return None
        out.append((low, high))
    return out


def keep_chars(line: Column, ranges: list[tuple[int, int | None]]) -> Column:
    """The characters of a line that ``cut -c`` keeps, each once and in order."""
    chars = F.split(line, "")
    keep = lambda i: _any([(i >= a - 1) & (F.lit(True) if b is None else i <= b - 1) for a, b in ranges])
    return F.array_join(F.filter(chars, lambda c, i: keep(i)), "")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def tail_view(text: str, head: int | None = None, cut: str | None = None) -> str:
    """A text as it leaves ``| head -N | cut -c LIST``."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)[:head]
    ranges = parse_cut(cut) if cut else None
    if ranges is None:
        return "".join(lines)
    out = []
    for line in lines:
        body, end = (line[:-1], "\n") if line.endswith("\n") else (line, "")
        out.append("".join(c for i, c in enumerate(body, 1) if any(a <= i and (b is None or i <= b) for a, b in ranges)) + end)
    return "".join(out)

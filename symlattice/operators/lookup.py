"""Finding symbols by name, and where a name occurs in text alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.functions.text import has_word

SAME_NAME_MOST, TEXT_ONLY_MOST = 6, 12
#: Node kinds made from the graph rather than from source.
DERIVED_KINDS = ("community", "process")


def _pick_order() -> list[Column]:
    return [F.col("exported").cast("int").desc(), F.col("start_line").asc(), F.col("node_seq").asc()]


def by_id(nodes: DataFrame, node_id) -> DataFrame:
    return nodes.where(F.col("id") == F.lit(node_id))


def pick_symbol(nodes: DataFrame, name: str, include_derived: bool = True) -> DataFrame:
    """The symbol meant by a name: exported first, then by line, then by order; one row or none.

    A cluster's node has its hub's name and line 0: with ``include_derived`` it comes before a hub that isn't exported.
    """
    found = nodes.where(F.col("name") == name)
    if not include_derived:
        found = found.where(~F.col("kind").isin(*DERIVED_KINDS))
    return found.orderBy(*_pick_order()).limit(1)


def pick_symbols(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``pick_symbol`` for a whole table of names at once: one aggregate instead of a query each."""
    order = F.struct((~F.col("exported")).cast("int").alias("e"), "start_line", "node_seq")
    return nodes.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min_by("id", order).alias("id"), F.count(F.lit(1)).alias("same_name"))


def same_name(nodes: DataFrame, name: str) -> DataFrame:
    """The other symbols of the picked one's name; order by exported descending, file, line."""
    picked = pick_symbol(nodes, name).select("id", "node_seq")
    return nodes.where(F.col("name") == name).join(picked, ["id", "node_seq"], "left_anti")


def word_mentions(lines: DataFrame, name: str) -> DataFrame:
    """(path, first_line, n_lines) of files (path, line_no, line) with the name as a whole word."""
    return lines.where(has_word(F.col("line"), name)).groupBy("path").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


def linked_files(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Files that declare the name, or hold a resolved call or reference to a symbol of it."""
    own = nodes.where(F.col("name") == name)
    into = edges.where("kind in ('calls', 'references') and resolved").join(own.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return own.select(F.col("file_path").alias("path")).union(into.select("file_path")).distinct()


def text_only_mentions(lines: DataFrame, nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(path, first_line, n_lines, mention): word matches in files that the graph doesn't link to the name."""
    found = word_mentions(lines, name).join(linked_files(nodes, edges, name), "path", "left_anti")
    more = F.when(F.col("n_lines") > 1, F.concat(F.lit("  (+"), (F.col("n_lines") - 1).cast("string"), F.lit(" lines)"))).otherwise("")
    return found.withColumn("mention", F.concat(F.col("path").cast("string"), F.lit(":"), F.col("first_line").cast("string"), more))


def grep_gap(lines: DataFrame, nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: n_same_name (the picked symbol included), n_text_only, and why the graph can't stand in for a text search (null: it can)."""
    same = nodes.where(F.col("name") == name).agg(F.count(F.lit(1)).alias("n_same_name"))
    text = text_only_mentions(lines, nodes, edges, name).agg(F.count(F.lit(1)).alias("n_text_only"))
    why = F.when(F.col("n_same_name") > SAME_NAME_MOST, "same-name").when(F.col("n_text_only") > TEXT_ONLY_MOST, "text-only")
    return same.crossJoin(text).withColumn("gap", why)  # one row each


def snippet(files: DataFrame, path: str, start: int, end: int, budget: int = 1600) -> DataFrame:
    """Lines ``start`` to ``end`` of a file (path, text), at most ``budget`` bytes of them and then a mark."""
    part = F.array_join(F.slice(F.split("text", "\n"), max(1, start), max(0, end - max(1, start) + 1)), "\n")
    raw = F.encode(part, "UTF-8")
    # a byte 10xxxxxx goes on with a character: at most three of them are stepped back over
    inside = lambda n: F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]")
    end = F.coalesce(*[F.when(~inside(n), F.lit(n)) for n in range(budget, max(0, budget - 4), -1)], F.lit(budget))
    cut = F.decode(F.substring(raw, F.lit(1), end), "UTF-8")
    return files.where(F.col("path") == path).select("path", F.when(F.octet_length(part) > budget, F.concat(cut, F.lit("\n…"))).otherwise(part).alias("snippet"))

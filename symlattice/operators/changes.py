"""What a diff touches, and what that affects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.operators.graph import MAX_DEPTH, blast_hops

#: The new side of a hunk header: start, and a count that is 1 when left out.
_HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def parse_hunks(diff: DataFrame, *by: str) -> DataFrame:
    """(file_path, start, end, unmappable) of diff lines (ord, line): one row a hunk, and one for each file without any.

    ``+++ b/path`` opens a file, ``/dev/null`` makes it unmappable (a null path). A pure deletion has no range, but its file
    is kept; a header that can't be read makes the file unmappable. ``by`` names columns that keep diffs apart (their
    lines are one task's); without it a diff is one sequence.
    """
    target = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1)
    opens = F.when(F.col("line").startswith("+++ "), F.when(target == "/dev/null", F.struct(F.lit(None).cast("string").alias("path"), "ord")).otherwise(F.struct(target.alias("path"), "ord")))
    window = Window.partitionBy(*by).orderBy("ord")
    marked = diff.withColumn("file", F.last(opens, ignorenulls=True).over(window)).where("file is not null and (line like '@@%' or line like '+++ %')")
    start, count = F.regexp_extract("line", _HEADER, 1), F.regexp_extract("line", _HEADER, 2)
    is_hunk = F.col("line").startswith("@@")
    first, n = F.expr("try_cast(nullif(h_start, '') as bigint)"), F.expr("coalesce(try_cast(nullif(h_count, '') as bigint), 1)")
    rows = marked.withColumn("h_start", start).withColumn("h_count", count).withColumn("is_hunk", is_hunk)
    rows = rows.withColumn("s", F.when(F.col("is_hunk"), first)).withColumn("n", F.when(F.col("is_hunk"), n))
    per_file = rows.groupBy(*by, F.col("file.path").alias("file_path"), F.col("file.ord").alias("file_ord")).agg(
        F.collect_list(F.when(F.col("s").isNotNull() & (F.col("n") > 0), F.struct(F.col("s").alias("start"), (F.col("s") + F.col("n") - 1).alias("end")))).alias("ranges"),
        (F.max((F.col("is_hunk") & F.col("s").isNull()).cast("int")) == 1).alias("bad"),
    )  # the hunks of one file
    return per_file.select(*by, "file_path", "file_ord", F.explode_outer("ranges").alias("r"), (F.col("bad") | F.col("file_path").isNull()).alias("unmappable")).select(*by, "file_path", "file_ord", "r.start", "r.end", "unmappable")


def overlapping_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Distinct symbols whose lines meet a hunk's, within a file."""
    ranges = hunks.where("not unmappable and start is not null").select("file_path", F.col("start").alias("hunk_start"), F.col("end").alias("hunk_end"))
    met = nodes.join(ranges, "file_path").where("start_line <= hunk_end and hunk_start <= end_line")
    return met.select(*nodes.columns).dropDuplicates(["id"])


def is_partial(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """One row: files in the diff, those without a symbol that is touched (or unmappable), and whether there are any."""
    ranges = hunks.where("start is not null").select("file_path", F.col("start").alias("hunk_start"), F.col("end").alias("hunk_end"))
    hit = nodes.select("file_path", "start_line", "end_line").join(ranges, "file_path").where("start_line <= hunk_end and hunk_start <= end_line").select("file_path").distinct().withColumn("hit", F.lit(True))
    files = hunks.groupBy("file_path", "file_ord").agg(F.max(F.col("unmappable").cast("int")).alias("bad")).join(hit, "file_path", "left")
    lost = (F.col("bad") == 1) | F.col("hit").isNull()
    total = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(lost.cast("long")), F.lit(0)).alias("n_unmapped"))
    return total.withColumn("partial", F.col("n_unmapped") > 0)


def affected(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(depth, node) for all that reaches the changed symbols by calls; callers that are no node are left out."""
    seeds = changed.select("id", F.col("node_seq").alias("seed_seq"))
    hops = blast_hops(edges, seeds, depth)
    return hops.select("depth", F.col("src_id").alias("id")).join(nodes, "id")


def impact(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changed symbols (order by file, line), affected ones (order by depth, file, line), and the row of ``is_partial``."""
    changed = overlapping_symbols(nodes, hunks)
    return changed, affected(nodes, edges, changed, depth), is_partial(nodes, hunks)

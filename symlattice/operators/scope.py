"""Answers over several repositories: each table has a column ``repo``, and one query serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.operators.lookup import SAME_NAME_MOST, TEXT_ONLY_MOST, word_mentions


def infer_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, grp): the group that each root stands for, null where it stands for itself.

    ``members``: (grp, root). A member of any group is itself; the parent folder of all members of exactly one group is that group.
    """
    parent = F.regexp_extract("root", r"^(.*)/[^/]*$", 1)
    same = members.withColumn("parent", parent).groupBy("grp").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi")).where("lo = hi")
    above = same.groupBy(F.col("lo").alias("root")).agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("grp")).where("n = 1").select("root", "grp")
    own = members.select("root", F.lit(True).alias("member")).distinct()
    return roots.join(own, "root", "left").join(above, "root", "left").select("root", F.when(F.col("member").isNull(), F.col("grp")).alias("grp"))


def fan_out_search(nodes: DataFrame, word: str, limit: int = 25) -> DataFrame:
    """(repo, rank, id): in each repository the symbols that have a token, in node order, at most ``limit`` each."""
    has = F.array_contains(F.split(F.lower(F.concat_ws(" ", "name", "qualified_name", "file_path")), r"[^\p{IsAlphabetic}\p{N}]+"), word.lower())
    place = F.row_number().over(Window.partitionBy("repo").orderBy("node_seq"))
    return nodes.where(has).withColumn("rank", place).where(F.col("rank") <= limit).select("repo", "rank", "id")


def group_refusal(nodes: DataFrame, lines: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: same_name and text_only, the most of any repository that has the name, stray, files with it elsewhere, and refused.

    nodes, lines and edges have a column ``repo``. One repository's gap refuses the whole group's answer.
    """
    own = nodes.where(F.col("name") == name)
    same = own.groupBy("repo").agg(F.count(F.lit(1)).alias("same_name"))
    tagged = lines.select(F.struct("repo", "path").alias("path"), "line_no", "line")
    found = word_mentions(tagged, name).select("path.repo", F.col("path.path").alias("path"))
    into = edges.where("kind in ('calls', 'references') and resolved").join(own.select("repo", F.col("id").alias("dst_id")), ["repo", "dst_id"], "left_semi")
    linked = own.select("repo", F.col("file_path").alias("path")).union(into.select("repo", "file_path")).distinct()
    rest = found.join(linked, ["repo", "path"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("text_only"))
    each = same.join(rest, "repo", "full")
    most = lambda c: F.coalesce(F.max(F.when(F.col("same_name").isNotNull(), F.col(c))), F.lit(0)).alias(c)
    stray = F.coalesce(F.sum(F.when(F.col("same_name").isNull(), F.col("text_only"))), F.lit(0)).alias("stray")
    total = each.agg(most("same_name"), most("text_only"), stray)
    return total.withColumn("refused", (F.col("same_name") > SAME_NAME_MOST) | (F.col("text_only") > TEXT_ONLY_MOST) | (F.col("stray") > TEXT_ONLY_MOST))

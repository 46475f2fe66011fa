"""Whether a stored graph is out of date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change) of files (path, mtime_ms, size) that differ: added, removed or modified. One full outer join."""
    old = stored.select("path", F.col("mtime_ms").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("old"))
    new = found.select("path", F.col("mtime_ms").alias("new_mtime"), F.col("size").alias("new_size"), F.lit(True).alias("new"))
    both = old.join(new, "path", "full")
    moved = ~(F.col("old_mtime").eqNullSafe(F.col("new_mtime")) & F.col("old_size").eqNullSafe(F.col("new_size")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(moved, "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def dirty(stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many files were added, removed and modified, and whether there are any."""
    count = lambda what: F.coalesce(F.sum((F.col("change") == what).cast("long")), F.lit(0)).alias(what)
    total = file_changes(stored, found).agg(count("added"), count("removed"), count("modified"))
    return total.withColumn("dirty", F.col("added") + F.col("removed") + F.col("modified") > 0)

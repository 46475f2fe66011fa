"""Running sums over a total order, without one task ever holding all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.plans.scratch import scratch


def ordered_cumsum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order``.

    ``order`` must be a total order up to rows that are equal in every way. The rows are range
    partitioned by it, each range is summed, and the few range totals (one row per partition) are
    summed in order; a hot leading key spans as many ranges as it needs. A null ``value`` counts 0.
    """
    ranged = scratch(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    totals = ranged.groupBy("__pid").agg(F.sum(value).alias("__sum"))
    upto = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__pid", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__base"))
    # one row per range partition: bounded by the partition count, never by the data
    within = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(bases), "__pid")
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("__pid", "__base")
    )

"""Operator 10: exact top-k search by distributed histogram selection.

Every query is scored against every row. Global histograms of the scores are refined, digit by digit,
until the *k*-th highest value of each query is known; a last pass keeps the rows at or above it, and
ties at the value go to the smaller id. Queries are dealt into blocks and rows into slices, both of bounded size, and each pair of a block
and a slice is a group of its own, so that all queries are refined in the same few passes. How far a
query's value is known stands in a table; only histograms and the few rows kept are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.plans.scratch import discard, scratch

#: Queries of a block and rows of a slice, about: a group's memory, whatever their number.
QUERY_BLOCK, SLICE = 1024, 65_536
#: Bins of a histogram; each pass narrows a query's range of scores by this factor.
BINS = 512


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.when(F.forall(wide, finite), F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers: through doubles while every sum stays below 2**53, else in 64-bit integers."""
    bound = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    return (a @ b.T).astype(np.int64) if bound < 2.0**53 else a.astype(np.int64) @ b.T.astype(np.int64)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), the matched id under its own name, score: the ``k`` highest integer inner products.

    A row never matches itself: rows of the query's own id are left out. Fewer than ``k`` other rows
    give fewer results. Ties go to the smaller id. Null ids take no part, nor do vectors that are null or
    empty or hold null or non-finite components; vectors only meet vectors of their own length. Of rows that repeat an id
    each is a candidate; as a query the first by its vector counts. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    rows = scratch(rows.where("vid is not null and v is not null and size(v) > 0").withColumn("width", F.size("v")))
    n, m = rows.agg(F.count(F.when(F.col("q"), 1)), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    blocks, slices = -(-n // QUERY_BLOCK), -(-m // SLICE)
    dealt = lambda name, parts, seed: F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(parts))
    everywhere = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    key = ["width", "block", "slice"]
    candidates = rows.select("vid", "v", "width", dealt("vid", slices, 5).alias("slice"), everywhere(blocks).alias("block"))
    # by Cauchy-Schwarz no score is beyond the product of the norms; the k-th value is in [low, high), and ``above`` scores are at or above high
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    longest = rows.groupBy("width").agg(F.max(norm).alias("longest"))
    asked = rows.where("q").groupBy("vid", "width").agg(F.min("v").alias("v"))
    first = Window.partitionBy("vid").orderBy("v", "width")
    asked = asked.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    reach = F.ceil(norm * F.col("longest")) + 1
    state = asked.join(longest, "width").select(F.col("vid").alias("own"), "v", "width", dealt("vid", blocks, 3).alias("block"), (-reach).alias("low"), (reach + 1).alias("high"), F.lit(0).cast("long").alias("above"))
    state = scratch(state)
    while state.agg(F.max(F.col("high") - F.col("low"))).first()[0] > 1:
        groups = candidates.groupBy(*key).cogroup(state.withColumn("slice", everywhere(slices)).groupBy(*key))
        counted = groups.applyInArrow(_histogram, "own long, bin int, n long")
        bins = counted.groupBy("own", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("own").orderBy(F.desc("bin"))  # a row for each bin
        upto = bins.join(state.select("own", "above"), "own").withColumn("seen", F.col("above") + F.sum("n").over(down))
        hit = upto.where((F.col("seen") >= k) & (F.col("seen") - F.col("n") < k)).select("own", "bin", (F.col("seen") - F.col("n")).alias("before"))
        step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / BINS))
        low = F.col("low") + F.coalesce("bin", F.lit(0)) * step
        # fewer than k scores: all of them count
        high = F.when(F.col("bin").isNull(), F.col("low") + 1).otherwise(F.least("high", low + step))
        new = state.join(hit, "own", "left").select("own", "v", "width", "block", low.cast("long").alias("low"), high.cast("long").alias("high"), F.coalesce("before", "above").alias("above"))
        new = scratch(new)
        discard(state)
        state = new
    groups = candidates.groupBy(*key).cogroup(state.withColumn("slice", everywhere(slices)).groupBy(*key))
    found = groups.applyInArrow(_keep(k), "query_id long, vid long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vid").alias(id_col), "score")


def _scored(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of some rows of a slice, and the scores of a block's queries against them; a row of the query's own id scores least."""
    if not left.num_rows or not right.num_rows:
        return
    width = right.column("width")[0].as_py()
    own, q = right.column("own").to_numpy(), _matrix(right.column("v").combine_chunks(), width)
    for a in range(0, left.num_rows, 1024):
        part = left.slice(a, 1024)
        vid = part.column("vid").to_numpy()
        yield vid, np.where(own[:, None] == vid[None, :], np.iinfo(np.int64).min, _exact(q, _matrix(part.column("v").combine_chunks(), width)))


def _histogram(left: pa.Table, right: pa.Table) -> pa.Table:
    low, high = (right.column(c).to_numpy() for c in ("low", "high"))
    step = np.maximum(1, -(-(high - low) // BINS))
    counts = np.zeros((right.num_rows, BINS), np.int64)
    for _, score in _scored(left, right):
        q, c = np.nonzero((score >= low[:, None]) & (score < high[:, None]))
        counts += np.bincount(q * BINS + (score[q, c] - low[q]) // step[q], minlength=counts.size).reshape(counts.shape)
    q, used = np.nonzero(counts)
    return pa.table({"own": pa.array(right.column("own").to_numpy()[q], pa.int64()), "bin": pa.array(used, pa.int32()), "n": pa.array(counts[q, used], pa.int64())})


def _keep(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, low = (right.column(c).to_numpy() for c in ("own", "low"))
        best = np.zeros((3, 0), np.int64)
        for vid, score in _scored(left, right):
            q, c = np.nonzero(score >= low[:, None])
            found = np.concatenate([best, np.stack([q, -score[q, c], vid[c]])], axis=1)
            found = found[:, np.lexsort(found[::-1])]
            first = np.flatnonzero(np.r_[True, found[0][1:] != found[0][:-1]]) if found.shape[1] else np.zeros(0, int)
            rank = np.arange(found.shape[1]) - np.repeat(first, np.diff(np.r_[first, found.shape[1]]))
            best = found[:, rank < k]  # of the ties at the value a group needs no more than its k smallest ids
        return pa.table({"query_id": pa.array(own[best[0]], pa.int64()), "vid": pa.array(best[2], pa.int64()), "score": pa.array(-best[1], pa.int64())})

    return run

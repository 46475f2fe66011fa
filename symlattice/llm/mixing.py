"""Operator 2: mixing sources to target weights along a curriculum that changes over training.

Each source has a weight that changes over training time: ``weight * (1 + slope * (2 t - 1))``, t from 0 to
1. Its integral, scaled to the source's target, is the cumulative demand for the source's tokens; a
document copy whose middle token is the *c*-th of its source is trained on at the time at which
the demand reaches *c*, found by inverting the integral (a quadratic, in closed form). Copies range-sorted by this
position are the training order. How much is taken of a source doesn't depend on its schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.llm.text import SEPARATORS, unused
from symlattice.plans.prefix import ordered_cumsum
from symlattice.plans.scratch import scratch

WEIGHTS = (5, 2, 1)
#: Slopes of the weights over training time, repeating like the weights: the first falls, the last rises.
SLOPES = (-0.5, 0.0, 0.5)
SHARE = 1.5
MAX_EPOCHS = 2
#: Passes that fill what whole documents leave of a source's target.
FILL_PASSES = 3


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    # separators at the ends give one empty part each; a text of separators alone gives two, an empty one one
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, ordinal, target of a table (source, source_size): a row for each source.

    Water-filling: a source gets min(most * size, level * weight), with the level at which the sum is
    ``share`` of all sizes. Sources in order of most * size / weight stop one after the other; the
    level is that of the first prefix after which no other source would be above its stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("ordinal") % len(WEIGHTS) + 1).cast("int"))
    t = sources.withColumn("ordinal", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("stop", most * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("stop") / F.col("w"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("need", share * F.sum("source_size").over(every)).withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    t = t.withColumn("level", (F.col("need") - F.coalesce(F.sum("stop").over(order), F.lit(0.0))) / F.col("rest"))
    # every source is free of its stop at its own level or is stopped; the first free one has the level of all
    t = t.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct((F.col("stop") / F.col("w")).alias("r"), "ordinal", "level"))).over(every))
    return t.select("source", "source_size", "ordinal", F.least("stop", F.coalesce(F.col("final.level") * F.col("w"), F.col("stop"))).alias("target"))


def training_position(part: Column, slope: Column) -> Column:
    """Time in [0, 1] at which a share ``part`` of the target has been demanded: the inverse of
    (1 - slope) t + slope t**2."""
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-9, part).otherwise((F.sqrt(b * b + 4 * slope * part) - b) / (2 * slope))


def mix(docs: DataFrame, *keep: str, share: float = SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """``keep`` columns, doc_id, source, size, source_size, target, copies, taken, positions: one row a document.

    Reads doc_id, text and source, and ``keep``. ``copies`` (0 to ``most``) is how often a document is
    taken whole, ``positions`` has the training time of each copy. A source's documents are
    taken in the order of a hash of doc_id: full passes while the target allows, then the documents that
    end before the target; what is left of it goes to later documents that are small enough, in
    ``FILL_PASSES`` passes. So each source stays below its target by less than its smallest document
    left, or what the passes didn't fill. Null texts and such without a word have size 0 and are never
    short of their target: they are taken with the pass they lie in, 0 words each. A null source is a
    source, the last. Rows that repeat are documents of their own. An empty table gives no row.
    """
    sized = docs.select(*dict.fromkeys(["doc_id", "source", *keep]), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(7)).alias("place"))
    order = ["source", "place", "doc_id", *[k for k in keep if k not in ("doc_id", "source")], "size"]
    # written first: range partitioning looks at its input twice, and the words are counted once
    t = scratch(ordered_cumsum(scratch(sized), order, "size", "before"))
    sizes = t.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("base"))
    sizes = scratch(sizes)
    goals = targets(sizes.select("source", "source_size"), share, most)
    goals = goals.join(sizes.select(F.col("source").alias("s2"), "base"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    full = F.least(F.lit(most), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0))
    goals = scratch(goals.select(F.col("source").alias("goal_source"), "source_size", "ordinal", "target", "base", full.cast("long").alias("full"), (F.col("target") - full * F.col("source_size")).alias("quota")))
    # a row for each source: Spark broadcasts it if it is small
    t = t.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn("before", F.col("before") - F.col("base")).drop("base")
    t = t.withColumn("extra", F.when((F.col("full") < most) & (F.col("before") + F.col("size") <= F.col("quota")), 1).otherwise(0)).withColumn("gap", F.lit(None).cast("double"))
    for _ in range(FILL_PASSES):
        t = _fill(scratch(t), most)
    copies = (F.col("full") + F.col("extra")).cast("int")
    middle = lambda i: (i * F.col("source_size") + F.col("before") + F.col("size") / 2.0) / F.col("target")
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in SLOPES]), (F.col("ordinal") % len(SLOPES) + 1).cast("int"))
    position = lambda i: training_position(F.least(F.lit(1.0), F.when(F.col("target") > 0, middle(i)).otherwise(0.5)), slope)
    numbers = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: i < copies)
    return t.select(*dict.fromkeys(["doc_id", "source", *keep]), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.transform(numbers, position).alias("positions"))


def _fill(t: DataFrame, most: int) -> DataFrame:
    """Take further documents in the last, partial pass: those that fit what is left of the source's quota, in order."""
    left = t.groupBy(F.col("source").alias("left_source")).agg((F.max("quota") - F.sum(F.col("extra") * F.col("size"))).alias("left"))
    t = t.drop("gap").join(left, F.col("source").eqNullSafe(F.col("left_source"))).drop("left_source").withColumnRenamed("left", "gap")
    fits = (F.col("extra") == 0) & (F.col("full") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    # buckets of the hash order: sums by bucket first, then rows only within the bucket in which the gap closes
    bucket = F.shiftrightunsigned("place", 52)
    t = t.withColumn("fits", fits).withColumn("bucket", bucket)
    sums = t.where("fits").groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a source
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("bucket_base"), "bucket_size")
    t = t.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left").drop("b_source", "b_bucket")
    whole = F.col("bucket_base") + F.col("bucket_size") <= F.col("gap")
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "before").rowsBetween(Window.unboundedPreceding, 0)
    upto_here = F.col("bucket_base") + F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(within)
    take = F.col("fits") & (whole | (upto_here <= F.col("gap")))
    return t.withColumn("extra", F.when(take, 1).otherwise(F.col("extra"))).drop("fits", "bucket", "bucket_base", "bucket_size")


def training_ranks(docs: DataFrame, *keep: str, share: float = SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """Rows of :func:`mix` with ``ranks``: the place of each copy in the training order, from 0, ascending.

    All copies are range-sorted by training position, ties by doc_id as in :func:`training_order`, then by the
    other columns; rows that are equal in all of them are interchangeable.
    """
    plan = mix(docs, *keep, share=share, most=most)
    row, at, one, rank = unused(plan.columns, "__row", "__at", "__one", "__rank")
    plan = scratch(plan.withColumn(row, F.monotonically_increasing_id()))  # written, so that a row keeps its number
    order = [at, *dict.fromkeys(["doc_id", "source", *keep, "size"]), row]
    copies = plan.select("*", F.explode("positions").alias(at)).select(*order, F.lit(1).alias(one))
    ranks = ordered_cumsum(copies, order, one, rank).groupBy(row).agg(F.sort_array(F.collect_list(rank)).alias("ranks"))
    names = [c for c in plan.columns if c != row]
    return plan.join(ranks, row, "left").select(*names, F.coalesce("ranks", F.array().cast("array<bigint>")).alias("ranks"))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents' own columns, a row for each copy taken, range-sorted by training position.

    Partition after partition, and row after row, copies follow each other in training order.
    """
    names = docs.columns
    digest, at = unused(names, "__text", "__at")
    extra = [c for c in names if c not in ("doc_id", "source", "text")]
    rows = docs.select("*", F.xxhash64("text").alias(digest))
    plan = mix(rows.select("doc_id", "source", "text", F.col(digest)), digest, **options).where("copies > 0").groupBy("doc_id", "source", digest).agg(F.flatten(F.collect_list("positions")).alias(at))
    # rows equal in id, source and text are interchangeable: one of them stands for all their copies
    one = rows.groupBy("doc_id", "source", digest).agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in extra])
    same = [one[c].eqNullSafe(plan[c]) for c in ("doc_id", "source", digest)]
    copies = one.join(plan, same[0] & same[1] & same[2]).select(*[one[c] for c in names], F.explode(plan[at]).alias(at))
    return copies.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*names)

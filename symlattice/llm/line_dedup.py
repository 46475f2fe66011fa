"""Operator 8: line dedup by a segment-partition edit join.

A line is removed if an earlier line (by document, then by number) is equal to it or within
``THRESHOLD`` edits. Of threshold-plus-one segments of the shorter of two such lines at least one is unchanged, and lies
in the longer one at one of few places (multi-match-aware selection). Segments are the same for all lines of a
class of lengths: so a distinct line is entered under its segments, and probes with one substring for each place in its
own class, and, if it is near the lower edge of that, in the class below. Pairs that
meet are verified by a bit-parallel edit distance within a diagonal band. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import let, unused
from symlattice.plans.scratch import discard, scratch

#: Edits up to which a line is a near copy.
THRESHOLD = 2
#: Shorter lines (code points) are left alone: within two edits of each other they may say different things.
MIN_LENGTH = 20
#: Growth of a segment from one class of lengths to the next; a class spans so many lengths for each segment.
STEP = 2
#: Pairs of neighbouring characters that an edit takes away or adds, at most.
CHANGED = 4
#: Lines entered under one key that a task holds against its probes; a key with more is dealt over several.
BLOCK = 2048


def places(threshold: int) -> list[tuple[int, int]]:
    """(segment, shift): where a segment of a shorter line may be found in a longer one. The last is counted from the end, where its shift is 0."""
    parts = threshold + 1
    inner = [(i, by) for i in range(1, parts) for by in range(max(1 - i, i - parts), i)]
    return [*inner, (parts, 0)]


def keyed(lines: DataFrame, threshold: int, entered: bool) -> DataFrame:
    """The lines' other columns and key: a row for each segment of the line (``entered``), or for each place where one of another line may be."""
    width = STEP * (threshold + 1)
    choice = lambda below, i, by: F.struct(F.lit(below).alias("below"), F.lit(i).alias("i"), F.lit(by).alias("by"))
    own = [choice(0, i, by) for i, by in places(threshold) if not entered or by == 0]
    table = F.array(*own)
    if not entered:
        table = F.when(F.col("length") % width < threshold, F.array(*own, *[choice(1, i, by) for i, by in places(threshold)])).otherwise(table)
    keep = [c for c in lines.columns if c != "line"]
    rows = lines.select(*keep, "line", (F.octet_length("line") == F.col("length")).alias("plain"), F.inline(table))
    kind = F.expr(f"length div {width}").cast("int") - F.col("below")
    size = kind * STEP
    at = F.when(F.col("i") == threshold + 1, F.col("length") - size).otherwise((F.col("i") - 1) * size + F.col("by")) + 1
    rows = rows.select("*", size.alias("size"), at.alias("at")).where("size > 0 and at >= 1 and at + size - 1 <= length")
    # of plain ASCII a place is a byte's number; else characters are counted from the start
    part = F.when(F.col("plain"), F.substring(F.col("line").cast("binary"), F.col("at"), F.col("size"))).otherwise(F.substring("line", F.col("at"), F.col("size")).cast("binary"))
    return rows.select(*keep, F.xxhash64(part, "size", "i").alias("key"))


def signature(line: Column) -> Column:
    """64 bits: of each pair of neighbouring characters, by its hash, whether there is an odd number. An edit changes at most CHANGED of them."""
    pair = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(64)).cast("int"))
    fold = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda acc, n: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), n)))
    return let(F.split(line, ""), lambda c: F.when(F.size(c) > 1, fold(pair(c))).otherwise(F.lit(0).cast("long")))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines are within ``threshold`` edits: all cells of a column that lie in the band are one step on one integer.

    For each number *e* of edits a group of bits says which diagonals d, from -threshold to threshold, hold a cell
    (j + d, j) that is reached with at most *e* edits. With the next character of ``b``, a bit stays where the characters are equal; it moves
    to the next group by a substitution, there one diagonal down by an insertion, and one up by a deletion.
    Unused bits between the groups take what moves out of the band.
    """
    band, gap = 2 * threshold + 1, 3 * threshold + 2
    if gap * (threshold + 1) > 62:
        raise ValueError("the band of so many edits doesn't fit an integer")
    long = lambda x: F.lit(x).cast("long")
    shift = lambda name, x, n: F.call_function(name, x, F.lit(n))
    union = lambda first, *more: first if not more else union(first.bitwiseOR(more[0]), *more[1:])
    each = sum(1 << gap * e for e in range(threshold + 1))
    inside = each * ((1 << band) - 1)
    start = sum(((1 << e + 1) - 1) << gap * e + threshold for e in range(threshold + 1))

    def step(x: Column, y: Column, state: Column, j: Column) -> Column:
        equal = union(*[F.when(F.get(x, j + (d - threshold)) == F.get(y, j), long(each << d)).otherwise(long(0)) for d in range(band)])
        inserted = shift("shiftleft", shift("shiftrightunsigned", state, 1).bitwiseAND(long(inside)), gap)
        reached = union(state.bitwiseAND(equal), shift("shiftleft", state, gap), inserted)
        return let(reached, lambda r: union(r, *[shift("shiftleft", r, (gap + 1) * e) for e in range(1, threshold + 1)])).bitwiseAND(long(inside))

    def last(x: Column, y: Column) -> Column:
        numbers = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(numbers, long(start), lambda state, j: step(x, y, state, j))
        bit = F.call_function("shiftleft", long(1), F.size(x) - F.size(y) + (gap + 1) * threshold)
        return end.bitwiseAND(bit) != 0

    characters = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    near = F.abs(F.length(a) - F.length(b)) <= threshold
    return F.when(near, let(F.struct(characters(a).alias("x"), characters(b).alias("y")), lambda s: last(s.x, s.y))).otherwise(False)


def near_lines(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of ids of lines within ``threshold`` edits, each once, of a table (id, line) of distinct lines of STEP * (threshold + 1) code points or more.

    First, lines that share no key with another one are left out: of what is entered under a key its least and its greatest id
    say whether there is another one, however many lines meet under it. The rest, as a rule few, get a signature of their text. Two of them are a
    pair only if their signatures allow so few edits; so lines that share a segment and differ elsewhere (edited copies
    of one passage) are told apart within the join. A key under which many lines are entered is dealt over
    blocks of them, so that no task holds it alone.
    """
    sized = lines.select("id", "line", F.length("line").alias("length"))
    entered = scratch(keyed(sized, threshold, True).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    # lines entered under one key all probe with it, so that the two ends are enough to find them all
    met = keyed(sized, threshold, False).join(entered.hint("shuffle_hash"), "key").where("lo <> id or hi <> id")
    met = scratch(met.select(F.explode(F.array("id", "lo", "hi")).alias("id")).distinct())
    discard(entered)
    # what meets grows with the corpus, and so isn't broadcast
    few = lines.select("id", "line").join(met.hint("shuffle_hash"), "id", "left_semi")
    few = scratch(few.select("id", "line", signature(F.col("line")).alias("sig"), F.length("line").alias("length")))
    discard(met)
    probes = keyed(few, threshold, False)
    held = keyed(few, threshold, True).select(F.col("id").alias("e_id"), F.col("sig").alias("e_sig"), F.col("length").alias("e_length"), "key")
    hot = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    hot = scratch(hot)
    held = held.join(hot, "key", "left").withColumn("part", F.pmod(F.hash("e_id"), parts)).drop("parts")
    probes = probes.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    longer = (F.col("length") > F.col("e_length")) | (F.col("length") == F.col("e_length")) & (F.col("id") < F.col("e_id"))
    alike = F.bit_count(F.col("sig").bitwiseXOR(F.col("e_sig"))) <= CHANGED * threshold
    pairs = probes.join(held, ["key", "part"]).where(longer & (F.col("length") - F.col("e_length") <= threshold) & alike)
    pairs = scratch(pairs.select(F.least("id", "e_id").alias("a"), F.greatest("id", "e_id").alias("b")).distinct())
    discard(hot)
    x, y = few.select(F.col("id").alias("a"), F.col("line").alias("x")), few.select(F.col("id").alias("b"), F.col("line").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(within(F.col("x"), F.col("y"), threshold)).select("a", "b")


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, text_hash, exact, near: for each document with any, the numbers (from 0) of its lines to be removed."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.where(F.length("line") >= min_length)
    # a place as one number, which an aggregate keeps in place: the document, then the line
    wide = "decimal(38,0)"
    place = F.coalesce(F.col("doc_id").cast(wide), F.lit("18446744073709551616").cast(wide)) * F.lit("4294967296").cast("decimal(10,0)") + F.col("at").cast(wide)
    number = F.xxhash64("line", F.length("line"))
    # distinct lines by their text, each with its first place; equal lines are summed before the shuffle
    summed = rows.groupBy("line").agg(F.min(place.cast(wide)).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = scratch(summed.select(number.alias("id"), "line", "first", "n"))
    pairs = near_lines(distinct, threshold)
    # the later line of each pair, by the places at which the two were first seen
    first = distinct.select("id", "first")
    a, b = first.select(F.col("id").alias("a"), F.col("first").alias("fa")), first.select(F.col("id").alias("b"), F.col("first").alias("fb"))
    later = pairs.join(a, "a").join(b, "b").select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
    near = first.join(later, "id").select("id", "first", F.lit(1).alias("near"))
    known = distinct.where("n > 1").select("id", "first", F.lit(0).alias("near")).unionByName(near)
    known = scratch(known.groupBy("id").agg(F.min("first").alias("first"), F.max("near").alias("near")))
    discard(distinct)
    seen = rows.select("doc_id", "text_hash", "at", number.alias("id"), place.cast(wide).alias("place")).join(known, "id")
    exact = F.col("place") > F.col("first")
    gone = seen.where((F.col("near") == 1) | exact)
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(exact, F.col("at"))).alias("exact"), F.collect_set(F.when(~exact, F.col("at"))).alias("near"))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents' columns, text without the lines removed, and n_lines, n_exact_removed, n_near_removed.

    Lines are what ``\\n`` separates. One of at least ``min_length`` code points goes if an equal line comes earlier
    (smaller doc_id, nulls last, or same document, earlier), or if a different line within ``threshold`` edits was
    first seen before its own first place; the first of several copies stays. All else stays as it is, in order. A
    null text stays null, with 0 lines; an empty one has one line. Documents are kept, even with an empty text. Rows
    that repeat in id and text count as the same document, and each gets the same result; of equal lines at one place of different
    texts that share a doc_id all stay. ``n_chars``, if there is
    such a column, is left as it came. An empty table gives no row. Columns that are named as those added are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_exact_removed", "n_near_removed")]
    gone_id, gone_hash, exact, near, own = unused(names, "__id", "__hash", "__exact", "__near", "__text")
    gone = removed_lines(docs, threshold, min_length).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash), F.col("exact").alias(exact), F.col("near").alias(near))
    rows = docs.select(*names, F.xxhash64("text").alias(own))
    same = rows["doc_id"].cast("long").eqNullSafe(gone[gone_id]) & (rows[own] == gone[gone_hash])
    joined = rows.join(gone.hint("shuffle_hash"), same, "left")
    lines = F.split("text", "\n")
    gone_here = F.concat(exact, near)
    left = let(lines, lambda all_lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone_here), lambda i: F.get(all_lines, i)))
    kept = F.when(F.col(exact).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    text = F.when(F.col("text").isNotNull(), kept)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        count(exact).alias("n_exact_removed"),
        count(near).alias("n_near_removed"),
    )

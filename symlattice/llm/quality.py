"""Operator 1: quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured once. For every (language, source) a KLL sketch of each measure is built;
sketches merge upwards into languages and the whole corpus. Thresholds are fences around the bulk of
the group a document belongs to, taken from the first level with enough rows; they are joined to the
documents, which are kept if they pass all of them and the base rules. Sketches hold the documents that
pass the base rules: what is out already moves no fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import let, unused, words
from symlattice.plans.scratch import scratch

#: A group needs so many rows for thresholds of its own; else its language's are taken, else the corpus's.
MIN_GROUP = 200
#: Fences: an upper quantile, and so many times its distance from the median above it; the small margin is for groups without spread.
#: A share of clean documents, up to a few in a hundred, repeats lines or passages, so that their spread is in the tail.
#: measure -> (upper quantile, factor, margin)
FENCES = {
    "symbol_ratio": (0.75, 8.0, 0.02),
    "dup_line_ratio": (0.98, 2.0, 0.05),
    "repeat_ratio": (0.98, 2.0, 0.05),
    "stutter_ratio": (0.75, 8.0, 0.02),
    "word_length": (0.75, 8.0, 0.10),
}
#: Up to so many values a sketch holds them all; beyond, its ranks are off by about 1 in 2000.
SKETCH_K = 4000


def repeated_words(w: Column) -> Column:
    """Words in windows of 8 that are found twice or more, first included. ``w``: array of words.

    Windows are compared by a 64-bit hash of their words. A text without any repeated window is
    told by counting distinct hashes; only the others are sorted.
    """
    size = 8
    windows = F.when(F.size(w) > size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        # starts ascending: each window adds its words up to the next window's start
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("end")), lambda acc, s: F.struct((acc.n + F.least(F.lit(size), s + size - acc.end)).alias("n"), (s + size).alias("end")), lambda acc: acc.n)

    def from_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1).h == x.h)) | (F.get(s, i + 1).h == x.h).eqNullSafe(True))
        return covered(F.sort_array(F.transform(twice, lambda x: x.i)))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, from_sorted))

    return let(windows, count).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of the documents and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters. Null text: none of each.

    A stutter is a word that equals the one before it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    w = words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # one struct from one lambda: the words are split once for all measures of them
    of_words = let(w, lambda a: F.struct(F.size(a).cast("long").alias("n_words"), F.length(F.array_join(a, "")).cast("long").alias("word_chars"), repeated_words(a).alias("n_repeat_words"), F.size(F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1)))).cast("long").alias("n_stutters")))
    return docs.select(
        *keep,
        of_words.alias("m"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
    ).select(*keep, "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "n_lines", "m.n_stutters")


def ratios(m: DataFrame) -> DataFrame:
    some = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.select(
        "*",
        some("n_symbols", "word_chars").alias("symbol_ratio"),
        some("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        some("n_repeat_words", "n_words").alias("repeat_ratio"),
        some("n_stutters", "n_words").alias("stutter_ratio"),
        some("word_chars", "n_words").alias("word_length"),
    )


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) -> upper fence of each measure, from KLL sketches merged over levels."""
    sketch = [F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in FENCES]
    groups = measured.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *sketch)
    groups = scratch(groups)  # one row for each language and source
    merged = [F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(f"up_{c}") for c in FENCES]
    by_lang = groups.groupBy(F.col("lang").alias("up_lang")).agg(F.sum("n").alias("lang_n"), *merged)
    overall = groups.agg(*[F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(f"all_{c}") for c in FENCES])
    joined = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("up_lang")))
    joined = joined.crossJoin(F.broadcast(overall))  # one row

    def fence(c: str) -> Column:
        high, factor, margin = FENCES[c]
        chosen = F.when(F.col("n") >= min_group, F.col(c)).when(F.col("lang_n") >= min_group, F.col(f"up_{c}")).otherwise(F.col(f"all_{c}"))
        mid, top = F.kll_sketch_get_quantile_double(chosen, F.lit(0.5)), F.kll_sketch_get_quantile_double(chosen, F.lit(high))
        return (top + factor * (top - mid) + margin).alias(f"max_{c}")

    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[fence(c) for c in FENCES])


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, text_hash, lang, source, the measures, their ratios and fences, base_failed, kept: one row a document.

    Reads doc_id, text, lang and source. Null and empty texts have 0 of everything and fail the base
    rules; a null language or source is a group of its own; rows that repeat are each judged; an
    empty table gives no row; other columns are ignored, whatever their names. Texts are measured
    whole, once; the measures (narrow rows) are written, summed into sketches with map-side
    combine (so that a hot source is no hot task) and joined to the thresholds, a row for each group.
    """
    measured = ratios(scratch(measures(docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash")), "doc_id", "text_hash", "lang", "source")))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = thresholds(measured.where(~base), min_group)
    # a group without limits has no row that passes the base rules
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_lang", "t_source")
    passes = F.lit(True)
    for c in FENCES:
        passes = passes & (F.col(c) <= F.col(f"max_{c}"))
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & passes)


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents, with their own columns, that ``quality_rules`` keeps. Of rows that repeat in id and text all are kept or none, unless their language or source differs: then one that fails takes them along."""
    bad_id, bad_hash, own = unused(docs.columns, "__id", "__hash", "__text")
    bad = quality_rules(docs, min_group).where(~F.col("kept")).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(bad.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(bad[bad_id]) & (rows[own] == bad[bad_hash]), "left_anti").select(*docs.columns)

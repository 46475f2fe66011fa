"""Queries that apply the operators to whole tables: one a callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm import binary_output, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, substring_dedup, topk, toxicity

from symlattice.llm.sql import ORACLE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality_rules(_read(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.training_ranks(_read(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"), "positions", "ranks")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(_read(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_read(spark, sf_dir, "documents"), lm_scoring.in_fold(F.col("doc_id")))


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = binary_output.packed_matrices(_read(spark, sf_dir, "documents"))
    digest = lambda c: F.crc32(c).alias(f"{c}_crc32")
    return p.select("row_id", "n_tokens", "n_segments", "doc_ids", "starts", "cu_seqlens", digest("input_ids"), digest("position_ids"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_exact_removed", "n_near_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    s = toxicity.score(docs, model).withColumn("held_out", held_out)
    strongest = F.array_max(F.transform("segments", lambda x: x.score))
    return s.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"), strongest.alias("strongest"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return topk.exact_topk(e, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_packing, op4_substring_dedup, op5_lm_scoring, op6_binary_output, op7_near_dedup, op8_line_dedup, op9_toxicity, op10_exact_topk)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

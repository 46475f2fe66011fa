"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage works on all that the one before kept. ``STAGES`` has (name, function); a function takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm import line_dedup, mixing, near_dedup, packing, quality
from symlattice.plans.scratch import discard, made, scratch

#: Scratch tables of the stage that was run last, by session.
_before: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()


def _stage(run: Callable[[DataFrame], DataFrame], first: bool = False, last: bool = False):
    """A stage; when it is called, what the stage before it returned has been written, so that one's scratch tables go."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _before.pop(spark, set())
        if not first:
            discard(*before)
        had = made()
        out = run(docs)
        if not last:
            _before[spark] = made() - had
        return out

    return call


def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds. Null and empty texts fail the base rules; an empty table stays empty."""
    return quality.keep_good(docs)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All documents, without lines that (nearly) repeat an earlier one; n_chars follows the text. A null text stays null; a document may end up empty."""
    out = line_dedup.line_dedup(docs)
    return out.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def pack_in_order(docs: DataFrame) -> DataFrame:
    """Packed in the training order in which the mixing stage wrote its rows: by part, file of the part, and row of the file. A null text is its end id; an empty table gives no piece."""
    part = lambda p: F.coalesce(F.try_to_number(F.regexp_extract("_metadata.file_name", p, 1), F.lit("9999999999")), F.lit(0)).cast("long")
    place = F.shiftleft(part(r"^part-(\d+)"), 44) + F.shiftleft(part(r"-c(\d+)[^-]*$"), 34) + F.col("_metadata.row_index")
    return packing.pack(docs.select("doc_id", "text", "source", place.alias("place")), order="place")


STAGES = [
    ("quality rules", _stage(quality_rules, first=True)),
    ("line dedup", _stage(dedup_lines)),
    ("near dedup", _stage(near_dedup.keep_first)),
    ("mixing", _stage(mixing.training_order)),
    ("packing", _stage(pack_in_order, last=True)),
]

#: Edit distances, components and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that the stages keep, in packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = []
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(out)
            tables.append(docs)
    discard(*tables[:-1])  # the last stage's result still reads the last of them
    return out

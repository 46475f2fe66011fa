"""Token ids of documents as a table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import chunks, encoder

TOKENS_SCHEMA = "rid long, doc_id long, source string, n_tokens long, ids binary"


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer: str, kind: str, end_id: int = 0, order: str | None = None) -> DataFrame:
    """One row a document: its ids, then ``end_id``. ``rid`` tells rows apart once the table is written; ``order``, a column, is kept as place.

    A null text is empty: the end id alone. Ids are little-endian, ``kind`` wide.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in chunks(batches):
            ids = [np.array([*run(t or ""), end_id], kind) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    pa.array(range(at, at + len(ids)), pa.int64()),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("source").cast(pa.string()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    *([batch.column("place")] if order else []),
                ],
                ["rid", "doc_id", "source", "n_tokens", "ids", *(["place"] if order else [])],
            )
            at += len(ids)

    place = [F.col(order).alias("place")] if order else []
    rows = docs.select("doc_id", "source", F.col("text").cast("string"), *place)
    return rows.mapInArrow(encode, TOKENS_SCHEMA + (f", place {rows.schema['place'].dataType.simpleString()}" if order else ""))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

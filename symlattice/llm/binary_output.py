"""Operator 6: token ids as packed matrices, by best-fit-decreasing packing.

Documents are cut into parts of at most one row (nothing is lost: every id is in exactly one part).
Parts, longest first, go to the row whose free room is the least that holds them; a segment tree over
room sizes finds it in logarithmic time. Rows are written as fixed-width id matrices with cumulative
segment lengths and with positions that restart at each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import bounded_batches, chunks, default_tokenizer, encoder

#: Ids that are packed together; it bounds a worker's memory, whatever the size of its partition.
BLOCK_TOKENS = 2_000_000
ROWS_SCHEMA = "row_id long, n_tokens long, n_segments long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class RoomTree:
    """Which room sizes exist, as a segment tree: counts at the leaves, their sums above."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The least room of at least ``need``; -1: none."""
        i = self.size + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows, each a list of part numbers whose lengths sum to at most ``width``. Ties: the earlier part, the newest row."""
    rows: list[list[int]] = []
    tree, by_room = RoomTree(width), [[] for _ in range(width + 1)]
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[k]
        room = tree.least(need) if need < width else -1
        if room < 0:
            row, room = len(rows), width
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(k)
        if room > need:
            by_room[room - need].append(row)
            tree.add(room - need, 1)
    return rows


def packed_matrices(docs: DataFrame, tokenizer: str | None = None, width: int = 1024, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row a packed sequence: row_id, n_tokens, n_segments, doc_ids, starts, cu_seqlens, input_ids, position_ids.

    Reads doc_id and text only. Segment *i* of a row is ids ``cu_seqlens[i]`` to ``cu_seqlens[i+1]``
    of ``input_ids`` (``width`` little-endian unsigned 32-bit ids, ``pad_id`` after the last
    segment): the ids of document ``doc_ids[i]`` from its id ``starts[i]`` on. ``position_ids``
    (``width`` unsigned 16-bit, or 32-bit for rows over 65,536) restart at 0 with each segment and at
    the padding. A null or empty text is its end id alone; repeated rows are packed each; an empty
    table gives no row. Blocks of a fixed number of ids are packed where the texts lie: no shuffle.
    """
    tokenizer = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    places = "<u2" if width <= 1 << 16 else "<u4"

    def block(row_id: int, docs: list[int], starts: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(p) for p in parts], width)
        cu = [np.cumsum([0, *(len(parts[k]) for k in row)]) for row in rows]
        ids, positions = np.full((len(rows), width), pad_id, "<u4"), np.zeros((len(rows), width), places)
        for i, (row, edges) in enumerate(zip(rows, cu, strict=True)):
            for k, a, b in zip(row, edges, edges[1:], strict=False):
                ids[i, a:b], positions[i, a:b] = parts[k], np.arange(b - a)
            positions[i, edges[-1] :] = np.arange(width - edges[-1])
        binary = lambda m: pa.array([m[i].tobytes() for i in range(len(rows))], pa.binary())
        values = [
            pa.array(range(row_id, row_id + len(rows)), pa.int64()),
            pa.array([int(x[-1]) for x in cu], pa.int64()),
            pa.array([len(r) for r in rows], pa.int64()),
            pa.array([[docs[k] for k in r] for r in rows], pa.list_(pa.int64())),
            pa.array([[starts[k] for k in r] for r in rows], pa.list_(pa.int64())),
            pa.array(cu, pa.list_(pa.int32())),
            binary(ids),
            binary(positions),
        ]
        return pa.record_batch(values, [x.split()[0] for x in ROWS_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row_id = encoder(tokenizer), TaskContext.get().partitionId() << 36
        docs, starts, parts, held = [], [], [], 0
        for batch in chunks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for a in range(0, len(ids), width):
                    docs.append(doc)
                    starts.append(a)
                    parts.append(ids[a : a + width])
                held += len(ids)
            if held >= BLOCK_TOKENS:
                out = block(row_id, docs, starts, parts)
                row_id += out.num_rows
                docs, starts, parts, held = [], [], [], 0
                for a in range(0, out.num_rows, 512):
                    yield out.slice(a, 512)
        if parts:
            out = block(row_id, docs, starts, parts)
            for a in range(0, out.num_rows, 512):
                yield out.slice(a, 512)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS_SCHEMA)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet by Spark's own writer, so that any shared store will do."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_documents(rows: DataFrame) -> DataFrame:
    """The inverse: (doc_id, start, ids) of every segment, from packed rows."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("i", "part")
    flat = rows.select("input_ids", "cu_seqlens", segment)
    first, last = F.col("cu_seqlens")[F.col("i")], F.col("cu_seqlens")[F.col("i") + 1]
    return flat.select(F.col("part.doc_ids").alias("doc_id"), F.col("part.starts").alias("start"), F.substring("input_ids", first * 4 + 1, (last - first) * 4).alias("ids"))

"""Operator 3: packing with a controlled mixture, by deficit round-robin over source queues.

Every source has a queue of documents, read as one run of ids. In each round source *s* is credited with
``window * p_s`` ids (its quantum; ``p`` are the target proportions) and sends as many whole ids as its credit
holds; the fraction left is carried into the next round. So after round *r* a queue has sent
``min(size, floor(r * quantum))`` ids, documents are cut where a round ends, and a round's parts lie
behind each other in the order of queues. The place of any id, deficits carried over all windows and
partitions included, follows from its place in its queue and the table of queues; no task walks the queues one
after the other, and the result doesn't depend on how the input is partitioned. The stream of rounds is
cut into windows. A round is short of a window by less than one id a queue, so a window is that near its targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import bounded_batches, default_tokenizer
from symlattice.llm.tokens import id_type, token_table
from symlattice.plans.prefix import ordered_cumsum
from symlattice.plans.scratch import scratch

WINDOW = 1024
#: Documents in a given order are packed in so many phases at most, each of so many windows at least.
PHASES = 64
PHASE_WINDOWS = 64
PIECES_SCHEMA = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def drr_schedule(tokens: DataFrame, window: int, weights: dict[str, float] | None = None, total: int = 0) -> tuple[DataFrame, Queues]:
    """(rid, before) of a token table's rows, and the queues: ``before`` counts the ids before a row, queue after queue.

    Targets are ``weights`` by source, or each source's share of all tokens. A source without a
    weight, or with one of 0 or less, is sent after all others. Sources whose quantum is below one id share
    a queue, so that there are at most ``window`` + 2 of them. Queues are in the order of ``place``, if the
    table has it, else of a hash of doc_id; a null source is a queue as any other.

    With a place and without weights the order's own mixture is kept as it changes: its ``total`` ids are
    split into phases of equal length, one after the other, and targets are the shares of each phase.
    """
    ordered = "place" in tokens.columns
    narrow = tokens.select("rid", "doc_id", "source", "n_tokens", F.col("place") if ordered else F.xxhash64("doc_id").alias("place"))
    phases = min(PHASES, total // (window * PHASE_WINDOWS)) if ordered and weights is None else 1
    if phases > 1:
        narrow = ordered_cumsum(narrow, ["place", "doc_id", "rid"], "n_tokens", "order_before")
        narrow = scratch(narrow.withColumn("phase", F.floor(F.col("order_before") / total * phases).cast("int")).drop("order_before"))
    else:
        narrow = narrow.withColumn("phase", F.lit(0))
    sources = scratch(narrow.groupBy("phase", "source").agg(F.sum("n_tokens").alias("size")))
    if weights is None:
        share = F.col("size").cast("double")
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        share = F.greatest(F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0)), F.lit(0.0))
    every = sources.groupBy("phase").agg(F.sum(share).alias("all"))
    quanta = sources.join(F.broadcast(every), "phase").select("phase", "source", "size", F.when((share > 0) & (F.col("all") > 0), share / F.col("all") * window).alias("quantum"))  # a row for each phase
    own, joint, late = F.lit(0), F.lit(1), F.lit(2)
    quanta = quanta.withColumn("kind", F.when(F.col("quantum") >= 1, own).when(F.col("quantum").isNotNull(), joint).otherwise(late)).withColumn("queue", F.when(F.col("kind") == own, F.col("source")))
    found = quanta.groupBy("phase", "kind", "queue").agg(F.sum("size").alias("size"), F.sum("quantum").alias("quantum")).orderBy("phase", "kind", "queue").collect()  # at most window + 2 rows a phase
    named = quanta.select(F.col("phase").alias("of_phase"), F.col("source").alias("of"), "kind", "queue")
    rows = narrow.join(named, (F.col("phase") == F.col("of_phase")) & F.col("source").eqNullSafe(F.col("of"))).withColumn("last", F.when(F.col("kind") == late, F.col("source")))
    queued = ordered_cumsum(rows.drop("of_phase", "of", "source"), ["phase", "kind", "queue", "last", "place", "doc_id", "rid"], "n_tokens", "before")
    return queued.select("rid", "before"), Queues(*([r[c] for r in found] for c in ("size", "quantum", "phase")))


class Queues:
    """Where ids of queues are in the stream of rounds, phase after phase. Queues without a quantum (None) come last, after the rounds of their phase."""

    def __init__(self, sizes: list[int], quanta: list[float | None], phases: list[int] | None = None):
        self.size = np.array(sizes, np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.quantum = np.array([q or 0.0 for q in quanta])
        of = np.array(phases or [0] * len(sizes))
        # for each queue: the first queue of its phase, and the one after the last with a quantum
        self.first, self.end = np.searchsorted(of, of), np.searchsorted(of, of) + np.array([int(((of == p) & (self.quantum > 0)).sum()) for p in of], np.int64)

    def sent(self, k: int | slice, rounds: np.ndarray) -> np.ndarray:
        return np.minimum(self.size[k], np.floor(rounds * self.quantum[k]).astype(np.int64))

    def round_of(self, k: int, at: np.ndarray) -> np.ndarray:
        """The round that sends each of the queue's ids ``at``: the first after which more than ``at`` are sent."""
        r = np.ceil((at + 1) / self.quantum[k])
        r += np.floor(r * self.quantum[k]) <= at
        return r - (np.floor((r - 1) * self.quantum[k]) > at)

    def parts(self, before: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, place in the stream) of each part of a document of ``n`` ids that lies in one piece in the stream."""
        k = int(np.searchsorted(self.base, before, "right")) - 1
        low, high = int(self.first[k]), int(self.end[k])
        if k >= high:
            return np.zeros(1, np.int64), np.array([before])
        c = before - int(self.base[k])
        if self.quantum[k] >= 1:
            first, last = self.round_of(k, np.array([c, c + n - 1]))
            rounds = np.arange(first, last + 1)
        else:
            rounds = np.unique(self.round_of(k, np.arange(c, c + n)))
        start = self.sent(k, rounds - 1)
        place = np.empty(len(rounds), np.int64)
        step = max(1, (1 << 20) // (high - low))
        for i in range(0, len(rounds), step):
            r = rounds[i : i + step, None]
            place[i : i + step] = self.sent(slice(low, k), r).sum(1) + self.sent(slice(k, high), r - 1).sum(1)
        place += self.base[low] + np.maximum(start, c) - start
        start = np.maximum(start, c) - c
        new = np.concatenate([[True], np.diff(place) != np.diff(start)])
        return start[new], place[new]


def cuts(total: int, window: int) -> tuple[int, list[int]]:
    """Number of full windows, and the lengths of the sequences after them: powers of two, so that no padding is needed."""
    full, rest = divmod(total, window)
    return full, [1 << b for b in reversed(range(window.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, weights: dict[str, float] | None = None, end_id: int = 0, order: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, source, start, length, doc_tokens, sequence_id, offset, sequence_length, ids.

    Reads doc_id, text, source and ``order``, a column that queues and the mixture over time follow
    (without it, queues are in hash order); other columns are left out, whatever their names. ``ids`` holds
    little-endian unsigned 32-bit ids. Each id of each document, its end id included, is in exactly
    one piece, and a piece ends where a round or a sequence does. All sequences have ``window`` ids, but the last few, which are powers of two; so
    none needs padding. A null or empty text is its end id alone; rows that repeat are packed each;
    an empty table gives no piece. A very long text is cut over as many sequences as it needs.

    Plan: the texts are read once and tokenised where they lie; the ids are written, places in queues are
    summed over narrow rows, and one shuffle joins them to the ids.
    """
    tokenizer = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    kind = id_type(tokenizer)
    tokens = scratch(token_table(docs, tokenizer, kind, end_id, order))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    plan, queues = drr_schedule(tokens, window, weights, total)
    full, tail = cuts(total, window)
    starts = full * window + np.cumsum([0, *tail])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows, held = [], [], 0
            for row, (n, before) in enumerate(zip(batch.column("n_tokens").to_pylist(), batch.column("before").to_pylist(), strict=True)):
                start, place = queues.parts(before, n)
                end = place + np.diff(start, append=n)
                # the edges of windows, or of the sequences after them, within each part
                lo, hi = place // window + 1, np.minimum((end - 1) // window, full)
                many = np.maximum(hi - lo + 1, 0)
                part = np.repeat(np.arange(len(start)), many)
                edge = (lo[part] + np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)) * window
                more = [(i, x) for x in starts[1:] for i in np.flatnonzero((place < x) & (x < end))] if end.max() > full * window else []
                part, edge = np.concatenate([part, np.array([i for i, _ in more], np.int64)]), np.concatenate([edge, np.array([x for _, x in more], np.int64)])
                a = np.concatenate([start, start[part] + edge - place[part]])
                g = np.concatenate([place, edge])
                order = np.argsort(a)
                a, g = a[order], g[order]
                late = np.searchsorted(starts, g, "right") - 1
                whole = g < full * window
                seq = np.where(whole, g // window, full + late)
                first = np.where(whole, g // window * window, starts[late])
                length = np.where(whole, window, np.array([*tail, 0])[late])
                out.append((a, np.diff(a, append=n), np.full(len(a), n), seq, g - first, length))
                rows.append(row)
                held += n
                if held > 1 << 20:
                    yield pieces(batch, rows, out)
                    out, rows, held = [], [], 0
            if rows:
                yield pieces(batch, rows, out)

    def pieces(batch: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        start, length, tokens, seq, offset, seq_length = (np.concatenate(x) for x in zip(*out, strict=True))
        of = pa.array(np.repeat(rows, [len(x[0]) for x in out]))
        # a document's pieces follow each other as its ids do
        ids = np.frombuffer(b"".join(batch.column("ids")[r].as_py() for r in rows), kind).astype("<u4")
        ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype("<i4")
        blobs = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
        columns = [batch.column("doc_id").take(of), batch.column("source").take(of), start, length, tokens, seq, offset, seq_length, blobs]
        return pa.record_batch([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, PIECE_TYPES, strict=True)], PIECE_NAMES)

    # the plan is a fraction of the ids: it is the hashed side, and the ids aren't sorted
    placed = tokens.join(plan.hint("shuffle_hash"), "rid").select("doc_id", "source", "n_tokens", "ids", "before")
    return placed.mapInArrow(cut, PIECES_SCHEMA)


PIECE_NAMES = [x.split()[0] for x in PIECES_SCHEMA.split(", ")]
PIECE_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in PIECES_SCHEMA.split(", ")]


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences of ``pack``'s pieces: sequence_id, sequence_length, ids and the documents in them."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    parts = pieces.groupBy("sequence_id", "sequence_length").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most one part an id
    return parts.select(
        "sequence_id",
        "sequence_length",
        F.transform("parts", lambda p: F.struct(p.doc_id, p.start, p.length, p.offset)).alias("parts"),
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p.ids)).alias("ids"),
    )

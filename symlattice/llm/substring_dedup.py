"""Operator 4: removal of long passages that occur earlier, by longest-previous-factor arrays.

A byte goes if it lies in a LENGTH-byte string that also starts earlier. Equal strings of that length have equal
anchors: of the ANCHOR-byte strings within each LENGTH bytes, the one with the least hash (minimizers),
about one byte in 35. So only anchors are shuffled, each with the hash of its context, the bytes on both sides in which a string that
holds the anchor can lie.

* Occurrences of an anchor with one and the same context are copies: all but the first are covered.
* Where an anchor has different contexts (the edges of repeated passages, edited copies), the first occurrence of each
  context is compared. The contexts of a task's anchors are put behind each other, and their suffixes are sorted, to LENGTH bytes,
  equal ones by place in the corpus. The suffix nearest before, and the one nearest after, in this order that lies at a smaller place share
  the longest previous factor, told by the least common prefix on the way; where it reaches LENGTH a covered string starts.

Last, covered intervals are joined to the texts and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import bounded_batches, chunks, mix, powers, prefix_hash, span_hash, text_bytes
from symlattice.plans.scratch import discard, scratch

LENGTH = 100
ANCHOR = 32
#: Contexts whose suffixes a task sorts at a time (whole anchors, unless one alone has more).
SORTED = 10_000
#: Text bytes that are held as arrays of numbers at once.
CHUNK = 500_000
#: Occurrences from which an anchor counts as very frequent, and the classes into which its strings are put.
HOT, CLASSES = 1000, 4


def minimizers(hashes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Places with the least hash (the first of equals) of each ``window`` places in a row that lie in one document.

    ``bounds``: the first place of each document, one more at the end.
    """
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    # the least place of each window, by doubling: (hash, place) as one integer orders equals by place
    low = np.uint64(max(1, int(n - 1).bit_length()))
    value = hashes >> low << low | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        value = np.minimum(value[: len(value) - span], value[span:])
        span *= 2
    value = np.minimum(value[: n - window + 1], value[window - span : window - span + n - window + 1])
    starts = np.arange(n - window + 1)
    ends = np.searchsorted(bounds, starts, "right")
    inside = starts + window <= bounds[np.minimum(ends, len(bounds) - 1)]
    place = (value[inside] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    return np.unique(place)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: document number, place in it, its hash, and its context's start, end and hash."""
    sizes = np.diff(offsets)
    prefix = prefix_hash(data, False)
    _, down = powers(len(prefix))
    count = np.maximum(0, sizes - ANCHOR + 1)
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(bounds[-1]) - bounds[:-1][doc] + offsets[:-1][doc]
    rolled = mix((prefix[at + ANCHOR] - prefix[at]) * down[at])
    chosen = minimizers(rolled, bounds, LENGTH - ANCHOR + 1)
    doc, at, rolled = doc[chosen], at[chosen], rolled[chosen]
    reach = LENGTH - ANCHOR
    start, end = np.maximum(offsets[:-1][doc], at - reach), np.minimum(offsets[1:][doc], at + LENGTH)
    sides = (at - start).astype(np.uint64) << np.uint64(32) | (end - at).astype(np.uint64)
    context = mix(mix((prefix[end] - prefix[start]) * down[start]) + mix(sides))
    first = offsets[:-1][doc]
    return doc, at - first, rolled, start - first, end - first, context


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of all texts. Of those with the same context a batch sends the first alone; the others are covered (null anchor)."""
    for batch in chunks(batches, most=CHUNK):
        null = np.asarray(batch.column("doc_id").is_null())
        ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
        rank = batch.column("copy").to_numpy()
        data, offsets = text_bytes(batch.column("text"))
        doc, at, rolled, start, end, context = anchors(data, offsets)
        order = np.lexsort((at, rank[doc], ids[doc], null[doc], context, rolled))
        new = np.ones(len(order), bool)
        new[1:] = (rolled[order][1:] != rolled[order][:-1]) | (context[order][1:] != context[order][:-1])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        # rows that repeat are at the same place, and so don't cover each other
        covered = np.zeros(len(order), bool)
        covered[order] = (at[order] != at[first]) | (rank[doc[order]] != rank[doc[first]]) | (ids[doc[order]] != ids[doc[first]]) | (null[doc[order]] != null[doc[first]])
        yield pa.record_batch(
            [
                pa.array(ids[doc], mask=null[doc]),
                pa.array(rank[doc]),
                pa.array(at << 16 | (at - start) << 8 | (end - at)),
                pa.array(rolled.view(np.int64), mask=covered),
                pa.array(context.view(np.int64), mask=covered),
            ],
            ["doc_id", "copy", "spot", "anchor", "context"],
        )


#: spot: place of the anchor in its document << 16 | bytes of context before it << 8 | bytes from its start to the context's end.
FOUND = "doc_id long, copy int, spot long, anchor long, context long"
AT, BEFORE, AFTER = ("shiftright(spot, 16)", "shiftright(spot, 8) & 255", "spot & 255")


def smaller_before(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order: the bytes shared with the nearest suffix before it that lies at a smaller place (0: there is none).

    ``common``: the bytes that each shares with its neighbour before. All suffixes look one step further in each round, past what their
    candidate has looked past already, so that few rounds are needed.
    """
    n = len(place)
    candidate, shared = np.arange(-1, n - 1), common.copy()
    open_ = np.arange(1, n)
    while True:
        open_ = open_[candidate[open_] >= 0]
        open_ = open_[place[candidate[open_]] >= place[open_]]
        if not len(open_):
            break
        via = candidate[open_]
        shared[open_] = np.minimum(shared[open_], shared[via])
        candidate[open_] = candidate[via]
    return np.where(candidate >= 0, shared, 0)


def longest_previous(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: the longer of what it shares with the nearest smaller places on either side."""
    after = np.append(common[1:], 0)[::-1] if len(common) else common
    return np.maximum(smaller_before(place, common), smaller_before(place[::-1], after)[::-1])


def previous_factors(contexts: list[bytes], place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (context number, offset) whose LENGTH bytes also start at an earlier place in a context of the same group.

    ``place``: the corpus-wide order of each context's first byte; bytes of a context follow it. Suffixes are
    sorted by their group, then by their first LENGTH bytes, then by place; nothing is shared beyond a group or beyond LENGTH bytes.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    first = np.cumsum(sizes) - sizes
    strings = np.maximum(0, sizes - LENGTH + 1)
    owner = np.repeat(np.arange(len(sizes)), strings)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = first[owner] + offset
    # a suffix alone with the hash of its first bytes has no previous factor of that length; only the others are sorted
    hashes = span_hash(prefix_hash(data, False), at, at + LENGTH) + group[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    owner, offset, at = owner[some], offset[some], at[some]
    if not len(at):
        return owner, offset
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    _, rank = np.unique(windows.view(f"S{LENGTH}").reshape(-1), return_inverse=True)
    rank = rank + group[owner] * (int(rank.max()) + 1)
    spot = place[owner] + offset
    order = np.lexsort((spot, rank))
    differ = np.ones(len(order), np.int64)
    differ[1:] = rank[order][1:] != rank[order][:-1]
    common = np.where(differ, 0, LENGTH)
    # neighbours of one group that differ share what is before their first different byte
    edge = np.flatnonzero(differ)[1:]
    same = edge[group[owner[order[edge]]] == group[owner[order[edge - 1]]]]
    common[same] = (windows[order[same]] != windows[order[same - 1]]).argmax(axis=1)
    # rows that repeat hold the same places, which don't come before each other
    hit = order[longest_previous(spot[order], common) >= LENGTH]
    return owner[hit], offset[hit]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered intervals of contexts, from batches sorted by key: (doc_id, copy, start, end)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if size > SORTED and held[-1].column("key")[0].as_py() != key[a]:
                yield _intervals(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += b - a
    if held:
        yield _intervals(pa.Table.from_batches(held))


def _intervals(t: pa.Table) -> pa.RecordBatch:
    key = t.column("key").to_numpy()
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    t = t.filter(pa.array(counts[inverse] > 1))  # a context alone under its key is compared with nothing
    doc, null, copy, at = (t.column(c).to_numpy() for c in ("id", "lost", "copy", "start"))
    # documents numbered in the corpus's order, each with room for its bytes
    order = np.lexsort((copy, doc, null))
    changed = np.zeros(len(order), bool)
    for x in (null, doc, copy):
        changed[1:] |= x[order][1:] != x[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(changed)
    # a suffix is compared with those of its own key: the key's number goes in front
    _, group = np.unique(t.column("key").to_numpy(), return_inverse=True)
    who, off = previous_factors(t.column("bytes").to_pylist(), number * (1 << 40) + at, group)
    edge = np.lexsort((off, who))
    who, off = who[edge], off[edge]
    cut = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (off[1:] > off[:-1] + LENGTH), True]) if len(who) else np.zeros(1, int)
    a, b = cut[:-1], cut[1:] - 1
    k, starts, ends = who[a], at[who[a]] + off[a], at[who[a]] + off[b] + LENGTH
    return pa.record_batch([pa.array(doc[k], mask=null[k]), pa.array(copy[k]), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "copy", "start", "end"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, from texts with the anchors to be looked at.

    A very frequent anchor's contexts are dealt by more than the anchor: its strings are put into CLASSES by how
    many bytes are before the anchor, and the bytes that all strings of a class share are part of the key. So a short line that many
    documents hold, between different neighbours, isn't one group.
    """
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("id", "lost", "copy", "key", "start", "bytes")}
        for doc, copy, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "text", "wanted")), strict=True):
            raw = (text or "").encode()
            for w in wanted:
                at, before, after = w["spot"] >> 16, w["spot"] >> 8 & 255, w["spot"] & 255
                parts = [(w["anchor"], at - before, at + after)]
                if w["hot"]:
                    parts = []
                    step = (LENGTH - ANCHOR) // CLASSES
                    for c in range(CLASSES):
                        left, right = c * step, LENGTH - (c + 1) * step
                        if before >= left and after >= right:
                            shared = hashlib.blake2b(raw[at - left : at + right], digest_size=8, salt=bytes([c])).digest()
                            parts.append((int.from_bytes(shared, "little", signed=True), at - min(before, left + step), at + min(after, LENGTH - left)))
                for key, a, b in parts:
                    if b - a >= LENGTH:
                        for column, x in zip(out.values(), (doc or 0, doc is None, copy, key, a, raw[a:b]), strict=True):
                            column.append(x)
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


CONTEXTS = "id long, lost boolean, copy int, key long, start long, bytes binary"
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for small in chunks(iter([batch]), most=8_000_000):
            out: list[list] = [[] for _ in range(6)]
            for doc, text, a, b in zip(*(small.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends")), strict=True):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for x, y in sorted(zip(a or [], b or [], strict=True)):
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], y)
                    else:
                        spans.append([x, y])
                edges = [0, *(e for s in spans for e in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                values = (doc, len(raw), len(raw) - len(kept), len(spans), [{"start": x, "end": y} for x, y in spans], kept)
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def covered_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, start, end): intervals of bytes, each made of covered strings, of a table (doc_id, copy, text)."""
    bounded_batches(docs.sparkSession)
    found = scratch(docs.mapInArrow(_found, FOUND))
    some = found.where("anchor is not null")
    # anchors with more than one occurrence left, and whether their contexts differ: sums with map-side combine
    kinds = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
    kinds = scratch(kinds.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("differ"), (F.col("n") > HOT).alias("hot")))
    several = scratch(some.join(kinds, "anchor"))
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "copy", "spot")
    first = several.groupBy("anchor", "context").agg(F.min(place).alias("first"))
    ranked = scratch(several.join(first, ["anchor", "context"]).withColumn("later", place > F.col("first")).drop("first", "context"))
    again = found.where("anchor is null").select("doc_id", "copy", "spot").unionByName(ranked.where("later").select("doc_id", "copy", "spot"))
    whole = again.where(f"({BEFORE}) + ({AFTER}) >= {LENGTH}").selectExpr("doc_id", "copy", f"({AT}) - ({BEFORE}) as start", f"({AT}) + ({AFTER}) as end")
    wanted = ranked.where("differ and not later").groupBy(F.col("doc_id").alias("w_id"), F.col("copy").alias("w_copy")).agg(F.collect_set(F.struct("spot", "anchor", "hot")).alias("wanted"))
    met = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("copy") == F.col("w_copy")))
    contexts = met.select("doc_id", "copy", "text", "wanted").mapInArrow(_contexts, CONTEXTS).repartition("key").sortWithinPartitions("key")
    parts = contexts.mapInArrow(_compare, "doc_id long, copy int, start long, end long")
    # a document's intervals together; neighbours within a run are one
    lists = scratch(whole.unionByName(parts).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(found, kinds, several, ranked)
    return lists


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept: one row a document, of its UTF-8 bytes.

    Each byte that a string of LENGTH bytes covers which also starts earlier (in a document of smaller doc_id, nulls
    last, or earlier in the same one) is removed; strings are those of the input. ``spans`` are the maximal runs removed, ``kept`` what is
    left. A null text is empty; texts below LENGTH bytes are kept whole. Rows that repeat in id and text are the same
    document, and get the same result; different texts of one doc_id are ordered by a hash. Other columns are ignored. An
    empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("copy"), F.col("text").cast("string"))
    lists = covered_intervals(rows)
    lists = lists.select(F.col("doc_id").alias("c_id"), F.col("copy").alias("c_copy"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    joined = rows.join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("copy") == F.col("c_copy")), "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(_cut, CUT)

"""Operator 7: near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch has ``BINS`` bins. In round *i* every shingle throws a ball, by its own hash function, into one
bin; a bin keeps the least hash of the first round that reached it. After ``BINS`` rounds, each further round
aims all shingles at one bin, so every bin is filled in the end, and the share of equal bins
of two sets is concentrated around their similarity. Bands of bins deal documents into buckets. Links are confirmed on
the full sets, and components follow from confirmed links.

A bucket isn't expanded into all its pairs. First each document is held against one hub (the document
that most buckets of its bucket mates agree on). Only buckets which then still hold several components are looked at again: pairs of
different components whose sketches allow the similarity are confirmed one by one, or, where a bucket has many
such pairs, by blocks of whole sets in one matrix product that returns the links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.llm.text import bounded_batches, chunks, mix, unused, word_hashes
from symlattice.operators.components import connected_components
from symlattice.plans.scratch import scratch

WORDS = 5
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
BINS, BAND = 128, 4
#: Equal 8-bit bins (of 128) that a pair needs to be confirmed: 4.9 standard deviations below the expectation at 0.75.
LEAST_EQUAL = 72
#: Documents of a bucket that are compared in one task; larger buckets are compared block by block.
BLOCK = 2048
#: Pairs of a block, for each of its documents, beyond which the block is confirmed as a whole.
DENSE = 4
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text; of fewer words, of their whole sequence."""
    h, bounds = word_hashes(column)
    n = len(h)
    rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + h[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * np.uint64(31) + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each set (an empty set: all ones)."""
    out = np.full((len(sets), BINS), np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate([np.zeros(0, np.uint64), *sets])
    for i in range(2 * BINS):
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        open_ = ~full[owner]
        owner, items = owner[open_], items[open_]
        if not len(items):
            break
        x = mix(items + np.uint64((i + 1) * _STEP & (1 << 64) - 1))
        where = (x >> np.uint64(57)).astype(np.int64) if i < BINS else np.full(len(items), i - BINS)
        np.minimum.at(flat, owner * BINS + where, np.uint64(i) << np.uint64(55) | (x & np.uint64((1 << 55) - 1)))
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BINS // BAND, BAND)
    x = np.broadcast_to(np.arange(BINS // BAND, dtype=np.uint64), parts.shape[:2])
    for j in range(BAND):
        x = mix(x * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, j])
    return x


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 36
    for batch in chunks(batches):
        sets = shingle_sets(batch.column("text"))
        sketch = sketches(sets)
        bands = band_hashes(sketch).view(np.int64)
        small = (mix(sketch) & np.uint64(255)).astype(np.uint8)
        tops = [mix(s + np.uint64(len(s))).sum(dtype=np.uint64) if len(s) else 0 for s in sets]
        keys = [np.array([np.bitwise_xor.reduce(mix(s * np.uint64(5) + np.uint64(3))), t], np.uint64).tobytes() if len(s) else None for s, t in zip(sets, tops, strict=True)]
        some = [k is not None for k in keys]
        yield pa.record_batch(
            [
                pa.array(range(at, at + len(sets)), pa.int64()),
                batch.column("doc_id").cast(pa.int64()),
                batch.column("text_hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([b if ok else None for b, ok in zip(list(bands), some, strict=True)], pa.list_(pa.int64())),
                pa.array([b.tobytes() if ok else None for b, ok in zip(small, some, strict=True)], pa.binary()),
            ],
            ["rid", "doc_id", "text_hash", "n_shingles", "key", "bands", "small"],
        )
        at += len(sets)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = shingle_sets(batch.column("text"))
        keys = [np.array([np.bitwise_xor.reduce(mix(s * np.uint64(5) + np.uint64(3))), mix(s + np.uint64(len(s))).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else b"" for s in sets]
        right = [i for i, (k, want) in enumerate(zip(keys, batch.column("key").to_pylist(), strict=True)) if k == want]
        if right:
            yield pa.record_batch([batch.column("node").take(pa.array(right)), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["node", "items"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < THRESHOLD * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in key])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in key):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and components of a block, and which rows are on each side (all are on both, if it is held against itself)."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    part = t.column("part").to_numpy()
    return t.column("node").to_numpy(), t.column("component").to_numpy(), np.flatnonzero(part == i), np.flatnonzero(part == j)


def _cross(nodes: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to be compared: (some of left, all of right), so that each pair of different components is met."""
    values, counts = np.unique(comps[left], return_counts=True)
    main = values[counts.argmax()]
    same = left is right or np.array_equal(left, right)
    few = left[comps[left] != main]
    # what is in the main component of the left is met from the right side's other components
    rest, others = left[comps[left] == main], right[comps[right] != main]
    if len(few):
        yield few, right
    if not same and len(rest) and len(others):
        yield others, rest


def _sketch_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose sketches allow a link; of dense blocks (null pair) the key alone."""
    for t in _groups(batches, ["band", "i", "j"]):
        nodes, comps, left, right = _sides(t)
        if not len(left) or not len(right):
            continue
        small = np.frombuffer(b"".join(t.column("small").to_pylist()), np.uint8).reshape(-1, BINS)
        out_a, out_b, dense = [], [], False
        for xs, ys in _cross(nodes, comps, left, right):
            for x in xs:
                near = ys[(comps[ys] != comps[x]) & ((small[ys] == small[x]).sum(axis=1) >= LEAST_EQUAL)]
                out_a.append(np.full(len(near), nodes[x]))
                out_b.append(nodes[near])
            if sum(map(len, out_a)) > DENSE * len(nodes):
                dense = True
                break
        if dense:
            key = [t.column(c)[:1].combine_chunks() for c in ("band", "i", "j")]
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), *key], ["a", "b", "band", "i", "j"])
            continue
        a, b = np.concatenate([np.zeros(0, int), *out_a]), np.concatenate([np.zeros(0, int), *out_b])
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], ["a", "b", "band", "i", "j"])


def _dense_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components of a block, confirmed on whole sets: one for each document and component."""
    for t in _groups(batches, ["band", "i", "j"]):
        nodes, comps, left, right = _sides(t)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        words, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = counts[inverse] > 1  # a shingle of one set alone is in no intersection
        rank = np.cumsum(counts > 1) - 1
        owner, column = owner[shared], rank[inverse[shared]]
        for xs, ys in _cross(nodes, comps, left, right):
            both = np.zeros((len(xs), len(ys)), np.float32)
            for a in range(0, int((counts > 1).sum()), 4096):
                inside = (column >= a) & (column < a + 4096)
                m = np.zeros((len(sets), 4096), np.float32)
                m[owner[inside], column[inside] - a] = 1
                both += m[xs] @ m[ys].T
            ok = (100 * both >= THRESHOLD * (sizes[xs][:, None] + sizes[ys][None, :] - both)) & (comps[xs][:, None] != comps[ys][None, :])
            i, j = np.nonzero(ok)
            if len(i):
                _, first = np.unique(np.stack([nodes[xs[i]], comps[ys[j]]]), axis=1, return_index=True)
                yield pa.record_batch([pa.array(nodes[xs[i[first]]]), pa.array(nodes[ys[j[first]]])], ["a", "b"])


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, node, component) with the blocks (i, j) of their bucket in which they are: part is i or j.

    Documents of a bucket's largest component aren't held against each other: they are dealt over parts of their own, after
    those of the rest, and a block is a part of the rest with any part. So what is copied is rows of the largest
    component for each part of the rest, and rows of the rest for each part, not all rows for all parts.
    """
    counts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("band").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("n"))
    parts_of = lambda n: F.ceil(n / BLOCK).cast("int")
    tables = largest.select("band", F.col("main.component").alias("main"), parts_of(F.col("n") - F.col("main.c")).alias("rest"), parts_of(F.col("main.c")).alias("most"))
    inside = F.col("component") == F.col("main")
    deal = F.xxhash64("node", F.lit(3))
    part = F.when(inside, F.col("rest") + F.pmod(deal, F.col("most"))).otherwise(F.pmod(deal, F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    placed = rows.join(tables, "band").withColumn("part", part).withColumn("block", F.explode(pairs))
    return placed.select(*rows.columns, "part", "block.i", "block.j")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_key, text_hash: one row a document.

    Reads doc_id and text; other columns are ignored, whatever their names. Documents are linked when
    their sets of distinct 5-word shingles (words lower-cased in A-Z; fewer words: the whole sequence is the one
    shingle) have 100 * intersection >= 75 * union. ``component_id`` is the least doc_id reachable, ``kept`` is
    true where it is the document's own. Texts that are null, empty or blank have no shingles, are linked with nothing and
    kept. Equal sets are one node, so exact copies are never compared. Of rows that repeat a doc_id each is a
    document; rows that repeat the least doc_id of a component are all kept. A null doc_id is only a component's when
    there is no other. Very long texts are whole sets. An empty table gives no row.

    A link at the threshold is missed by the bands with a chance of (1 - 0.75**4)**32 = 5e-6, less for more similar texts.
    """
    bounded_batches(docs.sparkSession)
    table = scratch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash")).mapInArrow(_sketched, "rid long, doc_id long, text_hash long, n_shingles long, key binary, bands array<long>, small binary"))
    component = components(docs, table)
    joined = table.select("doc_id", "text_hash", "n_shingles", "key").join(component, "key", "left")
    own = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("key").alias("set_key"), "text_hash")


def components(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(key, component_id) of every distinct set."""
    some = table.where("key is not null")
    nodes = scratch(some.groupBy("key").agg(F.min("rid").alias("node"), F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "small"), "rid").alias("s")).select("key", "node", "rep", "s.bands", "s.small"))
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch(dealt.join(shared, "band"))
    # hubs: the member whose buckets are the largest
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub")).select("band", F.col("hub.node").alias("hub"))
    votes = members.join(hubs, "band").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("votes"))
    star = votes.groupBy("node").agg(F.max(F.struct("votes", "hub")).alias("best")).select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct()
    star = scratch(star)
    # whole sets, made again from the texts, for the documents that share a bucket
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key", F.col("rep").alias("rep"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "node", "key")
    sets = found.mapInArrow(_whole_sets, "node long, items binary")
    sets = scratch(sets.groupBy("node").agg(F.first("items").alias("items")))
    links = scratch(confirmed(star, sets))

    state = connected_components(links, "a", "b")
    placed = members.join(state, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    active = scratch(placed.join(several, "band", "left_semi"))
    blocks = _blocks(active)
    key = ["band", "i", "j"]
    sketched = blocks.join(nodes.select("node", "small"), "node").repartition(*key).sortWithinPartitions(*key)
    more = scratch(sketched.select(*key, "part", "node", "component", "small").mapInArrow(_sketch_pairs, "a long, b long, band long, i int, j int"))
    sparse = more.where("a is not null").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    dense = more.where("a is null").select(*key)
    whole = blocks.join(dense, key, "left_semi").join(sets, "node").repartition(*key).sortWithinPartitions(*key)
    whole = whole.select(*key, "part", "node", "component", "items").mapInArrow(_dense_links, "a long, b long")
    links = scratch(links.union(confirmed(sparse, sets)).union(whole))
    state = connected_components(links, "a", "b")
    joined = nodes.select("key", "node", "rep").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return joined.join(least, "component").select("key", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, of which no earlier one (by doc_id) is a near copy: one for each component."""
    gone_id, gone_hash, own, number = unused(docs.columns, "__id", "__hash", "__text", "__n")
    found = near_duplicates(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    left = rows.join(gone.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(gone[gone_id]) & (rows[own] == gone[gone_hash]), "left_anti")
    # rows that repeat in id and text are copies of each other
    one = Window.partitionBy("doc_id", own).orderBy("doc_id")
    return left.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*docs.columns)

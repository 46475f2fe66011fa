"""Operator 5: scoring by an n-gram model that is kept as Elias-Fano tries.

Texts are made into blocks of token numbers. A block asks shards for the counts of its distinct words and for
its distinct word pairs, and sends along how often each is in its training documents; a shard first sums what all
blocks send, builds its part of the trie (memory-mapped, in the task's own folder, deleted at the end), and then
answers every block. So each pair is sent once a block in a few bytes, no model is ever gathered in one place, what is sent
grows with the corpus, and so does the number of shards: one has about as many keys at every size.

The model is a bigram model that sums to 1 after every word. Words are dealt into classes, those of their shards. P(w | v) = P(k | v) P(w | v, k), k the class of w:

* P(k | v) = (c(v, k) + MU p(k)) / (c(v) + MU), with p(w) = (c(w) + 1) / (N + V + 1), p(k) its sum over the class, and
  one more outcome for all unknown words, of 1 / (N + V + 1);
* P(w | v, k) = a(w | v, k) + b(v, k) p(w) / p(k), where a is (c(v, w) - DISCOUNT) / c(v, k), quantised, and b is 1 less the sum of all a.

The followers of one word and class are the children of one trie node; those of a frequent word are in as many shards as there
are, so that none is hot, and yet each node can be normalised where it lies. A text's first word follows an end, and its last is followed by one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.elias_fano import CHILD_BITS, CONTEXT_BITS, EliasFano, Trie, mapped, quantise, restore
from symlattice.llm.text import bounded_batches, chunks, mix, word_hashes
from symlattice.plans.scratch import scratch

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 5_000_000
#: Bytes of blocks for each shard, at least LEAST_SHARDS of them; and tasks that work on shards, one after the other, at most.
SHARD_BYTES, LEAST_SHARDS, MOST_TASKS = 4_000_000, 16, 20_000
#: Strength of the smoothing of classes, in tokens, and what is taken off each pair's count.
MU, DISCOUNT = 16.0, 0.75
_ONE_LEFT = 1 - restore(quantise(np.array([1 - DISCOUNT])))[0]
_END = np.uint64(0x5BF0A8B1457695F1)
_CHILD, _CONTEXT = np.uint64((1 << CHILD_BITS) - 1), np.uint64((1 << CONTEXT_BITS) - 1)
DOCS, WORDS, PAIRS, TOTALS = 0, 1, 2, 3
ROW = "block long, kind int, shard int, payload binary"


def put(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each with its type and length."""
    parts = []
    for a in arrays:
        parts += [a.dtype.str[1:].encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def take(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    out, at = [], 0
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the fewest bytes of 1, 2, 4 or 8."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def put_sorted(keys: np.ndarray) -> list[np.ndarray]:
    """Ascending keys as differences, byte by byte, without the high bytes that none has."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return [np.array([width], np.uint8), steps.view(np.uint8).reshape(-1, 8)[:, :width].T.reshape(-1)]


def by_bytes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on: these compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).reshape(-1)


def from_planes(raw: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def take_sorted(width: np.ndarray, planes: np.ndarray) -> np.ndarray:
    steps = np.zeros((len(planes) // int(width[0]), 8), np.uint8)
    steps[:, : int(width[0])] = planes.reshape(int(width[0]), -1).T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "kind", "shard", "payload"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks: ids, lengths and training flags; distinct words; word numbers of all tokens."""
    number = TaskContext.get().partitionId() << 32
    for batch in chunks(_gathered(batches), most=BLOCK_BYTES):
        h, bounds = word_hashes(batch.column("text"))
        n = np.diff(bounds)
        tokens = np.insert(h, bounds[1:], _END)
        codes, words = pd.factorize(tokens)
        ids = batch.column("doc_id")
        payload = put(
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            np.asarray(ids.is_null()).astype(np.uint8),
            batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8),
            n.astype(np.int64) + 1,
            words.astype(np.uint64),
            by_bytes(codes.astype(np.uint32)),
        )
        yield _rows([(number, DOCS, -1, payload)])
        number += 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to a block's size, so that blocks are few."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def conditional(a: np.ndarray, follow: np.ndarray, left: np.ndarray, context: np.ndarray, p: np.ndarray, of_class: np.ndarray, known: np.ndarray) -> np.ndarray:
    """P(w | v), from a(w | v, k), c(v, k), b(v, k), c(v), p(w), p(k) and whether w is known."""
    within = a + left * p / np.where(known, of_class, 1.0)
    return np.where(known, (follow + MU * of_class) * within, MU * p) / (context + MU)


class Block:
    """A block's distinct words and pairs, in the order in which shards are asked for them."""

    def __init__(self, payload: bytes, shards: int):
        self.ids, self.null, self.held, self.n, words, codes = take(payload)
        codes = from_planes(codes, np.uint32).astype(np.int64)
        training = np.repeat(self.held == 0, self.n)
        own = mix(words ^ np.uint64(0x243F6A8885A308D3))
        shard = (own % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((words, shard))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.word_shard, self.tokens = words[order], shard[order], place[codes]
        self.word_counts = np.bincount(self.tokens[training], minlength=len(words))
        # the token before each; the end symbol also stands before a text's first
        self.end = int(np.flatnonzero(self.words == _END)[0]) if len(words) else 0
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[:1] = self.end
        distinct, inverse = np.unique(before * len(words) + self.tokens, return_inverse=True)
        v, w = distinct // max(1, len(words)), distinct % max(1, len(words))
        counts = np.bincount(inverse[training], minlength=len(distinct))
        hv, hw = self.words[v], mix(self.words[w] + np.uint64(0x13198A2E03707344))
        kind = self.word_shard[w].astype(np.uint64)
        node = mix(mix(hv + np.uint64(0xA4093822299F31D0)) + kind)
        shard = (mix(node) % np.uint64(shards)).astype(np.int64)
        keys = (node & _CONTEXT) << np.uint64(CHILD_BITS) | mix(hv * np.uint64(0x2545F4914F6CDD1D) + hw) & _CHILD
        order = np.lexsort((keys, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.pair_shard, self.pair_counts, self.pairs = keys[order], shard[order], counts[order], place[inverse]
        self.pair_v, self.pair_w = v[order], w[order]

    def requests(self, number: int) -> list[tuple[int, int, int, bytes]]:
        out = []
        for kind, keys, shard, counts in ((WORDS, self.words, self.word_shard, self.word_counts), (PAIRS, self.keys, self.pair_shard, self.pair_counts)):
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
            for a, b in zip(edges, edges[1:], strict=False):
                out.append((number, kind, int(shard[a]), put(*put_sorted(keys[a:b]), narrow(counts[a:b]))))
        return out

    def scores(self, answers: list[tuple[int, bytes]], total: int, distinct: int, classes: np.ndarray) -> pa.RecordBatch:
        """``answers``: kind and payload, in the order of the shards. ``classes``: the training tokens and distinct words of each class."""
        c = np.concatenate([np.zeros(0, np.int64), *(take(p)[0].astype(np.int64) for k, p in answers if k == WORDS)])
        nodes = [take(p) for k, p in answers if k == PAIRS]
        codes, follow = (np.concatenate([np.zeros(0, t), *(x[i].astype(t) for x in nodes)]) for i, t in enumerate((np.uint8, np.int64)))
        # what a node without followers, or with one, leaves is known
        left = np.where(follow > 0, _ONE_LEFT, 1.0)
        left[follow > 1] = np.concatenate([np.zeros(0, np.float32), *(from_planes(x[2], np.float32) for x in nodes)])
        # a node of the trie: pairs in a row of one shard and context
        context = self.keys >> np.uint64(CHILD_BITS)
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (self.pair_shard[1:] != self.pair_shard[:-1])
        if len(c) != len(self.words) or len(codes) != len(self.keys) or len(follow) != new.sum():
            raise ValueError("a shard's answer is missing")
        p = (c + 1) / (total + distinct + 1)
        base = np.log10(p)[self.tokens]
        node = np.cumsum(new) - 1
        model = np.log10(conditional(restore(codes), follow[node], left[node], c[self.pair_v], p[self.pair_w], (classes / (total + distinct + 1))[self.word_shard[self.pair_w]], c[self.pair_w] > 0))[self.pairs]
        edges = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        total_of = lambda x: np.add.reduceat(x, edges) if len(x) else np.zeros(0)
        known = total_of((c > 0)[self.tokens].astype(np.int64))
        values = [
            pa.array(self.ids, mask=self.null.astype(bool)),
            pa.array(self.held.astype(bool)),
            pa.array(self.n, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(np.full(len(self.n), total), pa.int64()),
            pa.array(total_of(base), pa.float64()),
            pa.array(total_of(model), pa.float64()),
        ]
        return pa.record_batch(values, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = Block(payload.as_py(), shards).requests(number)
                if rows:
                    yield _rows(rows)

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append(row)
    if held:
        yield last, held


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard after the other: sum the counts of all blocks, build the trie, answer the blocks.

    What the blocks ask is put together first, so that each level is read once, in order.
    """
    for (kind, shard), rows in _groups(batches, ["kind", "shard"]):
        keys, counts = [], []
        for r in rows:
            width, planes, c = take(r.pop("payload"))
            keys.append(take_sorted(width, planes))
            counts.append(c)
        edges = np.cumsum([0, *map(len, keys)])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.zeros(len(distinct), np.int64)
        for a, b, c in zip(edges, edges[1:], counts, strict=False):
            summed[inverse[a:b]] += c  # a block names each key once
        del keys, counts
        seen = summed > 0
        trie = Trie(distinct[seen], summed[seen], DISCOUNT) if kind == PAIRS else Words(distinct[seen], summed[seen])
        try:
            found, *of_contexts = trie.lookup(distinct)
        finally:
            trie.close()
        # the node of each key, by number
        contexts = distinct >> np.uint64(CHILD_BITS)
        node = np.cumsum(np.r_[True, contexts[1:] != contexts[:-1]]) - 1
        out, size = [], 0
        for r, a, b in zip(rows, edges, edges[1:], strict=False):
            own = inverse[a:b]
            parts = [found[own]]
            if kind == PAIRS:
                nodes = node[own]
                nodes = nodes[np.r_[True, nodes[1:] != nodes[:-1]]]
                follow = of_contexts[0][nodes]
                parts += [narrow(follow), by_bytes(of_contexts[1][nodes[follow > 1]])]
            out.append((r["block"], kind, shard, put(*parts)))
            size += len(out[-1][3])
            if size > 4_000_000:
                yield _rows(out)
                out, size = [], 0
        if kind == WORDS:
            out.append((-1, TOTALS, shard, put(np.array([summed.sum(), seen.sum()], np.int64))))
        yield _rows(out)


class Words(Trie):
    """A shard's words with their exact counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.folder = tempfile.mkdtemp(prefix="words-")
        self.keys = EliasFano(keys, self.folder, "keys")
        self.codes = mapped(counts, self.folder, "counts")

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray]:
        place, equal = self.keys.successor(keys)
        out = np.zeros(len(keys), np.int64)
        out[equal] = self.codes[place[equal]]
        return (narrow(out),)


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a document.

    Reads doc_id and text, and what ``held_out`` (boolean; null: false) reads; other columns are ignored. Learns from all documents
    that aren't held out and scores all. A null, empty or blank text is its end alone. Rows that
    repeat are learnt from, and scored, each. A very long text is a block of its own. An empty table
    gives no row; if all is held out, N and V are 0 and every token is unknown. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = scratch(rows.mapInArrow(_blocks, ROW))
    n_blocks, held = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-held // SHARD_BYTES))
    key = ["kind", "shard"]
    tasks = lambda n: min(max(2 * n, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)  # noqa: E731  so few share one that all are alike
    asked = blocks.mapInArrow(_ask(shards), ROW).repartition(tasks(shards), *key).sortWithinPartitions(*key, "block")
    answers = scratch(asked.mapInArrow(_answer, ROW))
    sums = {r.shard: take(r.payload)[0] for r in answers.where(F.col("kind") == TOTALS).select("shard", "payload").collect()}  # a row for each shard
    total, distinct = (int(sum(s[i] for s in sums.values())) for i in (0, 1))
    classes = spark.sparkContext.broadcast(np.array([float(sum(sums.get(k, [0]))) for k in range(shards)]))
    both = blocks.union(answers.where(F.col("kind") != TOTALS)).repartition(tasks(n_blocks), "block").sortWithinPartitions("block", *key)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["block"]):
            yield Block(rows[0]["payload"], shards).scores([(r["kind"], r["payload"]) for r in rows[1:]], total, distinct, classes.value)

    return both.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def in_fold(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold

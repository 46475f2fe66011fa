"""Label propagation in sweeps over adjacency on disk: memory grows with the nodes of a component, not with its links.

Nodes are numbers 0 to n - 1 without a gap, in the order of a sweep. A sweep reads the neighbours chunk by chunk. Within a
chunk all nodes are labelled at once; those that saw a label of an earlier node of the chunk which has changed since are labelled
again, until none is left. As each waits for earlier nodes alone, that ends in the very labels of one node after the other.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Links of a chunk; attempts to label a chunk at once before the rest of it goes node by node; rows of a batch that is returned.
CHUNK, ATTEMPTS, OUT_ROWS = 1 << 16, 32, 1 << 16

PACKED = "task long, first long, last long, degrees binary, around binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, u, v), sorted by u, every u of a task present -> a row for each batch and task: links of ``first`` to ``last``."""
    for batch in batches:
        task, u, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "u", "v"))
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1), len(task)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        rows = [(task[a], u[a], u[b - 1], np.bincount(u[a:b] - u[a]).astype(np.int64).tobytes(), v[a:b].astype(np.int64).tobytes()) for a, b in spans]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["task", "first", "last", "degrees", "around"])


def _commonest(row: np.ndarray, label: np.ndarray, bits: int) -> np.ndarray:
    """For each different row, in order: its commonest label (ties: the least). Labels have ``bits`` bits."""
    key = (row << bits) | label
    key.sort()
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count, of, mask = np.diff(np.append(at, len(key))), key[at] >> bits, (1 << bits) - 1
    best = np.maximum.reduceat((count << bits) | (mask - (key[at] & mask)), np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))))
    return mask - (best & mask)


def _label_chunk(label: np.ndarray, start: int, degrees: np.ndarray, around: np.ndarray, bits: int) -> bool:
    """Label the nodes from ``start`` on as one after the other would; whether any moved."""
    n = len(degrees)
    row = np.repeat(np.arange(n), degrees)
    old, seen = label[start : start + n].copy(), label[around]
    back = np.flatnonzero((around >= start) & (around < row + start))  # to an earlier node of the chunk
    behind = around[back] - start
    new = _commonest(row, seen, bits)
    for attempt in range(ATTEMPTS + 1):
        stale = np.flatnonzero(seen[back] != new[behind])
        if not len(stale):
            break
        if attempt == ATTEMPTS:
            ends = np.cumsum(degrees)
            earlier = np.zeros(len(around), bool)
            earlier[back] = True
            for r in range(row[back[stale[0]]], n):  # nodes before the first stale one are settled
                part = slice(ends[r] - degrees[r], ends[r])
                values, links = seen[part].copy(), earlier[part]
                values[links] = new[around[part][links] - start]
                found, count = np.unique(values, return_counts=True)
                new[r] = found[count.argmax()]
            break
        seen[back[stale]] = new[behind[stale]]
        again = np.zeros(n, bool)
        again[row[back[stale]]] = True
        links = again[row]
        new[again] = _commonest(row[links], seen[links], bits)
    label[start : start + n] = new
    return bool((new != old).any())


class Graph:
    """Neighbours of nodes from ``low`` on, added in the order of the nodes and kept in a file without a name."""

    def __init__(self, task: int, low: int) -> None:
        self.task, self.low, self.last, self.file = task, low, None, tempfile.TemporaryFile()
        self._degrees: list[np.ndarray] = []

    def add(self, first: int, last: int, degrees: np.ndarray, around: np.ndarray) -> None:
        degrees = degrees.copy()
        if first == self.last:  # the links of a node may come in several parts
            self._degrees[-1][-1] += degrees[0]
            degrees = degrees[1:]
        elif first != (self.low if self.last is None else self.last + 1):
            raise ValueError(f"node {first} after {self.last}")
        around = around - self.low
        if around.max() >> 32:
            raise OverflowError("a component of more than 2**32 nodes")
        around.astype(np.uint32).tofile(self.file)
        self.last = last
        if len(degrees):
            self._degrees.append(degrees)

    def _sweep(self, label: np.ndarray, ends: np.ndarray) -> bool:
        n, start, done, moved, bits = len(label), 0, 0, False, len(label).bit_length()
        self.file.seek(0)
        read = lambda count: np.fromfile(self.file, np.uint32, count).astype(np.int64)
        while start < n:
            stop = int(np.searchsorted(ends, done + CHUNK, "right"))
            if stop > start:
                moved |= _label_chunk(label, start, np.diff(ends[start:stop], prepend=done), read(ends[stop - 1] - done), bits)
            else:  # a node with more links than a chunk: its labels are counted part by part
                stop, tally = start + 1, np.zeros(n, np.int64)
                for at in range(done, int(ends[start]), CHUNK):
                    found, count = np.unique(label[read(min(CHUNK, int(ends[start]) - at))], return_counts=True)
                    tally[found] += count
                best = tally.argmax()
                moved |= bool(best != label[start])
                label[start] = best
            start, done = stop, int(ends[stop - 1])
        return moved

    def labels(self, rounds: int) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(np.concatenate(self._degrees))
        self._degrees.clear()
        label = np.arange(len(ends))
        for _ in range(rounds):
            if not self._sweep(label, ends):
                break
        self.file.close()
        for at in range(0, len(label), OUT_ROWS):
            part = label[at : at + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)) + self.low), pa.array(part + self.low)], ["n", "label"])


def sweeps(rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of :func:`pack`, sorted by task, first and last, all of a task together -> (n, label) after at most ``rounds`` sweeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            task, first, last = (batch.column(c).to_pylist() for c in ("task", "first", "last"))
            for k, t in enumerate(task):
                if graph is None or graph.task != t:
                    if graph is not None:
                        yield from graph.labels(rounds)
                    graph = Graph(t, first[k])
                degrees, around = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("degrees", "around"))
                graph.add(first[k], last[k], degrees, around)
        if graph is not None:
            yield from graph.labels(rounds)

    return run

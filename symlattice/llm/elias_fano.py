"""Monotone integer sequences in compact, memory-mapped form, and a two-level n-gram trie of them."""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Values from one entry of the directory to the next: what a search decodes at a time.
SAMPLE = 2048
#: Base of the geometric steps in which probabilities are kept, one byte each: down by 8.5 % at most, to 1e-9.
STEP = 1.085
#: Bits of a child within its context, and of a context within its shard.
CHILD_BITS, CONTEXT_BITS = 24, 32


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high bits in unary; a directory of every SAMPLE-th value."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        values = values.astype(np.uint64)
        self.n = len(values)
        self.low = max(0, int(values[-1]).bit_length() - max(0, (self.n - 1).bit_length())) if self.n else 0
        high = (values >> np.uint64(self.low)).astype(np.int64) if self.low < 64 else np.zeros(self.n, np.int64)
        bits = np.zeros(self.n + (int(high[-1]) if self.n else 0) + 1, bool)
        bits[high + np.arange(self.n)] = True
        shifts = np.arange(self.low, dtype=np.uint64)
        lows = np.concatenate([np.zeros(0, np.uint8), *(np.packbits(((values[a : a + SAMPLE, None] >> shifts) & np.uint64(1)).astype(bool).reshape(-1)) for a in range(0, self.n, SAMPLE))])
        at = np.arange(0, self.n, SAMPLE)
        self.first = values[at]
        self.start = high[at] + at  # bit of each sampled value
        self.above = high[at]
        self.bits = mapped(np.packbits(bits), folder, f"{name}.high")
        self.lows = mapped(lows, folder, f"{name}.low")
        self.bytes = -(-SAMPLE * self.low // 8)

    def chunk(self, k: int) -> np.ndarray:
        """Values SAMPLE * k to SAMPLE * (k + 1)."""
        n = min(SAMPLE, self.n - k * SAMPLE)
        begin = int(self.start[k])
        end = int(self.start[k + 1]) if k + 1 < len(self.start) else 8 * len(self.bits)
        bits = np.unpackbits(self.bits[begin // 8 : -(-end // 8) or None])[begin % 8 :]
        ones = np.flatnonzero(bits)[:n]
        high = (ones - np.arange(n) + self.above[k]).astype(np.uint64)
        raw = np.unpackbits(self.lows[k * self.bytes : k * self.bytes + -(-n * self.low // 8)])[: n * self.low].reshape(n, self.low)
        low = raw.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64)) if self.low else np.zeros(n, np.uint64)
        return high << np.uint64(self.low) | low

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending queries: the place of the first value not below each (n: none), and whether it is equal."""
        queries = queries.astype(np.uint64)
        place, equal = np.full(len(queries), self.n, np.int64), np.zeros(len(queries), bool)
        if not self.n or not len(queries):
            return place, equal
        chunk = np.maximum(np.searchsorted(self.first, queries, "right") - 1, 0)
        edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            values = self.chunk(int(chunk[a]))
            at = np.searchsorted(values, queries[a:b])
            inside = at < len(values)
            equal[a:b] = inside & (values[np.minimum(at, len(values) - 1)] == queries[a:b])
            place[a:b] = chunk[a] * SAMPLE + at
        return place, equal

    def get(self, places: np.ndarray) -> np.ndarray:
        """Values at ascending places."""
        out = np.zeros(len(places), np.uint64)
        chunk = places // SAMPLE
        edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(places) else []
        for a, b in zip(edges, edges[1:], strict=False):
            out[a:b] = self.chunk(int(chunk[a]))[places[a:b] % SAMPLE]
        return out


def mapped(values: np.ndarray, folder: str, name: str) -> np.ndarray:
    if not len(values):
        return values
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, values.dtype, "r")


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0: the next step below each, so that a sum of them never grows."""
    return np.clip(1 + np.ceil(-np.log(np.maximum(p, 1e-12)) / np.log(STEP) - 1e-9), 1, 255).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 is a pair that was never seen."""
    return np.where(codes > 0, STEP ** (1 - codes.astype(float)), 0.0)


class Trie:
    """Contexts, and below each the words that follow it: keys are (context << CHILD_BITS | child), ascending, distinct.

    Level 1 has the contexts, with the number of tokens that follow and the weight left for words that never did; monotone pointers
    lead to the children of each. Level 2 has the children, each relative to its context: to stay monotone, a child's value
    starts after the last one of the context before. A child is found by a search from its context's pointer on.
    Values are smoothed probabilities of the child after its context: a discount is taken off each count, and what the children leave,
    with what their quantisation takes off, is the context's weight; so children and weight sum to 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float):
        self.folder = tempfile.mkdtemp(prefix="trie-")
        contexts, first = np.unique(keys >> np.uint64(CHILD_BITS), return_index=True)
        children = keys & np.uint64((1 << CHILD_BITS) - 1)
        edges = np.append(first, len(keys))
        self.contexts = EliasFano(contexts, self.folder, "contexts")
        self.pointers = EliasFano(edges, self.folder, "pointers")
        before = np.cumsum(children[edges[1:] - 1] + np.uint64(1)) if len(first) else np.zeros(0, np.uint64)
        rank = np.repeat(np.arange(len(first)), np.diff(edges))
        self.children = EliasFano(children + np.concatenate([np.zeros(1, np.uint64), before])[rank], self.folder, "children")
        total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        codes = quantise((counts - discount) / total[rank])
        left = 1 - (np.add.reduceat(restore(codes), first) if len(first) else np.zeros(0))
        self.codes = mapped(codes, self.folder, "codes")
        self.totals = mapped(total, self.folder, "totals")
        self.weights = mapped(left.astype(np.float32), self.folder, "weights")

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ascending keys: codes (0 where a child isn't there); and of their distinct contexts, in order, tokens that follow and weight (0 and 1 where there is none)."""
        out = np.zeros(len(keys), np.uint8)
        asked, first, inverse = np.unique(keys >> np.uint64(CHILD_BITS), return_index=True, return_inverse=True)
        totals, weights = np.zeros(len(asked), np.int64), np.ones(len(asked), np.float32)
        rank, known = self.contexts.successor(asked)
        some = rank[known]
        totals[known], weights[known] = self.totals[some], self.weights[some]
        found = np.flatnonzero(known[inverse])
        if not len(found):
            return out, totals, weights
        begin, end, low, high = (np.zeros(len(asked), np.uint64) for _ in range(4))
        begin[known], end[known] = self.pointers.get(some), self.pointers.get(some + 1)
        high[known] = self.children.get(end[known].astype(np.int64) - 1) + np.uint64(1)
        later = known & (begin > 0)
        low[later] = self.children.get(begin[later].astype(np.int64) - 1) + np.uint64(1)
        of = inverse[found]
        wanted = low[of] + (keys[found] & np.uint64((1 << CHILD_BITS) - 1))
        # beyond a context's last child the search stops at its end
        place, equal = self.children.successor(np.minimum(wanted, high[of]))
        hit = equal & (place >= begin[of].astype(np.int64)) & (place < end[of].astype(np.int64))
        out[found[hit]] = self.codes[place[hit]]
        return out, totals, weights

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

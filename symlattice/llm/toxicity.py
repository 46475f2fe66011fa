"""Operator 9: toxic passages by maximum-scoring segments.

A token's score is the log-odds of the toxic class given the token, against the class's base rate. Counts are
smoothed by Dirichlet priors in a chain: a word's prior is the rate of its 6-byte prefix, that one's the rate of the
5-byte prefix, and so on up to the base rate; so unseen inflections of a known stem are scored as well. A linear-time scan
finds every maximal scoring segment of a text. Segment scores are calibrated by the extreme-value law of such maxima
(Karlin and Altschul): ``lambda`` solves E[exp(lambda * s)] = 1 over the scores of clean text, and K is fitted to the greatest
segments of clean documents. In n clean tokens E = K n exp(-lambda S) segments of a score of S or more are expected; a segment is
significant, and reported, if that is at most ``EXPECTED``. A logistic regression turns a document's greatest -ln E, the sum of it
over significant segments, the sum of their scores, their number and its length into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.text import bounded_batches, chunks, mix, prefix_hash, span_hash, text_bytes
from symlattice.plans.scratch import discard, scratch

#: Labelled rows that the classifier is fitted on at most, the first by a hash of their id.
SAMPLE = 20_000
#: Strength of each Dirichlet prior, in documents.
PRIOR = 8.0
#: z-score of the log-odds that a feature needs.
SIGNIFICANT = 3.0
#: What each token costs a segment.
DRIFT = 0.25
#: Segments of its score that a significant segment's document, were it clean, is expected to hold at most.
EXPECTED = 0.1
PREFIXES = (4, 5, 6)

#: What separates tokens here: ASCII but letters and digits.
_separator = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def token_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased prefix hashes, start and end of each token, and each document's first token (one more at the end)."""
    data, offsets = text_bytes(column)
    inside = ~_separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1 : len(data)]
    ends[:-1] &= ~inside[1:] | first[1 : len(data)]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return prefix_hash(data, True), starts, ends, np.searchsorted(starts, offsets)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens x levels) feature hashes, shortest prefix first, whole word last; and document bounds."""
    prefix, starts, ends, bounds = token_spans(column)
    levels = [mix(span_hash(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(n)) for n in PREFIXES]
    return np.stack([*levels, span_hash(prefix, starts, ends)], axis=1), bounds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by class: partial sums of a chunk."""
    for batch in chunks(batches):
        f, bounds = features(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
        docs = [np.unique(f[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        flat = np.concatenate([np.zeros(0, np.uint64), *docs])
        hit = np.repeat(toxic, [len(d) for d in docs])
        values, inverse = np.unique(flat, return_inverse=True)
        t = np.bincount(inverse, hit, len(values)).astype(np.int64)
        c = np.bincount(inverse, ~hit, len(values)).astype(np.int64)
        yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(t), pa.array(c)], ["feature", "t", "c"])


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in linear time, by Ruzzo and Tompa's method."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = k, before, total
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, k + 1, left, right))
    return [(a, b, r - x) for a, b, x, r in found]


@dataclass
class Model:
    """A fitted classifier: bounded arrays alone."""

    base: float = 0.5
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    rate: float = 0.1
    mean: np.ndarray = field(default_factory=lambda: np.zeros(5))
    spread: np.ndarray = field(default_factory=lambda: np.ones(5))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def token_scores(self, f: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log-odds of tokens above the base rate. ``own``: the class of this training document, whose own counts are left out."""
        p = np.full(len(f), self.base)
        if len(self.keys):
            for level in range(f.shape[1]):
                at = np.minimum(np.searchsorted(self.keys, f[:, level]), len(self.keys) - 1)
                known = self.keys[at] == f[:, level]
                t, c = self.toxic[at] - (own == 1), self.clean[at] - (own == 0)
                p = np.where(known, (np.maximum(t, 0) + PRIOR * p) / (np.maximum(t, 0) + np.maximum(c, 0) + PRIOR), p)
        logit = lambda x: np.log(x) - np.log1p(-x)
        return logit(np.clip(p, 1e-6, 1 - 1e-6)) - logit(self.base)

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal segments of a document's token scores, by runs: what lies between positive tokens is one cost."""
        cost = scores - DRIFT
        rise = np.flatnonzero(cost > 0)
        if not len(rise):
            return []
        sums = np.concatenate([[0.0], np.cumsum(cost)])
        steps, where, last = [], [], 0
        for k in rise.tolist():
            if k > last:
                steps.append(float(sums[k] - sums[last]))
                where.append(last)
            steps.append(float(cost[k]))
            where.append(k)
            last = k + 1
        where.append(last)
        return [(where[a], where[b], s) for a, b, s in maximal_segments(steps)]

    def evidence(self, score: float, n: int) -> float:
        """-ln of the number of segments of that score expected in ``n`` clean tokens."""
        return self.scale * score - float(np.log(self.rate * max(n, 1)))

    def significant(self, segments: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
        return [s for s in segments if self.evidence(s[2], n) >= -np.log(EXPECTED)]

    def describe(self, segments: list[tuple[int, int, float]], n: int) -> list[float]:
        kept = [s for _, _, s in self.significant(segments, n)]
        greatest = max((s for _, _, s in segments), default=0.0)
        return [self.evidence(greatest, n), sum(self.evidence(s, n) for s in kept), sum(kept), float(len(kept)), float(np.log1p(n))]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.spread) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    m = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(m.shape[1])
    ridge = np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p) + 1e-9)[:, None]).T @ m + ridge, m.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with sum(p * exp(lambda * s)) = 1; 1 where no score is positive."""
    if not len(values) or values.max() <= 0 or (values * counts).sum() >= 0:
        return 1.0
    p = counts / counts.sum()
    low, high = 1e-6, 1.0
    excess = lambda x: (p * np.exp(np.minimum(x * values, 700))).sum() - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """A model of ``labels.toxic`` from at most ``sample`` labelled rows for which ``train`` (of doc_id) holds.

    Rows without a label of 0 or 1 teach nothing; of an id with both labels the toxic one counts. The sample's ids are
    few enough to be broadcast; its texts are written once, and all that is fitted is fitted on them. Features are all words and prefixes whose
    association with the class is significant.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").where(train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = scratch(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = Model(base=(n1 + 0.5) / (n1 + n0 + 1))
    if not n1 or not n0:
        model.weights[0] = 8.0 if n1 else -8.0 if n0 else 0.0
        return model
    a1, a0 = PRIOR * n1 / (n1 + n0), PRIOR * n0 / (n1 + n0)
    odds = lambda y, a, n: F.log((F.col(y) + a) / (n + PRIOR - F.col(y) - a + 1e-3))
    table = rows.mapInArrow(_counts, "feature long, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t + c >= 3")
    z = F.abs(odds("t", a1, n1) - odds("c", a0, n0)) / F.sqrt(1 / (F.col("t") + a1) + 1 / (F.col("c") + a0))
    best = table.select("feature", "t", "c", z.alias("z")).where(F.col("z") >= SIGNIFICANT).toPandas()  # bounded by the sample
    keys = best.feature.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.toxic, model.clean = keys[order], best.t.to_numpy(float)[order], best.c.to_numpy(float)[order]

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of clean tokens, in steps of 1/8: how often each occurs."""
        counts = np.zeros(512, np.int64)
        for batch in chunks(batches):
            f, bounds = features(batch.column("text"))
            for y, a, b in zip(batch.column("toxic").to_pylist(), bounds, bounds[1:], strict=False):
                if y == 0:
                    counts += np.bincount(np.clip(np.round((shared.value.token_scores(f[a:b], 0) - DRIFT) * 8).astype(int) + 256, 0, 511), minlength=512)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used - 256, pa.int64()), pa.array(counts[used])], ["step", "n"])

    seen = rows.mapInArrow(scores, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    model.scale = _decay(np.array([r.step / 8 for r in seen]), np.array([r.n for r in seen], float))
    scaled = rows.sparkSession.sparkContext.broadcast(model)

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean documents with tokens: how many have a segment, and the sum of n exp(-lambda S) of the greatest (of n, without one)."""
        m, found, total = scaled.value, 0, 0.0
        for batch in chunks(batches):
            f, bounds = features(batch.column("text"))
            for y, a, b in zip(batch.column("toxic").to_pylist(), bounds, bounds[1:], strict=False):
                if y == 0 and b > a:
                    best = max((s for _, _, s in m.segments(m.token_scores(f[a:b], 0))), default=0.0)
                    found += best > 0
                    total += float(b - a) * float(np.exp(-m.scale * best))
        yield pa.record_batch([pa.array([found], pa.int64()), pa.array([total])], ["found", "total"])

    # n exp(-lambda S) of the greatest segment is exponential with rate K; a document without one says only that it is above n
    seen = rows.mapInArrow(greatest, "found long, total double").agg(F.sum("found").alias("found"), F.sum("total").alias("total")).first()
    model.rate = max(1, seen.found or 0) / max(1.0, seen.total or 0.0)
    again = rows.sparkSession.sparkContext.broadcast(model)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            f, bounds = features(batch.column("text"))
            y = batch.column("toxic").to_pylist()
            x = [again.value.describe(again.value.segments(again.value.token_scores(f[a:b], k)), int(b - a)) for k, a, b in zip(y, bounds, bounds[1:], strict=False)]
            yield pa.record_batch([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    fitted = rows.mapInArrow(described, "y int, x array<double>").toPandas()  # at most a row for each sampled one
    discard(rows)
    model.mean, model.spread, model.weights = _logistic(np.stack(fitted.x.to_list()), fitted.y.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_tokens, segments (start, end, score; tokens): one row a document, all of it read.

    A null text is empty; it has no segment, and the score that the model gives such a text. Other columns are
    ignored; rows that repeat are each scored; an empty table gives no row.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches):
            f, bounds = features(batch.column("text"))
            every = m.token_scores(f)
            n = np.diff(bounds)
            found = [m.segments(every[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            p = m.probability(np.array([m.describe(s, int(k)) for s, k in zip(found, n, strict=True)]).reshape(-1, 5))
            spans = [[{"start": a, "end": b, "score": x} for a, b, x in m.significant(s, int(k))] for s, k in zip(found, n, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array(n, pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_tokens", "segments"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_tokens long, segments array<struct<start:long,end:long,score:double>>")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds == 0).eqNullSafe(True)

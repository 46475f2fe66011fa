import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from symlattice.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels, ~out)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(out).collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in rows]
    toxic = [r.score >= 0.5 for r in rows if r.toxic == 1]
    clean = [r.score < 0.5 for r in rows if r.toxic == 0]
    assert np.mean(right) > 0.95 and np.mean(toxic) > 0.8 and np.mean(clean) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, None), (7, None, 0), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (awkward, empty):
        for use in (labels, labels.where("false"), labels.where("toxic = 1")):
            model = toxicity.fit(docs, use, F.lit(True))
            rows = toxicity.score(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def every_segment(x):
    """Ruzzo and Tompa's definition, by recursion: the best segment (the first, shortest), then left and right of it."""
    if not any(v > 0 for v in x):
        return []
    best = max(((sum(x[a:b]), -a, -b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
    s, a, b = best[0], -best[1], -best[2]
    left, right = every_segment(x[:a]), every_segment(x[b:])
    return [*left, (a, b, s), *[(p + b, q + b, v) for p, q, v in right]]


def test_scan_finds_every_maximal_segment():
    rng = random.Random(6)
    for _ in range(300):
        x = [rng.choice([-3.1, -2.3, -1.7, 1.3, 2.9, 4.7]) + rng.random() for _ in range(rng.randrange(14))]
        got, want = toxicity.maximal_segments(x), every_segment(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_decay_solves_its_equation():
    values, counts = np.array([-1.0, 0.5, 2.0]), np.array([90.0, 8.0, 2.0])
    x = toxicity._decay(values, counts)
    assert abs((counts / counts.sum() * np.exp(x * values)).sum() - 1) < 1e-6


def test_segments_by_runs_equal_segments_by_token():
    rng, m = np.random.default_rng(2), toxicity.Model()
    for _ in range(50):
        s = np.where(rng.random(80) < 0.1, rng.random(80) * 5, 0)
        got = m.segments(s)
        want = toxicity.maximal_segments((s - toxicity.DRIFT).tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want]


def test_scores_equal_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = toxicity.fit(documents, labels, F.lit(True))
    counts = {int(k): (t, c) for k, t, c in zip(m.keys, m.toxic, m.clean, strict=True)}
    logit = lambda p: math.log(p / (1 - p))
    assert counts and m.rate > 0

    def token_score(token):
        p = m.base
        for f in toxicity.features(pa.array([token]))[0][0]:  # shortest prefix first
            if int(f) in counts:
                t, c = counts[int(f)]
                p = (t + toxicity.PRIOR * p) / (t + c + toxicity.PRIOR)
        return logit(min(max(p, 1e-6), 1 - 1e-6)) - logit(m.base)

    known = {}
    for r in toxicity.score(documents, m).join(documents, "doc_id").collect():
        tokens = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r.text or "")
        x = [known.setdefault(t, token_score(t)) - toxicity.DRIFT for t in tokens]
        found = [s for _, _, s in toxicity.maximal_segments(x)]
        expected = lambda s, n=len(tokens): m.rate * max(n, 1) * math.exp(-m.scale * s)
        kept = [s for s in found if expected(s) <= toxicity.EXPECTED]
        values = [-math.log(expected(max(found, default=0.0))), sum(-math.log(expected(s)) for s in kept), sum(kept), len(kept), math.log(1 + len(tokens))]
        z = m.weights[0] + sum(w * (v - a) / b for w, v, a, b in zip(m.weights[1:], values, m.mean, m.spread, strict=True))
        assert len(r.segments) == len(kept) and abs(r.score - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-6

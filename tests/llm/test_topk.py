import math

import numpy as np
from pyspark.sql import functions as F

from symlattice.llm import topk


def brute(rows, k=5):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for q, v in ok:
        if q % 50:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    return sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, k).collect())


def test_ties_nulls_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4).round(1)]) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 420)]
    rows += [(500, None), (550, [1.0, None, 0.0, 0.0]), (600, [float("nan"), 0.0, 0.0, 1.0]), (650, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (700, []), (750, [1.0, 2.0]), (751, [0.5, 2.0])]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 100)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    assert run(spark, rows, 3) == brute(rows, 3)

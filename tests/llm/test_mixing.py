import re
from collections import defaultdict

from symlattice.llm import mixing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    need = 1.5 * sum(sizes.values())
    while free:
        level = need / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            need -= target[s]
        free -= over
    return target


def check(rows, docs):
    want = sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in docs)
    assert sorted((r.doc_id or -1, r["size"]) for r in rows) == want
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken <= 2 * r["size"] and r.copies == len(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    return sizes, target, taken


def test_targets_and_taken(documents):
    rows = mixing.mix(documents).collect()
    sizes, target, taken = check(rows, documents.collect())
    for s in sizes:
        # whole documents: what is left of a target is less than 2 % or than any document that could still be taken
        own = [r for r in rows if r.source == s and r["size"]]
        spare = min((r["size"] for r in own if r.copies == min(x.copies for x in own)), default=0)
        assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] <= max(0.02 * target[s], spare), s
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_awkward_rows(awkward, empty):
    check(mixing.mix(awkward).collect(), awkward.collect())
    assert mixing.mix(empty).count() == 0
    assert mixing.training_order(empty).count() == 0


def test_training_order(documents):
    plan = {r.doc_id: r for r in mixing.mix(documents).collect()}
    out = mixing.training_order(documents)
    assert out.columns == documents.columns
    seen = [r.doc_id for r in out.collect()]
    want = [d for _, d in sorted((p, r.doc_id) for r in plan.values() for p in r.positions)]
    assert seen == want


def test_query_ranks_all_copies_by_position(spark, documents):
    rows = queries.op2_mixing(spark, SF).collect()
    copies = sorted((rank, p, r.doc_id) for r in rows for rank, p in zip(r.ranks, r.positions, strict=True))
    assert [rank for rank, _, _ in copies] == list(range(len(copies))) and len(rows) == documents.count()
    assert copies == sorted(copies, key=lambda c: c[1:])
    assert [d for _, _, d in copies] == [r.doc_id for r in mixing.training_order(documents).collect()]


def test_ranks_of_awkward_rows(awkward, empty):
    rows = mixing.training_ranks(awkward).collect()
    check(rows, awkward.collect())
    assert sorted(k for r in rows for k in r.ranks) == list(range(sum(r.copies for r in rows))) and all(len(r.ranks) == r.copies for r in rows)
    again = mixing.training_ranks(awkward.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.training_ranks(empty).count() == 0


def test_training_order_of_repeats(awkward):
    want = sorted((r.doc_id or -1) for r in mixing.mix(awkward).collect() for _ in range(r.copies))
    out = mixing.training_order(awkward)
    assert out.columns == awkward.columns and sorted((r.doc_id or -1) for r in out.collect()) == want


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    rows = spark.range(101).select((F.col("id") / 100).alias("t"), F.explode(F.array(*map(F.lit, mixing.SLOPES))).alias("s"))
    rows = rows.withColumn("part", (1 - F.col("s")) * F.col("t") + F.col("s") * F.col("t") * F.col("t"))
    # the slope is a constant of each query, so each is looked at by itself
    for s in mixing.SLOPES:
        got = rows.where(F.col("s") == s).select("t", mixing.training_position(F.col("part"), F.lit(s)).alias("p")).collect()
        assert all(abs(r.t - r.p) < 1e-9 for r in got)

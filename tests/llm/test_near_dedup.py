import random
import re

import numpy as np
import pyarrow as pa

from symlattice.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(r.doc_id, shingles(r.text)) for r in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(sets)):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(i) and sets[j][0] is not None]
        out.setdefault((sets[i][0], len(sets[i][1])), set()).add(min(ids, default=None))
    return out


def check(df):
    want = brute(df.collect())
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == df.count()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.n_shingles), set()).add(r.component_id)
        assert r.kept == (r.doc_id == r.component_id)
    assert got == want


def test_components_equal_brute_force(documents):
    check(documents)


def test_awkward_rows(awkward, empty):
    check(awkward)
    assert near_dedup.near_duplicates(empty).count() == 0
    first = near_dedup.keep_first(awkward)
    assert first.columns == awkward.columns
    assert sorted((r.doc_id or -1) for r in first.collect()) == [-1, 1, 3, 4, 5, 6, 7]


def hub_group(n, seed):
    """Near copies of one text that are often linked only through it, and one that is linked with a single copy."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [" ".join(words)]


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "DENSE", 1)
    texts = hub_group(90, 1) + hub_group(60, 2) + ["short one", "Short ONE", "short one two", "a b c d e", "A b c D e"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_blocks_meet_every_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    component = {node: 0 if node < 200 else 1 if node < 240 else node for node in range(250)}
    rows = spark.createDataFrame([(5, n, c) for n, c in component.items()] + [(6, 300, 1), (6, 301, 2)], "band long, node long, component long")
    blocks = {}
    for r in near_dedup._blocks(rows).collect():
        blocks.setdefault((r.band, r.i, r.j), []).append((r.part, r.node))
    met = []
    for (band, i, j), held in blocks.items():
        assert all(part in (i, j) for part, _ in held) and len(held) < 150
        met += [(min(x, y), max(x, y)) for p, x in held for q, y in held if (p, q) == (i, j) and (i < j or x < y) and band == 5]
    assert len(met) == len(set(met)) and {(x, y) for x in component for y in component if x < y and component[x] != component[y]} <= set(met)
    # of the largest component, a copy for each part of the 50 others
    assert sum(n < 200 for held in blocks.values() for _, n in held) == 200 * 2


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.75, 0.9):
        equal = []
        for _ in range(60):
            both = rng.integers(0, 1 << 62, int(400 * j), dtype=np.uint64)
            rest = rng.integers(0, 1 << 62, 400 - len(both), dtype=np.uint64)
            half = len(rest) // 2
            s = near_dedup.sketches([np.concatenate([both, rest[:half]]), np.concatenate([both, rest[half:]])])
            equal.append((s[0] == s[1]).mean())
        assert abs(np.mean(equal) - j) < 0.02 and np.std(equal) < 0.06
    assert (near_dedup.sketches([np.array([5], np.uint64)]) != np.iinfo(np.uint64).max).all()


def test_shingle_sets_are_whole():
    text = " ".join(f"w{i}" for i in range(50_000))
    assert len(near_dedup.shingle_sets(pa.array([text]))[0]) == 49_996

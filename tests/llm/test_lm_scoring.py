import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from symlattice.llm import elias_fano, lm_scoring
from symlattice.llm.text import mix, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def class_of(word):
    h = lm_scoring._END if word is None else word_hashes(pa.array([word]))[0][0]
    return int(mix(np.array([h], np.uint64) ^ np.uint64(0x243F6A8885A308D3))[0] % np.uint64(lm_scoring.LEAST_SHARDS))


def check(df):
    docs = df.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    uni, pairs = Counter(), Counter()
    for r in docs:
        if not held(r):
            t = tokens(r.text)
            uni.update(t)
            pairs.update(zip([None, *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 1) / (n + v + 1)
    kinds = {w: class_of(w) for w in uni}
    mass, follow, taken, exact_taken = Counter(), Counter(), Counter(), Counter()
    for w in uni:
        mass[kinds[w]] += p(w)
    for (a, w), c in pairs.items():
        follow[a, kinds[w]] += c
    own = lambda a, w, c: (c - lm_scoring.DISCOUNT) / follow[a, kinds[w]]
    coarse = lambda x: elias_fano.STEP ** -math.ceil(-math.log(x) / math.log(elias_fano.STEP) - 1e-9)
    for (a, w), c in pairs.items():
        taken[a, kinds[w]] += coarse(own(a, w, c))
        exact_taken[a, kinds[w]] += own(a, w, c)

    def conditional(a, w, exact=False):
        if w not in uni:
            return lm_scoring.MU * p(w) / (uni[a] + lm_scoring.MU)
        k = kinds[w]
        seen = own(a, w, pairs[a, w]) if pairs[a, w] else 0
        left = 1 - (exact_taken if exact else taken)[a, k]
        return (follow[a, k] + lm_scoring.MU * mass[k]) / (uni[a] + lm_scoring.MU) * ((seen if exact or not seen else coarse(seen)) + left * p(w) / mass[k])

    # after any word, the probabilities of all known words and of the unknown one sum to 1
    for a in [None, *list(uni)[:3], "never seen"]:
        assert math.isclose(sum(conditional(a, w) for w in uni) + conditional(a, "not a word"), 1, rel_tol=1e-9)
    want, exact = {}, 0.0
    for r in docs:
        t = tokens(r.text)
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10(conditional(a, w)) for a, w in zip([None, *t], t, strict=False))
        # quantisation moves a token's score by less than a step
        assert abs(score - sum(math.log10(conditional(a, w, True)) for a, w in zip([None, *t], t, strict=False))) < len(t) * math.log10(elias_fano.STEP)
        want.setdefault(r.doc_id, []).append((held(r), len(t), sum(uni[w] > 0 for w in t), n, base, score))
    got = {}
    for r in lm_scoring.lm_scores(df, lm_scoring.in_fold(F.col("doc_id"))).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for k, rows in want.items():
        for a, b in zip(sorted(rows), sorted(got[k]), strict=True):
            assert a[:4] == b[:4] and all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a[4:], b[4:], strict=True)), k


def test_scores_equal_brute_force(documents):
    check(documents)


def test_small_blocks(documents, monkeypatch):
    check(documents.repartition(5))


def test_awkward_rows(awkward, empty):
    check(awkward)
    assert lm_scoring.lm_scores(empty, F.lit(False)).count() == 0
    rows = lm_scoring.lm_scores(awkward, F.lit(True)).collect()
    assert len(rows) == awkward.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)


def test_held_out_text_is_predicted_better_than_by_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_scoring.lm_scores(df, lm_scoring.in_fold(F.col("doc_id"))).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.92 * r[1]


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(7)
    for n, top in ((1, 10), (5000, 1 << 20), (7000, 1 << 63), (4096, 5000)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        ef = elias_fano.EliasFano(x, str(tmp_path), f"x{n}")
        assert np.concatenate([ef.chunk(k) for k in range(len(ef.start))]).tolist() == x.tolist()
        q = np.sort(np.concatenate([x[::3], rng.integers(0, top, 500, dtype=np.uint64)]))
        place, equal = ef.successor(q)
        assert place.tolist() == np.searchsorted(x, q).tolist() and equal.tolist() == np.isin(q, x).tolist()
        at = np.sort(rng.integers(0, len(x), 100))
        assert ef.get(at).tolist() == x[at].tolist()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 300, 20_000, dtype=np.uint64) << np.uint64(elias_fano.CHILD_BITS) | rng.integers(0, 1 << 24, 20_000, dtype=np.uint64))
    counts = rng.integers(1, 5000, len(keys))
    trie = elias_fano.Trie(keys, counts, 0.5)
    asked = np.unique(np.concatenate([keys, rng.integers(0, 1 << 34, 5000, dtype=np.uint64), np.arange(1, 310, dtype=np.uint64) * np.uint64(1 << 24) - np.uint64(1)]))
    codes, totals, weights = trie.lookup(asked)
    trie.close()
    context = keys >> np.uint64(24)
    follow = {int(c): int(counts[context == c].sum()) for c in np.unique(context)}
    held = {int(k): elias_fano.quantise(np.array([(n - 0.5) / follow[int(c)]]))[0] for k, n, c in zip(keys, counts, context, strict=True)}
    assert codes.tolist() == [held.get(int(k), 0) for k in asked]
    distinct = np.unique(asked >> np.uint64(24))
    assert totals.tolist() == [follow.get(int(c), 0) for c in distinct]
    for c, left in zip(distinct.tolist(), weights.tolist(), strict=True):
        assert math.isclose(left + elias_fano.restore(np.array([held[int(k)] for k in keys[context == c]])).sum(), 1, rel_tol=1e-6)


def test_quantised_probabilities_are_a_step_below():
    p = np.random.default_rng(9).random(10_000) ** 6
    q = elias_fano.restore(elias_fano.quantise(p))
    big = p > 1e-8
    assert (q[big] <= p[big] * (1 + 1e-8)).all() and (q[big] * elias_fano.STEP >= p[big] * (1 - 1e-8)).all()

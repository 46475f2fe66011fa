import hashlib
import random

import numpy as np
import pytest

from symlattice.llm import substring_dedup


def brute(docs, length=100):
    seen, out = set(), {}
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in docs}, key=lambda x: x[:2])
    for lost, doc, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[None if lost else doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df):
    want = brute(df.collect())
    rows = substring_dedup.remove_repeats(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_documents_equal_brute_force(documents):
    check(documents)


def test_awkward_rows(awkward, empty):
    check(awkward)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_planted_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [make(n) for n in (60, 76, 90, 98, 99, 100, 101, 120, 150, 400)] + ["a" * 300, "ab" * 120]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(make(rng.randrange(60)))
            p = rng.choice(passages)
            if rng.random() < 0.3:
                p = p[rng.randrange(20) :]
            if rng.random() < 0.2:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts.append(p)
        texts.append("".join(parts))
    check(spark.createDataFrame([(rng.randrange(10**6), t) for t in texts], "doc_id long, text string"))


def test_longest_previous_factors_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice("ab" if _ % 2 else "abcd") for _ in range(rng.randrange(1, 50))]
        shared = lambda a, b: next((n for n in range(len(s)) if max(a, b) + n >= len(s) or s[a + n] != s[b + n]), len(s))
        order = sorted(range(len(s)), key=lambda i: s[i:])
        common = np.array([0, *(shared(a, b) for a, b in zip(order, order[1:], strict=False))])
        got = substring_dedup.longest_previous(np.array(order), common)
        assert got.tolist() == [max((shared(i, j) for j in range(i)), default=0) for i in order]

import hashlib
import random

from symlattice.llm import line_dedup


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:  # cells only grow from row to row
            return most + 1
    return row[-1]


def brute_texts(docs, threshold=2, least=20):
    """(document, text left, lines, exact copies, near copies) of each document."""
    place = {}
    for r in docs:
        for at, line in enumerate((r.text or "").split("\n")):
            if len(line) >= least:
                p = (r.doc_id is None, r.doc_id or 0, at)
                place[line] = min(place.get(line, p), p)
    lines = sorted(place, key=place.get)
    near = {b for i, b in enumerate(lines) for a in lines[:i] if abs(len(a) - len(b)) <= threshold and distance(a, b, threshold) <= threshold}
    out = []
    for r in docs:
        if r.text is None:
            out.append((r, None, 0, 0, 0))
            continue
        kept, exact, close = [], 0, 0
        for at, line in enumerate(r.text.split("\n")):
            if len(line) >= least and (r.doc_id is None, r.doc_id or 0, at) > place[line]:
                exact += 1
            elif line in near and len(line) >= least:
                close += 1
            else:
                kept.append(line)
        out.append((r, "\n".join(kept), len(r.text.split("\n")), exact, close))
    return out


def brute(docs):
    return {(r.doc_id, None if text is None else hashlib.sha256(text.encode()).hexdigest(), *n) for r, text, *n in brute_texts(docs)}


def check(df):
    got = line_dedup.line_dedup(df)
    rows = got.collect()
    assert len(rows) == df.count() and got.columns[: len(df.columns)] == df.columns
    assert {(r.doc_id, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest(), r.n_lines, r.n_exact_removed, r.n_near_removed) for r in rows} == brute(df.collect())


def test_documents_equal_brute_force(spark, documents):
    check(documents)


def test_planted_edits(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef gé") for _ in range(rng.randrange(18, 40))) for _ in range(40)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(4):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(x))
                x[k : k + rng.randrange(2)] = rng.choice(["", "z", "é"])
            lines.append("".join(x))
        texts.append("\n".join(lines))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_awkward_rows(awkward, empty):
    check(awkward)
    assert line_dedup.line_dedup(empty).count() == 0

import re
from collections import Counter

from symlattice.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(rows, texts):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        want = texts[r.doc_id]
        assert got == want, (r.doc_id, got, want)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_measures_equal_brute_force(documents):
    rows = quality.quality_rules(documents).collect()
    check(rows, {r.doc_id: brute(r.text) for r in documents.collect()})
    assert 0.4 < sum(r.kept for r in rows) / len(rows) < 1


def test_awkward_rows(awkward, empty):
    rows = quality.quality_rules(awkward).collect()
    assert len(rows) == awkward.count()
    check(rows, {r.doc_id: brute(r.text) for r in awkward.collect()})
    assert quality.quality_rules(empty).count() == 0


def test_thresholds_follow_the_group(spark):
    clean = [(i, " ".join(f"w{(i * 31 + j) % 5000}" for j in range(60)), "en", "a") for i in range(300)]
    marked = [(1000 + i, " ".join(f"w{(i * 17 + j) % 5000}" + "#" * (j % 3 == 0) for j in range(60)), "en", "code") for i in range(300)]
    odd = [(5000, clean[0][1].replace("w", "##"), "en", "a")]
    rows = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(clean + marked + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not rows[5000].kept and all(rows[i].kept for i in range(300))
    assert rows[1000].max_symbol_ratio >= rows[0].max_symbol_ratio


def test_fences_tighten_and_loosen(spark):
    plain = lambda i, n=60: [f"w{1000 + (i * 31 + j * 7) % 4000}" for j in range(n)]
    again = lambda i, k: " ".join([*plain(i), *plain(i)[:k]])
    # every other document of source "loose" has its first 8 words twice: 16 of 68 words are in repeated windows
    docs = [(i, " ".join(plain(i)), "en", "tight") for i in range(300)] + [(1000 + i, again(i, 8 * (i % 2)), "en", "loose") for i in range(300)]
    docs += [(5000, again(7, 8), "en", "tight"), (5001, " ".join([*plain(8), "#"]), "en", "tight"), (5002, " ".join([*plain(8), "#" * 10]), "en", "tight")]
    rows = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(rows[i].kept for i in range(300)) and all(rows[1000 + i].kept for i in range(300))
    # the same text: out where no other repeats words, in where half of all do
    assert rows[5000].repeat_ratio == rows[1007].repeat_ratio and not rows[5000].base_failed
    assert not rows[5000].kept and rows[1007].kept
    assert rows[5000].max_repeat_ratio < 0.25 < rows[1007].max_repeat_ratio
    assert rows[5001].kept and 0.02 < rows[5002].symbol_ratio < 0.08 and not rows[5002].kept


def test_documents_that_fail_the_base_rules_move_no_fence(spark):
    good = [(i, " ".join(f"w{1000 + (i * 31 + j * 7) % 4000}" for j in range(60)), "en", "a") for i in range(300)]
    bad = [(1000 + i, "# | # |", "en", "a") for i in range(300)]
    rows = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert rows[0].max_symbol_ratio < 0.03 and all(rows[i].kept == (i < 1000) for i in rows)

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from symlattice.llm import binary_output, packing
from symlattice.llm.text import default_tokenizer, encoder


def ids_of(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [(r.doc_id, r.source, [*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]


def test_fast_encoder_gives_the_tokenizers_ids(documents):
    run = encoder(default_tokenizer())
    for r, (_, _, ids) in zip(documents.collect(), ids_of(documents), strict=True):
        assert [*run(r.text or ""), 0] == ids


def test_awkward_texts_get_the_librarys_ids():
    from tokenizers import Tokenizer

    run, own = encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x  <|endoftext|>", " " * 9_999 + "x", "\t" * 10_000, " \n" * 300 + "it's", "z" * 100_000, "", " "]
    for text in texts:
        assert run(text) == own.encode(text, add_special_tokens=False).ids, text[:30]


def test_very_long_runs_of_white_space(spark):
    rows = [(k, f"start{c * 2_000_000}end <|endoftext|> of it", None, "a") for k, c in enumerate(" \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    check(docs)
    want = {d: [x for x in ids] for d, _, ids in ids_of(docs)}
    got = binary_output.read_documents(binary_output.packed_matrices(docs)).orderBy("doc_id", "start").collect()
    for d in want:
        assert b"".join(r.ids for r in got if r.doc_id == d) == np.array(want[d], "<u4").tobytes()


def check(docs, window=1024):
    want = ids_of(docs)
    pieces = packing.pack(docs, window=window).collect()
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        seqs[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for parts in seqs.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        total = sum(p.length for p in parts)
        assert total == parts[0].sequence_length and (total == window or total & (total - 1) == 0)
    got = sorted(str((d, b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)))) for d, ps in by_doc.items() if len({p.start for p in ps}) == len(ps))
    own = defaultdict(list)
    for d, _, ids in want:
        own[d].append(np.array(ids, "<u4").tobytes())
    assert got == sorted(str((d, v[0])) for d, v in own.items() if len(v) == 1)
    assert sum(p.length for p in pieces) == sum(len(x[2]) for x in want)
    return pieces, want


def test_every_id_is_in_one_piece(documents):
    pieces, want = check(documents)
    # windows hold the sources in proportion, within what one document can upset
    total, by_source = sum(len(x[2]) for x in want), defaultdict(int)
    for _, s, ids in want:
        by_source[s] += len(ids)
    longest = max(len(x[2]) for x in want)
    half = [p for p in pieces if p.sequence_id < total // 1024 // 2]
    for s, n in by_source.items():
        assert abs(sum(p.length for p in half if p.source == s) - n / 2) <= longest + 1024, s
    digest = {(p.doc_id, p.start): zlib.crc32(p.ids) for p in pieces}
    assert len(digest) == len(pieces)


def test_every_full_window_has_the_target_proportions(documents):
    pieces = packing.pack(documents).collect()
    sizes, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        sizes[p.source] += p.length
        if p.sequence_length == 1024:
            windows[p.sequence_id][p.source] += p.length
    total = sum(sizes.values())
    assert len(windows) == total // 1024
    for w in windows.values():
        # rounds are short of a window by less than one id a queue
        assert all(abs(w[s] - 1024 * n / total) < len(sizes) for s, n in sizes.items())
        assert sum(abs(w[s] - 1024 * n / total) for s, n in sizes.items()) / 2048 < 0.02


def test_queues_place_every_id_once():
    rng = np.random.default_rng(3)
    for sizes, quanta in (([900, 50, 50, 3], [900.0, 50.0, 50.0, 3.0]), ([700, 20, 5, 40], [7.0, 2.5, 0.01, None]), ([5], [0.3]), ([4000], [64.0])):
        t = sum(q or 0 for q in quanta)
        q = packing.Queues(sizes, [x and 16 * x / t for x in quanta])
        seen, base = [], 0
        for size in sizes:
            c = [0, *sorted(set(rng.integers(1, size, 6).tolist())), size]
            for a, b in zip(c, c[1:], strict=False):
                start, place = q.parts(base + a, b - a)
                for s, e, g in zip(start, [*start[1:], b - a], place, strict=True):
                    assert e > s
                    seen += range(g, g + e - s)
            base += size
        assert sorted(seen) == list(range(sum(sizes)))


def test_awkward_rows(awkward, empty):
    check(awkward, 128)
    assert packing.pack(empty).count() == 0 and binary_output.packed_matrices(empty).count() == 0


def test_given_weights_come_first(documents):
    pieces = packing.pack(documents, weights={"src1": 1.0}).collect()
    first = min((p.sequence_id, p.offset, p.source) for p in pieces)
    assert first[2] == "src1"


def test_sequences_are_put_together(documents):
    pieces = packing.pack(documents)
    rows = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.sequence_length for r in rows)


def test_matrices_give_the_documents_back(documents, awkward, tmp_path):
    for docs in (documents, awkward):
        packed = binary_output.packed_matrices(docs, width=256)
        for r in packed.limit(50).collect():
            ids, pos = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
            assert len(ids) == len(pos) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256
            for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                assert list(pos[a:b]) == list(range(b - a))
        binary_output.write_matrices(packed, str(tmp_path / "m"))
        back = binary_output.read_documents(docs.sparkSession.read.parquet(str(tmp_path / "m")))
        got = back.groupBy("doc_id").agg(F.sum(F.length("ids") / 4).alias("n"), F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p")).collect()
        want = defaultdict(list)
        for d, _, ids in ids_of(docs):
            want[d].append(ids)
        for r in got:
            assert r.n == sum(map(len, want[r.doc_id]))
            if len(want[r.doc_id]) == 1:
                assert np.frombuffer(b"".join(p.ids for p in r.p), "<u4").tolist() == want[r.doc_id][0]


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(5)
    for width in (16, 100):
        lengths = rng.integers(1, width + 1, 300).tolist()
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(width - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
        rows = binary_output.best_fit_decreasing(lengths, width)
        assert sorted(width - sum(lengths[k] for k in r) for r in rows) == sorted(rooms)
        assert sorted(k for r in rows for k in r) == list(range(300))

from collections import defaultdict
from math import floor, sqrt

import corpus_pipeline as p
import numpy as np
from pyspark.sql import functions as F
from test_line_dedup import brute_texts
from test_mixing import WORD, brute_targets
from test_near_dedup import brute as brute_components
from test_near_dedup import shingles

from symlattice.llm import mixing, packing, quality
from symlattice.llm.sql import ORACLE
from symlattice.llm.text import default_tokenizer

SF = "/root/testdata/sf0.001"


def brute_positions(docs, hashes):
    """(position, document) of every copy that is taken, source by source."""
    by_source, out = defaultdict(list), []
    for r in docs:
        by_source[r.source].append((hashes[r.doc_id], r.doc_id, len(WORD.findall(r.text or "")), r))
    sizes = {s: sum(n for _, _, n, _ in rows) for s, rows in by_source.items()}
    target = brute_targets(sizes)
    for k, s in enumerate(sorted(x for x in sizes if x is not None) + [None] * (None in sizes)):
        rows = sorted(by_source[s], key=lambda x: x[:2])
        full = min(2, floor(target[s] / sizes[s] + 1e-9)) if sizes[s] else 0
        quota, before, at = target[s] - full * sizes[s], {}, 0
        for _, d, n, _ in rows:
            before[d] = at
            at += n
        extra = {d for _, d, n, _ in rows if full < 2 and before[d] + n <= quota}
        for _ in range(mixing.FILL_PASSES):
            gap, used = quota - sum(n for _, d, n, _ in rows if d in extra), 0
            more = set()
            for _, d, n, _ in sorted(rows, key=lambda x: (x[0] % (1 << 64), x[1])):
                if full < 2 and d not in extra and 0 < n <= gap:
                    used += n
                    if used <= gap:
                        more.add(d)
            extra |= more
        slope = mixing.SLOPES[k % 3]
        for _, d, n, r in rows:
            for i in range(full + (d in extra)):
                part = min(1.0, (i * sizes[s] + before[d] + n / 2) / target[s]) if target[s] > 0 else 0.5
                out.append((part if not slope else (sqrt((1 - slope) ** 2 + 4 * slope * part) - (1 - slope)) / (2 * slope), d, r))
    return out


def brute_pieces(rows):
    """(doc_id, source, start, length, doc_tokens, sequence_id, offset, ids) of (doc_id, source, ids), in training order: rounds are dealt one by one."""
    total, stream, at = sum(len(ids) for _, _, ids in rows), [], 0
    phases = max(1, min(packing.PHASES, total // (1024 * packing.PHASE_WINDOWS)))
    parts = [[] for _ in range(phases)]
    for k, (_, source, ids) in enumerate(rows):
        parts[floor(at / total * phases)].append((k, source, len(ids)))
        at += len(ids)
    for part in parts:
        size = defaultdict(int)
        for _, source, n in part:
            size[source] += n
        quantum = {s: n / sum(size.values()) * 1024 for s, n in size.items()}
        named = sorted((s for s in size if quantum[s] >= 1), key=lambda s: (s is not None, s or ""))
        queues = [([(k, j) for k, source, n in part if source == s for j in range(n)], quantum[s]) for s in named]
        queues.append(([(k, j) for k, source, n in part if source not in named for j in range(n)], sum(q for s, q in quantum.items() if s not in named)))
        sent, r = [0] * len(queues), 0
        while any(sent[i] < len(q) for i, (q, _) in enumerate(queues)):
            r += 1
            for i, (q, credit) in enumerate(queues):
                upto = min(len(q), floor(r * credit))
                stream.extend(q[sent[i] : upto])
                sent[i] = upto
    full, rest = divmod(total, 1024)
    edges = [1024 * i for i in range(full + 1)]
    for b in reversed(range(10)):
        if rest >> b & 1:
            edges.append(edges[-1] + (1 << b))
    out = []
    for seq, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        first = a
        for i in range(a + 1, b + 1):
            if i == b or stream[i] != (stream[i - 1][0], stream[i - 1][1] + 1):
                k, start = stream[first]
                doc_id, source, ids = rows[k]
                out.append((doc_id, source, start, i - first, len(ids), seq, first - a, np.array(ids[start : start + i - first], "<u4").tobytes()))
                first = i
    return out


def test_rows_equal_brute_force(spark):
    import duckdb
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    verdicts = con.sql(ORACLE["op1_quality_rules"])
    id_at, kept_at = verdicts.columns.index("doc_id"), verdicts.columns.index("kept")
    good = {v[id_at] for v in verdicts.fetchall() if v[kept_at]}
    Doc = type("Doc", (), {"__init__": lambda self, **values: self.__dict__.update(values)})
    rows = [Doc(doc_id=r.doc_id, source=r.source, text=text) for r, text, *_ in brute_texts([r for r in docs.collect() if r.doc_id in good])]
    component = brute_components(rows)
    first = [r for r in rows if component[r.doc_id, len(shingles(r.text))] == {r.doc_id}]
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).collect()}
    run = Tokenizer.from_file(default_tokenizer())
    order = sorted(brute_positions(first, hashes), key=lambda x: x[:2])
    want = brute_pieces([(r.doc_id, r.source, [*run.encode(r.text or "", add_special_tokens=False).ids, 0]) for _, _, r in order])
    got = [(r.doc_id, r.source, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset, bytes(r.ids)) for r in p.run(spark, SF).collect()]
    assert 0 < len(first) < len(good) < docs.count()
    assert sorted(got, key=lambda x: x[5:7]) == want


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, names = {r.doc_id: r for r in docs.collect()}, docs.columns
    frames = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, frames[-1], "").write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert frames[-1].columns == names
    good, lines, near, mixed, packed = ([r for r in f.collect()] for f in frames[1:])
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good} == kept and all(r.text == first[r.doc_id].text for r in good)
    assert {r.doc_id for r in lines} == kept and all(r.n_chars == len(r.text) for r in lines)
    assert any(r.text != first[r.doc_id].text for r in lines)
    assert len(near) == len({r.doc_id for r in near}) < len(lines)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and len(mixed) > len(near) / 2
    texts = {r.doc_id: r.text for r in lines}
    assert all(r.text == texts[r.doc_id] for r in mixed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    out = p.run(spark, "/root/testdata/sf0.001")
    assert sorted((r.doc_id, r.start, r.sequence_id) for r in out.collect()) == sorted((r.doc_id, r.start, r.sequence_id) for r in packed)


def test_awkward_rows(spark, awkward, empty, tmp_path):
    for name, docs in (("a", awkward), ("e", empty)):
        for k, (_, stage) in enumerate(p.STAGES):
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert docs.agg(F.count("sequence_id")).first()[0] >= 0


def _packed_places(spark, documents, folder):
    """(doc_id, copy) -> share of the stream before it, and the ids of each (source, half of the stream)."""
    mixing.training_order(documents).write.parquet(folder)
    pieces = [r for r in p.pack_in_order(spark.read.parquet(folder)).select("doc_id", "source", "start", "length", "sequence_id", "offset").collect()]
    total = sum(r.length for r in pieces)
    firsts, halves = {}, {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        at = (1024 * r.sequence_id + r.offset) / total
        halves[r.source, at >= 0.5] = halves.get((r.source, at >= 0.5), 0) + r.length
        if r.start == 0:
            firsts.setdefault(r.doc_id, []).append(at)
    return firsts, halves


def test_packing_follows_the_curriculum(spark, documents, tmp_path, monkeypatch):
    plan = {r.doc_id: r for r in mixing.mix(documents).collect()}
    firsts, halves = _packed_places(spark, documents, str(tmp_path / "a"))
    twice = [d for d, r in plan.items() if r.copies == 2]
    assert twice and {d: len(x) for d, x in firsts.items()} == {d: r.copies for d, r in plan.items() if r.copies}
    # copies are as far apart as their positions: one pass of their source
    far = sorted(abs((firsts[d][1] - firsts[d][0]) - (max(plan[d].positions) - min(plan[d].positions))) for d in twice)
    # (about ten documents a source in four phases: single ones are off by up to a phase on either side)
    assert far[len(far) // 2] < 0.1 and min(firsts[d][1] - firsts[d][0] for d in twice) > 0.05
    monkeypatch.setattr(mixing, "SLOPES", (0.0, 0.0, 0.0))
    flat, flat_halves = _packed_places(spark, documents, str(tmp_path / "b"))
    names = sorted({s for s, _ in halves})
    late = lambda h, k: sum(h.get((s, True), 0) for s in names[k::3]) / sum(h.get((s, b), 0) for s in names[k::3] for b in (False, True))
    assert firsts != flat
    assert late(halves, 0) < late(flat_halves, 0) - 0.03 and late(halves, 2) > late(flat_halves, 2) + 0.03

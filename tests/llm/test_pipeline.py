"""The pipeline's stages against brute-force versions of what each decides."""

from collections import defaultdict

from test_native_operators import brute_lines, water_fill

import corpus_pipeline
from dossier.llm import simhash, toxicity
from dossier.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    kept = {0: docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(rows, docs.schema)
        kept[k + 1] = rows
    # 1: what the model of these documents rejects is gone, all else stays as it is.
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(table(spark, SF, "documents"), model).collect() if r.predicted}
    assert sorted(kept[1]) == sorted(r for r in kept[0] if r.doc_id not in toxic)
    # 2: the texts without the lines that match an earlier one, by comparing all pairs of lines; the rest as it was.
    texts = brute_lines([(r.doc_id, r.text or "") for r in kept[1]])
    own = {r.doc_id: r for r in kept[1]}
    assert len(own) == len(kept[1]) == len(kept[2])
    for r in kept[2]:
        was = own[r.doc_id]
        assert (r.text or "") == texts[r.doc_id] and (r.lang, r.source, r.n_chars) == (was.lang, was.source, was.n_chars)
    # 3: one document of each group of fingerprints, the smallest id; the rest of the row as it was.
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in kept[2]}
    root = {d: d for d in fps}
    for _ in range(10):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert sorted(kept[3]) == sorted(r for r in kept[2] if root[r.doc_id] == r.doc_id)
    # 4: rows of the stage before, none more than three times, and each source's words near its target.
    times = defaultdict(int)
    for r in kept[4]:
        times[r] += 1
    assert set(times) <= set(kept[3]) and max(times.values()) <= 3
    sizes, taken = defaultdict(int), defaultdict(int)
    words = lambda r: len((r.text or "").split())
    for r in kept[3]:
        sizes[r.source] += words(r)
        taken[r.source] += times[r] * words(r)
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))})
    longest = max(map(words, kept[3]))
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    # 5: sequences are gapless and full pieces cover all that was mixed.
    by = defaultdict(list)
    for r in kept[5]:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert sum(1 for r in kept[5] if r.piece == 0) == len(kept[4])

import zlib

import numpy as np
import pytest

from dossier.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_matches_brute_force():
    rng = np.random.default_rng(5)
    letters = list("abc")
    word = lambda n: "".join(rng.choice(letters, n))
    terms = {word(n): float(i + 1) for i, n in enumerate(rng.integers(4, 11, 40))}
    lexicon = toxicity.Lexicon(terms, {})
    words = [word(n) for n in rng.integers(3, 13, 600)]
    for w, got in zip(words, lexicon.near(words), strict=True):
        want = max((terms[t] for t in terms if 0 < toxicity.edits_for(t) >= distance(w, t)), default=None)
        if len(w) >= 4:
            assert (terms[got] if got else None) == want


def test_automata():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(1, 9, 200)]
    auto, rows = toxicity.Automata(words), np.arange(200)
    for path in ("abab", "bbbbbb", "a"):
        state = auto.start()
        for ch in path:
            state = auto.step(rows, state, ch)
        for i, w in enumerate(words):
            assert [bool(s[i] & auto.end[i]) for s in state] == [distance(w, path) <= d for d in range(3)]


def test_context():
    hits = {"stupid": (0, 3.0), "worthless": (1, 2.0), "stup1d": (2, 3.0)}
    get = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, hits), strict=True))
    assert get("you Stupid one")["strong"] == 3.0
    for text in ('the word "stupid" was cited', "the word ‘stupid’ was cited", "the word “stupid” was cited"):
        assert get(text)["strong"] == 0 and get(text)["quoted"] > 0
    # Apostrophes quote nothing.
    assert get("don’t be so stupid, you’re done")["strong"] == 3.0
    assert get("the dogs’ stupid owner’s words’")["strong"] == 3.0
    assert get("you stup1d")["misspelled"] > 0
    assert get("worthless")["strong"] == 2.0
    assert not any(get("").values())


def brute_features(texts, lexicon, used):
    """Features by looking every word of every text up on its own, misspellings by plain edit distances."""
    def match(w):
        if w in lexicon.terms:
            return 0, lexicon.terms[w]
        stems = [x for s, x in lexicon.stems.items() if w.startswith(s) and len(w) > len(s)]
        if stems:
            return 1, max(stems)
        near = [x for t, x in lexicon.terms.items() if 0 < toxicity.edits_for(t) >= distance(w, t)]
        return (2, max(near)) if near and len(w) >= 4 and w not in used else None

    for t in texts:
        words = set(toxicity.TOKEN.findall((t or "").lower()))
        yield toxicity.features(t or "", {w: m for w in words if (m := match(w))})


@pytest.mark.parametrize("most", [toxicity.HITS, 0])
def test_scores_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "HITS", most)
    rng = np.random.default_rng(7)
    terms = {"".join(rng.choice(list("abcdefgh"), n)): 1.0 + i / 300 for i, n in enumerate(rng.integers(4, 12, 300))}
    lexicon, names = toxicity.Lexicon(terms, {"hgfed": 2.0}), sorted(terms)
    used = {"abcabcab", names[0][:-1]}
    def some(i):
        w = names[i % len(names)]
        return (w, w[:2] + w[3:], w[:-1] + "z", '"' + w + '"', "hgfedcc", "abcabcab", "plain")[int(rng.integers(7))]
    texts = [" ".join(some(int(rng.integers(300))) for _ in range(rng.integers(0, 12))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.Model(lexicon, np.array([-2, 0.5, 0.4, 0.3, 0.2, -0.1]), spark.createDataFrame([(w,) for w in used], "term string"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = toxicity.probability(np.array(list(brute_features(texts, lexicon, used))), model.weights)
    assert len(got) == len(texts) and np.allclose([got[i] for i in range(len(texts))], want)


def test_held_out_accuracy(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.9 * sum(y for _, y in held) and hits >= 0.85 * sum(p for p, _ in held)


@pytest.mark.parametrize("labels", ["none", "one class"])
def test_edge_rows(spark, labels):
    docs = spark.createDataFrame([(1, "fine"), (None, "x"), (2, None), (3, ""), (1, "fine"), (4, "long " * 50000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as score", "2 as _text", "3 as strong")
    y = spark.createDataFrame([(1, 0), (None, 1), (5, None)] if labels == "one class" else [], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, y)).collect()
    assert len(out) == 6 and all(r.predicted == 0 and 0 <= r.score < 0.3 for r in out)
    assert toxicity.score(docs.where("doc_id = 99"), toxicity.fit(docs, y)).count() == 0


def test_every_term_has_its_misspellings():
    terms = {f"{a}{b}mn{a}{b}pq": 1.0 for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"}
    lexicon = toxicity.Lexicon(terms, {})
    assert lexicon.near([t[:4] + "#" + t[5:] for t in sorted(terms)]) == sorted(terms)


def test_lexicon_is_whole_and_copies_count_once(spark):
    # Six thousand words of six toxic texts, one text with a word of its own in forty copies, clean texts.
    words = " ".join(f"{i:04d}" for i in range(6000))
    bad = [f"{words} t{i}" for i in range(6)] + ["copied"] * 40
    texts = [(t, 1) for t in bad] + [(f"fine c{i}", 0) for i in range(200)]
    ids = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2)  # none is held out
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in zip(ids, texts)], "doc_id long, text string, toxic int")  # noqa: B905
    lexicon = toxicity.fit(df.drop("toxic"), df.drop("text")).lexicon
    assert set(words.split()) <= set(lexicon.terms) and "copied" not in lexicon.terms

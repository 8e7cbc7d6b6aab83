"""Kept document frequencies against a recount, in any order of batches."""

import random
from collections import Counter

import pytest

from dossier.operators import store, terms


@pytest.mark.parametrize("seed", range(2))
def test_any_order_of_batches(spark, tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    versions = {}
    for d in range(12):
        for v in rng.sample(range(9), 3):
            versions[f"d{d}", v] = [rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(6))] if rng.random() < 0.8 else None
    rows = [(d, v, ts) for (d, v), ts in versions.items()]
    rng.shuffle(rows)
    frame = lambda part: spark.createDataFrame(part, "doc string, version long, terms array<string>")
    at = str(tmp_path / "t")
    assert terms.kept_term_stats(spark, at).count() == 0 and tuple(terms.kept_lengths(spark, at).first()) == (0, 0)
    cuts = [rows[:14], rows[10:25], rows[25:], rows[3:9]]
    assert sum(terms.update_term_stats(spark, at, frame(p), buckets=4) for p in cuts) == len(rows)
    last = {}
    for d, v, ts in sorted(rows, key=lambda r: (r[0], r[1])):
        last[d] = ts or []
    want = Counter(t for ts in last.values() for t in set(ts))
    assert {r.term: r.df for r in terms.kept_term_stats(spark, at).collect()} == want
    assert tuple(terms.kept_lengths(spark, at).first()) == (sum(bool(ts) for ts in last.values()), sum(map(len, last.values())))
    with monkeypatch.context() as m:  # a batch that is lost before its manifest changes nothing

        def lost(*_):
            raise RuntimeError("lost")

        m.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError):
            terms.update_term_stats(spark, at, frame([("d0", 99, ["zzz"])]), buckets=4)
    assert {r.term: r.df for r in terms.kept_term_stats(spark, at).collect()} == want


def test_repeated_and_older_versions_in_one_batch(spark, tmp_path):
    frame = lambda part: spark.createDataFrame(part, "doc string, version long, terms array<string>")
    at = str(tmp_path / "t")
    stats = lambda: ({r.term: r.df for r in terms.kept_term_stats(spark, at).collect()}, tuple(terms.kept_lengths(spark, at).first()))
    assert terms.update_term_stats(spark, at, frame([("a", 1, ["x"]), ("a", 2, ["x", "x", "y"]), ("a", 2, ["x", "x", "y"]), ("b", 5, [None, "x"]), ("c", 1, [])]), buckets=4) == 4
    assert stats() == ({"x": 2, "y": 1}, (2, 5))
    assert terms.update_term_stats(spark, at, frame([("b", 4, ["z"]), ("c", 2, ["z"]), ("a", 3, None), (None, 1, ["q"])]), buckets=4) == 3
    assert stats() == ({"x": 1, "z": 1}, (2, 3))


def test_word_lists_are_not_sorted_to_find_repeated_keys(spark, tmp_path, monkeypatch):
    seen = []
    keep = store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), keep(df, name))[1])
    rows = spark.createDataFrame([(f"d{i}", 1, ["x", f"y{i}"]) for i in range(20)], "doc string, version long, terms array<string>")
    assert terms.update_term_stats(spark, str(tmp_path / "t"), rows, buckets=4) == 20
    assert [name for name, _ in seen] == ["store-batch"] and "Aggregate" not in seen[0][1]

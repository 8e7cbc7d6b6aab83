"""The bucketed record store: idempotence, visibility, filters, contentions, compaction."""

import pytest

from dossier.operators import store


def batch(spark, rows):
    return spark.createDataFrame(rows, "record_id string, label string, uid string")


def ids(spark, folder):
    return sorted(r.record_id for r in store.read_store(spark, folder, batch(spark, [])).collect())


def merge(spark, folder, rows, **more):
    r = store.merge_into(spark, folder, batch(spark, rows), label="label", uid="uid", buckets=16, **more).first()
    return r.added, r.total, r.grew, r.contentions


def test_merges_and_contentions(spark, tmp_path):
    at = str(tmp_path / "s")
    assert ids(spark, at) == []
    first = [("a", "d/1", "u1"), ("b", "d/2", "u2"), ("b", "d/2", "u2"), ("c", None, "u3"), (None, "d/9", "u9")]
    assert merge(spark, at, first) == (3, 3, True, 0)
    assert merge(spark, at, first) == (0, 3, False, 0)
    assert merge(spark, at, []) == (0, 3, False, 0)
    # d/1 was bound to u1 by an earlier batch; d/5 is bound twice within this one; d/2 to the same unit as before.
    assert merge(spark, at, [("d", "d/1", "u7"), ("e", "d/5", "u5"), ("f", "d/5", "u6"), ("g", "d/2", "u2"), ("a", "d/2", "u8")]) == (4, 7, True, 2)
    assert ids(spark, at) == list("abcdefg")
    assert store.load_manifest(spark, at).version == 2  # a merge that adds nothing makes no version


def test_order_does_not_matter(spark, tmp_path):
    parts = [[(f"r{i}", f"l{i % 7}", f"u{i % 11}") for i in range(k, 60 + k, 2)] for k in (0, 1, 30)]
    for n, order in enumerate([(0, 1, 2), (2, 0, 1), (1, 2, 0)]):
        at = str(tmp_path / str(n))
        added = [merge(spark, at, parts[k])[0] for k in order]
        assert sum(added) == len(ids(spark, at)) == len({r[0] for p in parts for r in p})


def test_a_lost_merge_is_not_seen(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    merge(spark, at, [("a", "d/1", "u1")])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            merge(spark, at, [("b", "d/2", "u2")])
    assert ids(spark, at) == ["a"]
    assert merge(spark, at, [("b", "d/2", "u2")])[:2] == (1, 2)
    assert store.vacuum(spark, at) == 2 and ids(spark, at) == ["a", "b"]  # data and filters of the lost batch


def test_two_writers_of_one_version(spark, tmp_path):
    at = str(tmp_path / "s")
    merge(spark, at, [("a", "d/1", "u1")])
    with pytest.raises(RuntimeError, match="merge again"):
        store._commit(spark, at, store.Manifest(1))
    assert ids(spark, at) == ["a"]


def test_filters_spare_reads(spark, tmp_path):
    """Keys that are not there are seldom looked up in the store; keys that are there always."""
    at = str(tmp_path / "s")
    frame = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) as record_id")
    store.merge_into(spark, at, frame(0, 4000), buckets=64)
    assert store.merge_into(spark, at, frame(4000, 4040)).first().buckets_read <= 4
    r = store.merge_into(spark, at, frame(3990, 4100)).first()
    assert (r.added, r.total) == (60, 4100) and 0 < r.buckets_read <= 50
    m = store.compact(spark, at, frame(0, 0), buckets=8)
    assert len(m.batches) == 1 and m.total == 4100 and m.buckets == 8
    assert store.vacuum(spark, at) == 6 and store.read_store(spark, at, frame(0, 0)).distinct().count() == 4100
    placed = store._placed(frame(0, 20_000), store.F.col("record_id"), m)
    maybe = {int(r.record_id) for r in store.may_hold(spark, at, m, placed).collect()}
    assert set(range(4100)) <= maybe and len(maybe) < 4100 + 400
    r = store.merge_into(spark, at, frame(0, 4200)).first()
    assert (r.added, r.total, r.buckets_read) == (100, 4200, 8)

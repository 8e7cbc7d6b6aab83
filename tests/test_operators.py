"""Edge cases of the operators on small frames."""

import json
import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import evaluate, evidence, graph, judging, quotes, record, retrieval, review, views
from dossier.operators import store as store_of
from dossier.sources import readers, sinks
from dossier.streaming import streams


def stored(spark, folder):
    return store_of.read_store(spark, folder, spark.createDataFrame([], "sha string"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quotes(spark):
    q = spark.createDataFrame([("s", 1, "keeps the  Order"), ("s", 2, "absent"), ("s", 3, "  "), ("s", 4, "exact words")], "sha string, quote_id int, quote string")
    texts = spark.createDataFrame([("s", 0, "<message>", "it KEEPS the\norder"), ("s", 1, "a.rs", "exact words here"), ("t", 0, "b", "absent")], "sha string, ord int, place string, text string")
    got = {r.quote_id: (r.place, r.match, r.status, r.source) for r in quotes.assign_status(quotes.locate_quotes(q, texts)).collect()}
    assert got == {
        1: ("<message>", "loose", "cited", "git:s"), 2: (None, "absent", "speculative", None), 3: (None, "absent", "speculative", None), 4: ("a.rs", "exact", "cited", "a.rs@s"),
    }


def test_support_levels(spark):
    q = spark.createDataFrame([("s", i, x) for i, x in enumerate(["new line", "old line", "OLD  line", "nowhere", "say why"])], "sha string, quote_id int, quote string")
    f = spark.createDataFrame([("s", "docs/x.md", "old line", "old line\nnew line")], "sha string, path string, before string, after string")
    got = [r.support for r in quotes.check_quotes(q, f, ["Please say why it changed"]).orderBy("quote_id").collect()]
    assert got == ["Added", "InCommit", "Loose", "Absent", "Prompt"]
    kept, dropped = quotes.quote_filters(quotes.check_quotes(q, f, ["Please say why it changed"]), drop_not_added=True)
    assert kept.count() == 1 and {r.dropped_by for r in dropped.collect()} == {"not added", "prompted"}


def test_labels_and_gists(spark):
    d = spark.createDataFrame([("d/gabcdef012345-2",), ("p/gabcdef012345r3-2-1",), ("nothing",)], "l string")
    got = [tuple(r.p) for r in d.select(T.parse_label(F.col("l")).alias("p")).collect()]
    assert got == [("d", "abcdef012345", 0, 2, None), ("p", "abcdef012345", 3, 2, 1), (None,) * 5]
    g = spark.createDataFrame([("short text",), ("é" * 60 + " " + "w" * 30,), (" ".join("abcdefghijklmnopqrstuvw"),)], "t string").select(T.gist(F.col("t")), T.body(F.col("t")).isNotNull()).collect()
    assert [tuple(r) for r in g] == [("short text", False), (" …", True), (" ".join("abcdefghijklmnopqrst") + " …", True)]


def test_salvage(spark):
    cut = '{"verdicts": [{"label": "d/1", "reason": "a \\"b\\" [c"}, {"label": "d/2", "rea'
    d = spark.createDataFrame([(cut,), ("no end",), ('{"a": "x},',)], "s string").select(T.salvage_json(F.col("s")).alias("j")).collect()
    assert json.loads(d[0].j) == {"verdicts": [{"label": "d/1", "reason": 'a "b" [c'}]} and d[1].j is None and d[2].j is None


def test_reach_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "uid string")
    assert rows(graph.dependents_of(s, e)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    focus = spark.createDataFrame([("x", "d", 1), ("x", "b", 2)], "change string, uid string, rank int")
    assert {r.uid: r["rank"] for r in graph.premise_closure(focus, e).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_scope(spark):
    facts = spark.createDataFrame([("f", "f"), ("g", "g"), ("h", "h"), ("k", "k")], "label string, name string")
    calls = spark.createDataFrame([("f", "g"), ("h", "f"), ("k", "h")], "label string, callee string")
    start = spark.createDataFrame([("f", "Named"), ("f", "Touched")], "label string, reason string")
    assert rows(graph.scope_select(facts, calls, start, 1)) == [("f", "Touched"), ("g", "Calls"), ("h", "CalledBy")]


def test_view_caps(spark):
    text = "stat\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n" + "\n".join(f"+line {i}" for i in range(5)) + "\ndiff --git a/y b/y\n+only"
    lines = views.explode_diff(spark.createDataFrame([("c", text)], "change string, text string"))
    assert lines.where("marker = '+'").count() == 6 and lines.where("marker = 'h'").count() == 2
    view = views.number_shown_lines(lines, most=6, per_file=4)
    shown = [r.shown_no for r in view.orderBy("pos").collect()]
    assert shown == [1, 2, 3, 4, 5, None, None, None, 6, None]
    assert rows(views.unexamined_files(view)) == [("c", "y")]
    assert {r.file: r.part for r in views.split_change(lines, 2, most=6).collect()} == {"x": 0, "y": 1}


def test_answers_and_validation(spark):
    a = spark.createDataFrame([(1, '{"verdicts": [{"label": "[d/1]", "verdict": " Contradicts", "line": 2}]}'), (2, "[]"), (3, "oops"), (4, "{}")], "ask int, answer string")
    got, bad = judging.parse_answers(a)
    assert [r.ask for r in got.collect()] == [1] and [r.ask for r in bad.collect()] == [3]
    v = spark.createDataFrame(
        [("c", "[d/1]", 0, "x", 2, None, ""), ("c", "d/1", 1, "x", 2, None, ""), ("c", "d/2", 2, "x", None, "+ text", ""), ("c", "e/9", 3, "x", 2, None, ""), ("c", "p/1", 4, "x", 99, "zz", "")],
        "change string, label string, seq int, verdict string, line int, diff_line string, reason string",
    )
    judged = spark.createDataFrame([("c", x) for x in ("d/1", "d/2", "p/1")], "change string, label string")
    view = spark.createDataFrame([("c", 2, " two "), ("c", 3, "text")], "change string, shown_no int, content string")
    kept, dropped = judging.validate_verdicts(v, judged, view)
    assert {(r.label, r.diff_line) for r in kept.collect()} == {("d/1", "two"), ("d/2", "text")}
    assert {(r.seq, r.dropped) for r in dropped.collect()} == {(1, "repeated"), (3, "not judged"), (4, "line not shown")}


def test_policy(spark):
    runs = [
        ("c", "r1", ["a"], [], False, True), ("s", "r1", ["a"], [], False, False), ("s", "r2", ["a"], [], False, False), ("1", "r1", ["a"], [], False, False),
        ("pr", "r1", ["a"], [], True, False), ("pa", "r1", ["a"], ["b"], False, False), ("n", "r1", ["a"], [], False, False), ("u", "r1", [], ["a"], False, False),
        ("pieced", "r1", ["a"], ["b"], False, False), ("pieced", "r2", ["b"], ["a"], False, False),
    ]
    r = spark.createDataFrame(runs, "claim string, run string, covered array<string>, uncovered array<string>, prose_used boolean, contradicted boolean")
    c = spark.createDataFrame([(x, x == "n", False) for x in ("c", "s", "1", "pr", "pa", "n", "u", "pieced", "none")], "claim string, normative boolean, person boolean")
    got = {x.claim: x.verdict for x in judging.decide_verdicts(c, r).collect()}
    assert got == {
        "c": "contradicted", "s": "supported", "1": "partial", "pr": "prose-only", "pa": "partial", "n": "implemented-by", "u": "unknown", "pieced": "prose-only", "none": "unknown",
    }


def test_evidence(spark):
    code = spark.createDataFrame([("f", 1, "if a == b {"), ("f", 2, "// a == b"), ("f", 3, 'x = "a == b"'), ("f", 4, "return true"), ("f", 9, "a < b")], "file string, line int, text string")
    fn = spark.createDataFrame([("f", "g", 1, 5)], "file string, label string, start int, end int")
    assert [(r.line, r.after) for r in evidence.mutant_rows(code, fn).orderBy("line").collect()] == [(1, "if a != b {"), (4, "return false")]
    ev = spark.createDataFrame([("t1", "assert_eq", "f(a, b), f(a, b)"), ("t2", "assert_eq", 'f(a, b), "x, y"'), ("t3", "assert", "true"), ("t4", "println", "1")], "test string, macro string, args string")
    assert rows(evidence.vacuous_tests(ev)) == [("t1", ["equal sides"]), ("t3", ["always true"]), ("t4", ["no assertion"])]
    links = spark.createDataFrame([("c", "m::t"), ("c", "other")], "claim string, test string").withColumn("kind", F.lit("verifies"))
    r = spark.createDataFrame([("crate::m::t", "failed")], "test string, outcome string")
    assert rows(evidence.edge_from_link(evidence.link_readings(links, r))) == [("rebuts", "crate::m::t", "c")]


def test_review(spark):
    a = spark.createDataFrame(
        [(1, "confirm", "e1", "edge", "ann", None), (2, "reject", "e2", "edge", "ann", " "), (3, "reject", "e3", "edge", "ann", "wrong"), (4, "confirm", "l1", "contention", "ann", None), (5, "close", "l1", "contention", "ann", "ok")],
        "seq int, action string, target string, target_kind string, agent string, reason string",
    )
    log, refused = review.apply_review(a)
    assert {(r.seq, r.kind) for r in log.collect()} == {(1, "attestation"), (3, "reason"), (3, "attestation"), (3, "withdrawal"), (5, "note"), (5, "attestation"), (5, "resolution")}
    assert {r.seq for r in refused.collect()} == {2, 4}
    edges = spark.createDataFrame([("e1", "backs", "a", "b"), ("e3", "backs", "a", "b"), ("e4", "rebuts", "a", "b"), ("e5", "backs", "a", "c")], "rid string, kind string, src string, dst string")
    none = spark.createDataFrame([], "label string")
    assert [r.id for r in review.review_queue(edges, none, log).collect()] == ["e4", "e5"]


def test_scoring(spark):
    gold = spark.createDataFrame([("r", "c", "decision", "D1", "x"), ("r", "c", "decision", "D2", "y")], "repo string, commit string, kind string, id string, text string")
    sys_ = spark.createDataFrame([("r", "c", "decision", m) for m in ("D1", "D1", "none", "", "D9")], "repo string, commit string, kind string, match string")
    got, unknown = evaluate.score_system(sys_, gold)
    r = got.where("repo is null").first()
    assert (r.extracted, r.matched, r.pending, r.covered, r.labels, r.precision, r.recall) == (4, 2, 1, 1, 2, 0.666667, None)
    assert [x["match"] for x in unknown.collect()] == ["D9"]


def test_retrieval(spark):
    s = spark.createDataFrame([("c", "changeFoo in parser_core", ["p.rs"])], "claim string, text string, files array<string>")
    t = spark.createDataFrame([("t1", "p.rs", "parserCore works"), ("t2", "q.rs", "nothing here"), ("t3", "q.rs", "foo")], "label string, file string, text string")
    got = [(r.label, r["rank"]) for r in retrieval.shortlist_tests(s, t).orderBy("rank").collect()]
    assert got == [("t1", 1), ("t3", 2)]
    hits = spark.createDataFrame([("c", "d/1", 4.0), ("c", "e/1", 9.0)], "change string, label string, score double")
    anchored = spark.createDataFrame([("c", "d/2")], "change string, label string")
    assert [(r.label, r.score) for r in retrieval.merge_candidates(hits, anchored).orderBy("rank").collect()] == [("d/2", 4.5), ("d/1", 4.0)]


def test_readers(spark):
    q = spark.createDataFrame([("a" * 40,), ("b" * 80,), ("xyz",), ("abc",), ("",)], "value string")
    good, bad = readers.read_queue(q)
    assert sorted(r.sha for r in good.collect()) == ["a" * 40, "b" * 40, "b" * 40] and bad.count() == 3
    lines = spark.createDataFrame([("r", "w.yml", "run: cargo test ${{ matrix.flags }}"), ("r", "w.yml", "run: cargo build --no-default-features --features b,a")], "repo string, file string, line string")
    m = spark.createDataFrame([("r", "w.yml", "--all-features"), ("r", "w.yml", "--features z"), ("q", "w.yml", "--features other")], "repo string, file string, flags string")
    got = {(r.command, r.all_features, r.default_features, tuple(r.features)) for r in readers.read_ci_builds(lines, m).collect()}
    assert got == {("test", True, True, ()), ("test", False, True, ("z",)), ("build", False, False, ("a", "b"))}
    text = [
        "jobs:", '      - "--features b"', "  - --all-features", "  - plain", "  run: cargo test --features a ${{ matrix.f }}", "run: cargo build --features x --features y", "cargo doc --features  z",
        "cargo run --features --all-features", "cargo +nightly test --features n", "cargo install --features='p,q',", "cargo clippy && cargo test", "cargo", "no cargo here",
    ]
    lines = spark.createDataFrame([("r", "w.yml", x) for x in text] + [("r", "v.yml", "cargo doc ${{ x }}"), ("r", "v.yml", None)], "repo string, file string, line string")
    got = {(r.command, r.all_features, tuple(r.features)) for r in readers.read_ci_builds(lines).collect()}
    assert got == {
        ("test", False, ("a", "b")), ("test", True, ("a",)), ("build", False, ("x", "y")), ("doc", False, ("z",)), ("run", True, ()), ("install", False, ("p", "q")), ("clippy", False, ()),
        ("doc", False, ()),
    }


def test_streams_are_idempotent(spark, tmp_path):
    queue, store = tmp_path / "queue", str(tmp_path / "store")
    queue.mkdir()
    (queue / "1.txt").write_text("a" * 40 + "\n" + "b" * 80 + "\nnonsense\n")
    streams.drain_queue(spark, str(queue), store, str(tmp_path / "c1")).awaitTermination()
    assert stored(spark, store).count() == 2
    streams.drain_queue(spark, str(queue), store, str(tmp_path / "c2")).awaitTermination()  # a replay of all batches
    assert stored(spark, store).count() == 2
    (queue / "2.txt").write_text("c" * 40 + "\n")
    streams.drain_queue(spark, str(queue), store, str(tmp_path / "c1")).awaitTermination()
    assert stored(spark, store).count() == 3


def test_sinks(spark, tmp_path):
    u = spark.createDataFrame([("r", "s1", "x1"), ("r", "s2", "x2"), ("r", "s2", "x1")], "repo string, sha12 string, record_id string")
    for _ in range(2):
        sinks.record_commits(u, str(tmp_path / "commits"))
    assert spark.read.parquet(str(tmp_path / "commits")).count() == 3
    assert sinks.rebuild_store(spark, str(tmp_path / "commits"), str(tmp_path / "store")).count() == 2
    r = spark.createDataFrame([("a,b", "c", "passed", 0.5, "t")], "test string, commit string, outcome string, run_seconds double, toolchain string")
    sinks.write_readings_csv(r, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().test == "a;b"


def test_touched_and_stale(spark):
    before = spark.createDataFrame([("s", "f", "a", "1"), ("s", "f", "b", "2")], "sha string, path string, item string, body_hash string")
    after = spark.createDataFrame([("s", "f", "a", "1"), ("s", "f", "b", "3"), ("s", "f", "c", "4")], "sha string, path string, item string, body_hash string")
    assert [r.item for r in record.touched_items(before, after).orderBy("item").collect()] == ["b", "c"]


def test_judge_failures_become_rows(spark):
    def judge(prompt):
        if "bad" in prompt:
            raise ValueError("no answer")
        return "[]", 3

    asks = spark.createDataFrame([("1", "good"), ("2", "bad")], "ask string, prompt string")
    got = {r.ask: (r.answer, r.warning) for r in judging.ask_all(asks, judge).collect()}
    assert got["1"] == ("[]", None) and got["2"][0] is None and "no answer" in got["2"][1]


def test_sessions_without_a_shared_folder_are_told():
    from types import SimpleNamespace

    import pytest

    from dossier.operators.shared import shared_folder

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(bare, "x")
    bare.sparkContext.getCheckpointDir = lambda: "hdfs://c/dir/"
    assert shared_folder(bare, "x").startswith("hdfs://c/dir/x-")


def test_quotes_of_any_length_are_found_anywhere(spark):
    texts = [(1, "One two, three four five."), (2, "another TEXT"), (3, None), (4, "wo, thr"), (5, "é"), (6, "")]
    asked = [(1, "wo, thr"), (2, "e"), (3, "é"), (4, " "), (5, "two, three four"), (6, "TEXT"), (7, "absent words here"), (8, "One two, three four five."), (9, "xt")]
    t = spark.createDataFrame(texts, "text_id int, text string")
    q = spark.createDataFrame(asked, "quote_id int, quote string")
    want = {(i, k) for i, x in asked for k, s in texts if s and x.strip() and x in s}
    found = quotes.locate_anywhere(q, t)
    assert {tuple(r) for r in found.select("quote_id", "text_id").collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert quotes.locate_anywhere(q.where("quote_id = 99"), t).count() == 0


def test_numbers_of_a_shuffled_table(spark):
    d = evaluate.shuffled(spark.range(500).select(F.col("id")), 3)
    got = [(r.id, r["_n"]) for r in d.collect()]
    assert sorted(n for _, n in got) == list(range(1, 501)) and [i for i, n in sorted(got, key=lambda x: x[1])] != list(range(500))


def test_rendered_records(spark):
    label = lambda k, *n: f"{k}/gabc-" + "-".join(map(str, n))
    rows_ = [
        ("abc", 1, "decision", label("d", 1), "Do it", "cited", "It pays."), ("abc", 1, "prerequisite", label("p", 1, 10), "ten", "cited", None),
        ("abc", 1, "prerequisite", label("p", 1, 2), "two", "speculative", None), ("abc", 1, "alternative", label("r", 1, 1), "wait", "inferred", None),
        ("abc", 1, "consequence", label("q", 1, 1), "speed", "cited", None), ("abc", 2, "decision", label("d", 2), "Stop", "speculative", ""), ("abc", 9, "consequence", label("q", 9, 1), "lost", "cited", None),
    ]
    units = spark.createDataFrame(rows_, "sha string, decision int, item string, label string, gist string, status string, body string")
    touches = spark.createDataFrame([("abc", 1, "b::f"), ("abc", 1, "a::f")], "sha string, decision int, anchor string")
    counts = "2 decision(s), 2 prerequisite(s), 1 alternative(s), 2 consequence(s)"
    assert record.render_record(units, touches=touches).first().document == (
        f"abc: {counts}\n\nd/gabc-1 [cited]\n  Do it\n  because: It pays.\n  touches: a::f\n  touches: b::f\n  needs: two [speculative]\n  needs: ten [cited]\n"
        "  not: wait [inferred]\n  so: speed [cited]\n\nd/gabc-2 [speculative]\n  Stop\n"
    )
    assert record.render_record(units, True, touches, "\nend\n").first().document == (
        f"### Why this change\n\nRecorded from `abc` — {counts}.\n\n**Do it**\n\nIt pays.\n\nRests on:\n- two _(speculative)_\n- ten\n\nTurned down:\n- wait _(inferred)_\n"
        "\nSo:\n- speed\n\nTouches: `a::f`, `b::f`\n\n**Stop** _(speculative)_\n\nend\n"
    )


def test_parts_fit_the_view(spark):
    files = {"a": ["x" * 40] * 3, "b": ["y"] * 2, "c": ["z"] * 9, "d": ["w"], "e": ["v"], "f": ["u"]}
    rows_ = [("c", f, 100 * k + i, "+", s) for k, (f, ls) in enumerate(files.items()) for i, s in enumerate(ls)]
    lines = spark.createDataFrame(rows_, "change string, file string, pos int, marker string, content string")
    got = lambda **caps: {r.file: r.part for r in views.split_change(lines, **caps).collect()}
    assert set(got().values()) == {0}  # the view shows the change whole
    # 40 tokens: a takes 36 of them, c has more lines than a file may show; the last part takes one file.
    assert got(parts=4, per_file=5, window=80) == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 2, "f": 2}
    assert got(parts=3, per_file=5, window=80) == {"a": 0, "b": 0, "c": 1, "d": 2, "e": None, "f": None}
    assert set(got(parts=1, per_file=5, window=80).values()) == {0}


def test_extraction_files(spark, tmp_path):
    for sha, text in (("a1", '{"decisions": [{"decision": "x", "kind": "act"}, {"decision": "y"}], "alternatives": []}'), ("b2", "no json"), ("c3", '{"decisions": null, "consequences": [{"decision": 1, "text": "z", "verified": true}]}')):
        at = tmp_path / "recipe" / "repo" / f"{sha}.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = readers.read_extractions(spark, str(tmp_path / "*" / "*" / "*.json"))
    assert [(r.recipe, r.repo, r.sha, r.ordinal, r.decision) for r in got["decisions"].orderBy("ordinal").collect()] == [("recipe", "repo", "a1", 1, "x"), ("recipe", "repo", "a1", 2, "y")]
    assert [(r.sha, r.text, r.verified, r.quote) for r in got["consequences"].collect()] == [("c3", "z", True, None)]
    assert got["alternatives"].count() == 0


def test_one_long_suite_in_blocks(spark):
    """Whatever the blocks, a log gives the same readings: times reach back and repeat over block ends."""
    lines = ["test a ... ok", "test result: ok. finished in 0.00s", "test b ... FAILED", "noise", "test c ... ignored", "test result: FAILED.", "test d ... ok", "test result: ok. finished in 1.5s",
             "test e ... ok", "test result: ok.", "test x y ... ok", "test f ... ok", "test result: ok. finished in 0.25s", "test g ... ok"]
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("t", i, x) for i, x in enumerate(lines[2:5])], "suite string, pos long, line string")
    want = [("s", "a", 1.5), ("s", "b", 1.5), ("s", "c", 1.5), ("s", "d", 1.5), ("s", "e", 1.5), ("s", "f", 0.25), ("s", "g", 0.0), ("t", "b", 0.0), ("t", "c", 0.0)]
    for block in (1, 2, 3, 100):
        assert sorted((r.suite, r.test, r.run_seconds) for r in evidence.read_test_log(log, block).collect()) == want


def test_streamed_log_starts_again(spark, tmp_path):
    """Lines cut anywhere, the query stopped between the pieces: the rows are those of the whole log."""
    lines = ["test a ... ok", "test result: ok. finished in 0.00s", "test b ... FAILED", "test result: ok.", "test c ... ok", "test result: ok. finished in 2s", "test d ... ok", "test result: ok", "test e ... ok"]
    log = [("s", i, x) for i, x in enumerate(lines)]
    schema = "suite string, pos long, line string"
    src, out, at = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (log[:3], log[3:4], log[4:7], log[7:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        q = streams.stream_test_log(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at)
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).unionByName(streams.waiting_tests(spark, at))
    want = evidence.read_test_log(spark.createDataFrame(log, schema))
    assert rows(got) == rows(want.select(*got.columns)) and streams.waiting_tests(spark, at).count() == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_streamed_suites_share_calls(spark, tmp_path, kind):
    """Many suites, a null one among them, in few groups: their calls do not grow with the suites, nor do times mix."""
    src, out, at = (str(tmp_path / n) for n in ("in", "out", "state"))
    suite = F.when(F.col("id") % 300 != 7, F.col("id") % 300 + (1 << 60)).cast(kind)
    result = F.concat(F.lit("test result: ok. finished in "), (F.col("id") % 7).cast("string"), F.lit("s"))
    line = F.when((F.col("id") / 300).cast("int") % 4 == 3, result).otherwise(F.concat(F.lit("test t"), F.col("id").cast("string"), F.lit(" ... ok")))
    log = spark.range(3000).select(suite.alias("suite"), F.col("id").alias("pos"), line.alias("line"))
    for k in range(2):
        log.where(F.floor(F.col("pos") / 1500) == k).write.mode("append").parquet(src)
        q = streams.stream_test_log(spark.readStream.schema(log.schema).parquet(src), groups=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", at)
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).unionByName(streams.waiting_tests(spark, at))
    named = F.lit("-1").cast(kind)  # a name for the suite without one, which joins would lose
    want = evidence.read_test_log(log.withColumn("suite", F.coalesce("suite", named))).withColumn("suite", F.nullif("suite", named))
    assert got.schema["suite"].dataType == log.schema["suite"].dataType
    assert rows(got) == rows(want.select(*got.columns))
    assert spark.read.format("statestore").load(at).count() <= 3


def test_groups_of_a_large_change(spark):
    """Blocks of any size give the groups of one fold."""
    import random

    rng = random.Random(5)
    costs = {c: [rng.choice([1, 30, 300, 900, 5000]) for _ in range(n)] for c, n in (("a", 83), ("b", 1), ("c", 7))}
    want = {}
    for c, xs in costs.items():
        group, n, used = 0, 0, 64
        for pos, x in enumerate(xs, 1):
            if n and (n >= 6 or used + x + 8 > 1000):
                group, n, used = group + 1, 0, 64
            n, used = n + 1, used + x + 8
            want[c, pos] = group
    units = spark.createDataFrame([(c, i, f"{c}{i}", x) for c, xs in costs.items() for i, x in enumerate(xs, 1)], "change string, pos int, label string, cost long")
    for block in (1, 2, 5, 7, 4096):
        got = views.fit_groups(units, room=1000, block=block).collect()
        assert {(r.change, r.pos): r.group for r in got} == want and len(got) == len(want)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_of_changes_are_counted_by_file(spark):
    """Labels of several files count once a change; the others are counted before they meet the changes."""
    src = [("a", "f@x"), ("a", "g@x"), ("a", "f@y"), ("b", "f@x"), ("c", "h@x"), ("d", None), ("e", "no path")]
    units = spark.createDataFrame(src, "label string, source string")
    files = spark.createDataFrame([("1", "f"), ("1", "g"), ("2", "g"), ("3", "h"), ("3", "h"), ("4", "z")], "change string, file string")
    got = retrieval.count_anchored_units(units, files)
    assert rows(got) == rows(retrieval.units_anchored_to_files(units, files).groupBy("change").count()) == [("1", 2), ("2", 1), ("3", 1)]


def test_views_and_parts_without_a_task_call_a_change(spark):
    """Random changes, shown and parted as by the fold line by line; no Python call for each change."""
    import random

    rng = random.Random(3)
    data = []
    for c in range(40):
        pos = 0
        for f in range(rng.choice([1, 3, 9])):
            for i in range(rng.choice([1, 4, 12])):
                head = i == 0 and c % 2 == 0
                data.append((f"c{c}", f"f{rng.randrange(9) if c % 3 == 0 else f}", pos, "h" if head or rng.random() < 0.1 * (c % 4) else rng.choice("+- n"), rng.choice([None, "", "x", "é" * 9, "y" * 40])))
                pos += 1
    caps = {"most": 14, "per_file": 5, "window": 120}
    shown, parts = {}, {}
    for c in sorted({r[0] for r in data}):
        mine, view = [r for r in data if r[0] == c], views.View(14, 5, 60, 4.0)
        shown |= {(c, r[2]): view.add(r[3], r[4]) for r in mine}
        of, part, open_ = {}, 0, None
        for f in dict.fromkeys(r[1] for r in mine):
            def fill(old):
                v = views.View(14, 5, 60, 4.0)
                if old:
                    v.shown, v.used, v.cut = old.shown, old.used, old.cut
                for r in mine:
                    if r[1] == f:
                        v.add(r[3], r[4])
                return v
            if part >= 2:
                of[f] = None
                continue
            joined = open_ and fill(open_)
            if joined and joined.cut:
                part, joined = part + 1, None
            open_ = joined or fill(None)
            of[f] = part
        parts |= {(c, r[2]): of[r[1]] if view.cut else 0 for r in mine}
    lines = spark.createDataFrame(data, "change string, file string, pos int, marker string, content string")
    a, b = views.number_shown_lines(lines, **caps), views.split_change(lines, 3, **caps)
    assert {(r.change, r.pos): r.shown_no for r in a.collect()} == shown
    assert {(r.change, r.pos): r.part for r in b.collect()} == parts and b.count() == len(data)
    assert "FlatMapGroupsInPandas" not in plan_of(a) and "InPandas" not in plan_of(b)


def test_numbering_groups_takes_no_call_a_change(spark):
    units = spark.range(50).selectExpr("cast(id as string) change", "1 pos", "'l' label", "5L cost")
    got = views.fit_groups(units)
    assert {r.group for r in got.collect()} == {0} and "MapInArrow" in plan_of(got)
    assert plan_of(got).count("FlatMapGroupsInPandas") <= 2  # answers and entries of changes of more than one block


def test_only_suspect_arguments_are_parted(spark):
    cases = [("assert_eq", "f( a,b ), f(a, b )"), ("assert_eq", "f(a, b), f(a,b)"), ("assert_ne", "x , x, why"), ("assert_eq", "a, b"), ("assert_eq", '"a,b" , "a,b"'), ("assert_eq", "(a, a)"),
             ("assert", " true , x"), ("assert", "1  == 1"), ("assert", "!  false"), ("assert", "!false"), ("assert", "truely"), ("assert_eq", None), ("assert_eq", "a b, ab"), ("println", "a, a")]
    ev = spark.createDataFrame([(f"t{i:02}", *c) for i, c in enumerate(cases)], "test string, macro string, args string")
    parted = lambda r: [] if r.args is None else [re.sub(r"\s+", " ", p).strip() for p in r.parts]
    want = {}
    for r in ev.withColumn("parts", evidence.top_level_parts(F.col("args"))).collect():
        p = parted(r)
        if r.macro == "println":
            want[r.test] = ["no assertion"]
        elif r.macro != "assert" and len(p) > 1 and p[0] == p[1]:
            want[r.test] = ["equal sides"]
        elif r.macro == "assert" and p[:1] and p[0] in ("true", "1 == 1", "! false", "!false"):
            want[r.test] = ["always true"]
    got = evidence.vacuous_tests(ev)
    assert {r.test: r.reasons for r in got.collect()} == want
    assert "ObjectHashAggregate" not in plan_of(got)  # sets of reasons made it sort all events

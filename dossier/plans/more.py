"""More queries over whole tables: passes, verdicts, evidence, review, reports. Importing this adds them to QUERIES."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, evidence, judging, record, retrieval, review, views
from ..sources import readers
from .queries import query

EVENT_SQL = "e AS (SELECT *, event_id % 3 AS pass, user_id % 50 AS change, event_type || '/' || (user_id % 7) AS label FROM events)"


def event_findings(t) -> DataFrame:
    """Events as findings of three passes over changes."""
    label = F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string"))
    return t("events").select("event_id", (F.col("event_id") % 3).alias("pass"), (F.col("user_id") % 50).alias("change"), label.alias("label"), "value", "ts")


@query(f"""WITH {EVENT_SQL}, n AS (SELECT change, label FROM e GROUP BY ALL HAVING count(DISTINCT pass) = 3)
SELECT event_id, change, label FROM e SEMI JOIN n USING (change, label) WHERE pass = 2""")
def agreed_findings(t) -> DataFrame:
    agreed, _ = judging.agree_passes(event_findings(t).select("event_id", "pass", "change", "label"), 3)
    return agreed.select("event_id", "change", "label")


@query(f"WITH {EVENT_SQL} SELECT change, label, min(event_id) AS event_id FROM e GROUP BY ALL")
def first_findings(t) -> DataFrame:
    return judging.first_per_key(event_findings(t), ["change", "label"], ["event_id"]).select("change", "label", "event_id")


@query("SELECT user_id::VARCHAR AS label, count(DISTINCT event_type) AS uids FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def contended_labels(t) -> DataFrame:
    return record.label_contentions(t("events").select(F.col("user_id").cast("string").alias("label"), F.col("event_type").alias("uid")))


@query("""
WITH b AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS uid FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS label, uid FROM orders JOIN b ON o_orderkey = l_orderkey WHERE n = 1
""")
def resolved_labels(t) -> DataFrame:
    bound = t("lineitem").select(F.col("l_orderkey").cast("string").alias("label"), F.col("l_returnflag").alias("uid"))
    return record.resolve_labels(t("orders").select(F.col("o_orderkey").cast("string").alias("label")), bound)[0]


RUNS_SQL = """
r AS (SELECT user_id AS claim, event_type AS run, list_sort(list(DISTINCT CASE WHEN event_id % 5 > 0 THEN (event_id % 4)::VARCHAR END) FILTER (WHERE event_id % 5 > 0)) AS cov,
    list_sort(list(DISTINCT (event_id % 4)::VARCHAR) FILTER (WHERE event_id % 5 = 0)) AS unc, bool_or(event_id % 11 = 0) AS prose, bool_or(event_id % 97 = 0) AS con FROM events GROUP BY ALL),
s AS (SELECT claim, run, coalesce(cov, []) AS cov, coalesce(unc, []) AS unc, prose, con, coalesce(len(unc), 0) = 0 AND coalesce(len(cov), 0) > 0 AND NOT prose AS sound FROM r),
g AS (SELECT claim, bool_or(con) AS con, flatten(list(cov)) AS cov, flatten(list(unc)) AS unc, bool_or(sound) AS structural, count(DISTINCT run) FILTER (WHERE sound AND NOT con) AS agreeing FROM s GROUP BY claim),
h AS (SELECT *, list_sort(list_distinct(list_filter(unc, lambda x: NOT list_contains(cov, x)))) AS open_ FROM g)
"""


@query(f"""WITH {RUNS_SQL} SELECT claim, CASE WHEN con THEN 'contradicted' WHEN len(cov) = 0 THEN 'unknown' WHEN len(open_) = 0 AND NOT structural THEN 'prose-only'
    WHEN len(open_) > 0 THEN 'partial' WHEN claim % 13 = 0 THEN 'implemented-by' WHEN claim % 17 = 0 OR agreeing >= 2 THEN 'supported' ELSE 'partial' END AS verdict,
    CASE WHEN NOT con AND (len(cov) = 0 OR len(open_) > 0) THEN array_to_string(open_, ',') ELSE '' END AS uncovered FROM h""")
def claim_verdicts(t) -> DataFrame:
    e = t("events").withColumn("part", (F.col("event_id") % 4).cast("string"))
    hit = F.col("event_id") % 5 > 0
    runs = e.groupBy(F.col("user_id").alias("claim"), F.col("event_type").alias("run")).agg(
        F.collect_set(F.when(hit, F.col("part"))).alias("covered"), F.collect_set(F.when(~hit, F.col("part"))).alias("uncovered"),
        F.bool_or(F.col("event_id") % 11 == 0).alias("prose_used"), F.bool_or(F.col("event_id") % 97 == 0).alias("contradicted"),
    )
    claims = e.select(F.col("user_id").alias("claim")).distinct().select("claim", (F.col("claim") % 13 == 0).alias("normative"), (F.col("claim") % 17 == 0).alias("person"))
    return judging.decide_verdicts(claims, runs).withColumn("uncovered", F.array_join("uncovered", ","))


LOG_SQL = """
l AS (SELECT user_id, event_id AS pos, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'ignored' ELSE 'passed' END AS outcome,
    CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE (event_id % 9) / 4.0 END END AS said FROM events),
f AS (SELECT *, coalesce(first_value(CASE WHEN said > 0 THEN said END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS s FROM l)
"""


def event_log(t) -> DataFrame:
    """Each user's events as lines of a test log."""
    k = F.col("event_id")
    time = F.when(k % 4 == 0, F.lit("0.00")).otherwise(F.format_number((k % 9) / 4.0, 2))
    result = F.when(k % 5 == 0, "FAILED").when(k % 7 == 0, "ignored").otherwise("ok")
    line = F.when(k % 6 == 0, F.concat(F.lit("test result: ok. 1 passed; finished in "), time, F.lit("s"))).otherwise(F.concat(F.lit("test m::t"), k.cast("string"), F.lit(" ... "), result))
    return t("events").select(F.col("user_id").alias("suite"), k.alias("pos"), line.alias("line"))


@query(f"WITH {LOG_SQL} SELECT user_id AS suite, 'm::t' || pos AS test, outcome, s::DOUBLE AS run_seconds FROM f WHERE outcome IS NOT NULL")
def test_readings(t) -> DataFrame:
    return evidence.read_test_log(event_log(t)).select("suite", "test", "outcome", "run_seconds")


@query(f"""WITH {LOG_SQL}, m AS (SELECT user_id, pos, outcome FROM f WHERE outcome IS NOT NULL)
SELECT user_id AS test, count(*) FILTER (WHERE outcome = 'failed') AS caught, count(*) FILTER (WHERE outcome = 'passed') AS missed, count(*) FILTER (WHERE outcome = 'ignored') AS unviable,
    count(*) FILTER (WHERE outcome <> 'ignored') = 0 OR count(*) FILTER (WHERE outcome = 'failed') > 0 AS backs FROM m GROUP BY user_id""")
def mutation_scores(t) -> DataFrame:
    r = evidence.read_test_log(event_log(t)).select(F.col("suite").alias("test"), F.col("pos").alias("mutant"), (F.col("outcome") != "ignored").alias("ran"), (F.col("outcome") == "passed").alias("passed"))
    return evidence.mutation_score(r).drop("reason")


@query("""
WITH l AS (SELECT page_id AS change, unnest(string_split(coalesce(html, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(html, ''), chr(10))))) AS pos FROM pages)
SELECT change, count(*) + 1 AS lines, count(*) FILTER (WHERE substr(line, 1, 1) = '+' AND substr(line, 1, 3) <> '+++') AS added, count(*) FILTER (WHERE substr(line, 1, 1) = '-' AND substr(line, 1, 3) <> '---') AS removed FROM l GROUP BY change
""")
def diff_lines(t) -> DataFrame:
    return page_diffs(t).groupBy(F.col("change").cast("long").alias("change")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("marker") == "+").alias("added"), F.count_if(F.col("marker") == "-").alias("removed")
    )


def page_diffs(t) -> DataFrame:
    """Pages as changes of one file, named by its page."""
    p = t("pages").select(F.col("page_id").cast("string").alias("change"), F.concat(F.lit("preamble\ndiff --git a/x b/"), F.col("page_id").cast("string"), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("text"))
    return views.explode_diff(p)


@query("""
SELECT l_suppkey AS arm, l_linenumber AS task, count(*) FILTER (WHERE l_returnflag = 'R') AS violated, count(*) FILTER (WHERE l_returnflag = 'A') AS harness_error, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS stopped,
    count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus <> 'F') AS intact FROM lineitem GROUP BY ALL UNION ALL
SELECT l_suppkey, NULL, count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag = 'A'), count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F'), count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus <> 'F') FROM lineitem GROUP BY ALL
""")
def run_outcomes(t) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "R", "violated").when(F.col("l_returnflag") == "A", "harness-error").when(F.col("l_linestatus") == "F", "stopped").otherwise("intact")
    runs = t("lineitem").select(F.col("l_suppkey").alias("arm"), F.col("l_linenumber").alias("task"), outcome.alias("outcome"), F.col("l_extendedprice").alias("cost"))
    return evaluate.run_matrix(runs).drop("cost")


@query("""
SELECT l_orderkey::VARCHAR AS change, count(*) AS calls, round(sum(l_quantity), 2) AS predicted, round(sum(l_quantity * 2), 2) AS charged FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT NULL, count(*), round(sum(l_quantity), 2), round(sum(l_quantity * 2), 2) FROM lineitem
""")
def token_totals(t) -> DataFrame:
    calls = t("lineitem").select(F.col("l_orderkey").cast("string").alias("change"), F.col("l_quantity").alias("predicted"), (F.col("l_quantity") * 2).alias("charged"))
    u = judging.token_usage(calls)
    return u.select("change", "calls", F.round("predicted", 2).alias("predicted"), F.round("charged", 2).alias("charged"))


@query("""
WITH s AS (SELECT source AS sha, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source), m AS (SELECT sha, bytes, least(4 + bytes / 1024.0 / 25, 35.0) AS minutes FROM s)
SELECT sha, bytes::BIGINT AS bytes, round(minutes, 6) AS minutes FROM m UNION ALL SELECT NULL, sum(bytes)::BIGINT, round(sum(minutes), 6) FROM m
""")
def cost_estimates(t) -> DataFrame:
    files = t("documents").select(F.col("source").alias("sha"), F.col("text").alias("after"))
    return record.cost_estimate(files).select("sha", "bytes", F.round("minutes", 6).alias("minutes"))


@query("""
WITH c AS (SELECT conv_id AS repo, conv_id || '/' || turn AS sha, max(turn) OVER (PARTITION BY conv_id) - turn AS age, length(text) % 4 = 0 AS recorded, length(text) % 7 = 0 AS own FROM conversations),
p AS (SELECT *, max(recorded::INT) OVER (PARTITION BY repo ORDER BY age) AS past FROM c) SELECT repo, sha, age FROM p WHERE past = 0 AND NOT own
""")
def commit_backlog(t) -> DataFrame:
    from pyspark.sql import Window

    c = t("conversations").select(F.col("conv_id").alias("repo"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sha"), "turn", F.length("text").alias("n"))
    c = c.withColumn("age", F.max("turn").over(Window.partitionBy("repo")) - F.col("turn"))
    return record.backlog(c.select("repo", "sha", "age"), c.where("n % 4 = 0"), c.where("n % 7 = 0"))


@query("""
WITH o AS (SELECT o_orderpriority AS kind, o_orderkey % 11 > 0 AS a, o_orderkey % 13 > 0 AS b, o_orderkey % 5 > 0 AS same FROM orders)
SELECT kind, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b, count(*) FILTER (WHERE a AND b AND same) AS same_v FROM o GROUP BY 1
""")
def run_comparison(t) -> DataFrame:
    a = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") % 5 == 0, F.concat("v", F.lit("x"))).otherwise(F.col("v")))
    return evaluate.compare_runs(a.where("id % 11 > 0"), b.where("id % 13 > 0"), ["v"], ["kind"])


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS repo, o_orderdate AS at, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT id, CASE WHEN (k - 1) % 2 = 0 THEN 'dev' ELSE 'held-out' END AS split FROM c
""")
def case_splits(t) -> DataFrame:
    c = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("repo"), F.col("o_orderdate").alias("at"))
    return evaluate.alternate_split(c, ["repo"]).select("id", "split")


@query("""
WITH c AS (SELECT o_orderpriority AS kind, n, r, d, o_orderstatus = 'F' AS truth, o_custkey AS tokens, o_totalprice AS s FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber > 3) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS d, bool_or(l_returnflag = 'R' AND l_linenumber > 3) AS r FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)
SELECT kind, count(*) AS cases, count(*) FILTER (WHERE n > 0) AS flagged, sum(n)::BIGINT AS flags, count(*) FILTER (WHERE truth) AS contradicting, count(*) FILTER (WHERE truth AND r) AS recalled, count(*) FILTER (WHERE truth AND NOT r AND n > 0) AS missed,
    round(count(*) FILTER (WHERE truth AND r) / count(*) FILTER (WHERE truth), 6) AS recall, sum(tokens)::BIGINT AS tokens, list_sort(list(s))[(count(*) // 2 + 1)::INT] AS seconds, sum(d)::BIGINT AS drops FROM c GROUP BY ROLLUP (kind)
""")
def detector_recall(t) -> DataFrame:
    cases = t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("contradicting"), F.col("o_totalprice").alias("seconds"), F.lit(1).alias("task"), F.col("o_custkey").alias("tokens")
    )
    findings = t("lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("task"), F.col("l_returnflag").alias("text"))
    patterns = cases.select("task").distinct().withColumn("pattern", F.lit("^r$"))
    dropped = t("lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id"))
    return evaluate.detector_report(cases, findings, evaluate.pattern_hits(findings, patterns), dropped)


@query("""
SELECT o_orderkey AS id, o_shippriority_ AS task, flags FROM (SELECT *, o_orderkey % 3 AS o_shippriority_ FROM orders WHERE o_orderstatus = 'F') o
JOIN (SELECT l_orderkey, count(*) AS flags, list(l_returnflag) AS fs FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey WHERE NOT list_contains(fs, ['N', 'R', 'A'][(o_shippriority_ + 1)::INT])
""")
def missed_flags(t) -> DataFrame:
    """Contradicting orders with line items, none of which has the flag that the order's task asks for."""
    task = F.col("o_orderkey") % 3
    cases = t("orders").select(F.col("o_orderkey").alias("id"), task.alias("task"), (F.col("o_orderstatus") == "F").alias("contradicting"))
    findings = t("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 3).alias("task"), F.col("l_returnflag").alias("text"))
    patterns = cases.select("task").distinct().withColumn("pattern", F.element_at(F.array(F.lit("^n$"), F.lit("^r$"), F.lit("^a$")), (F.col("task") + 1).cast("int")))
    return evaluate.missed_cases(cases, findings, evaluate.pattern_hits(findings, patterns))


@query("""
WITH b AS (SELECT DISTINCT l_linenumber AS build, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT DISTINCT p_type AS item, p_brand AS feature, p_size > 48 AS negated FROM part), k AS (SELECT DISTINCT build FROM b),
h AS (SELECT n.item, k.build, bool_and(negated <> (n.feature IN (SELECT b.feature FROM b WHERE b.build = k.build))) AS holds FROM n, k GROUP BY ALL),
g AS (SELECT item, count(*) FILTER (WHERE holds) AS c FROM h GROUP BY item), i AS (SELECT DISTINCT p_type AS item FROM part)
SELECT i.item, CASE WHEN g.item IS NULL THEN 'always' WHEN c = (SELECT count(*) FROM k) THEN 'always' WHEN c = 0 THEN 'never' ELSE 'some' END AS coverage, coalesce(c, (SELECT count(*) FROM k)) AS builds FROM i LEFT JOIN g ON i.item = g.item
""")
def build_coverage(t) -> DataFrame:
    part = t("part")
    builds = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_linenumber").alias("build"), F.col("p_brand").alias("feature"))
    needs = part.select(F.col("p_type").alias("item"), F.col("p_brand").alias("feature"), (F.col("p_size") > 48).alias("negated"))
    return evidence.feature_coverage(part.select(F.col("p_type").alias("item")).distinct(), needs, builds)


@query("""
WITH m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'backs' WHEN event_id % 3 = 1 THEN 'x.code/exercises' ELSE 'rebuts' END AS kind, user_id FROM events)
SELECT event_id::VARCHAR AS id, kind, kind = 'rebuts' AS unresolved FROM m WHERE event_id % 13 > 0 AND ((kind <> 'rebuts' AND user_id % 4 > 0) OR (kind = 'rebuts' AND user_id % 5 > 0))
""")
def waiting_reviews(t) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "backs").when(k % 3 == 1, "x.code/exercises").otherwise("rebuts")
    e = t("events").select(k.cast("string").alias("rid"), kind.alias("kind"), F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), "user_id", k)
    row = lambda where, what: e.where(where).select(F.lit(what).alias("kind"), F.col("rid").alias("target"), F.lit("human").alias("agent_kind"))
    log = row("user_id % 4 = 0", "attestation").union(row("event_id % 13 = 0", "withdrawal")).union(row("user_id % 5 = 0", "resolution"))
    none = e.where("1 = 0").select(F.col("rid").alias("label"))
    return review.review_queue(e.drop("user_id", "event_id"), none, log).select("id", "kind", "unresolved")


@query("""
WITH w AS (SELECT conv_id AS change, turn AS pos, unnest(string_split_regex(text, '[^A-Za-z0-9_]')) AS term, unnest(range(len(string_split_regex(text, '[^A-Za-z0-9_]')))) AS i FROM conversations),
g AS (SELECT change, term, count(*) AS n, min(pos * 1000000 + i) AS at_ FROM w WHERE strlen(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY n DESC, at_) AS k FROM g) SELECT change, term FROM r WHERE k <= 80
""")
def change_terms(t) -> DataFrame:
    c = t("conversations").select(F.col("conv_id").alias("change"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    files = c.select("change", F.lit("").alias("file")).distinct()
    return retrieval.diff_query(c, files)


@query("""
WITH p AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN '{"verdicts": [{"label": "d/1", "verdict": "Contradicts", "line": ' || user_id || '}]}' WHEN event_id % 4 = 1 THEN '[]' WHEN event_id % 4 = 2 THEN 'no json' ELSE '{}' END AS a FROM events)
SELECT event_id AS ask, 'd/1' AS label, user_id::INT AS line FROM p WHERE event_id % 4 = 0
""")
def parsed_answers(t) -> DataFrame:
    k = F.col("event_id")
    obj = F.concat(F.lit('{"verdicts": [{"label": "d/1", "verdict": "Contradicts", "line": '), F.col("user_id").cast("string"), F.lit("}]}"))
    answer = F.when(k % 4 == 0, obj).when(k % 4 == 1, "[]").when(k % 4 == 2, "no json").otherwise("{}")
    rows, _ = judging.parse_answers(t("events").select(k.alias("ask"), answer.alias("answer")))
    return judging.verdict_is_contradiction(rows).select("ask", "label", "line")


@query("""
WITH q AS (SELECT doc_id, md5(text) AS a, sha1(text) AS s, doc_id % 3 AS k FROM documents)
SELECT substr(s, 1, 40) AS sha FROM q WHERE k = 0 UNION ALL SELECT s FROM q WHERE k = 1 UNION ALL SELECT sha1(a) FROM q WHERE k = 1
""")
def queued_commits(t) -> DataFrame:
    s = F.sha1(F.col("text").cast("binary"))
    k = F.col("doc_id") % 3
    line = F.when(k == 0, s).when(k == 1, F.concat(s, F.sha1(F.md5("text").cast("binary")))).otherwise(F.lit("not a commit"))
    return readers.read_queue(t("documents").select(line.alias("value")))[0]


@query("SELECT user_id || '/' || event_type AS record_id, user_id % 3 AS part FROM events WHERE event_id % 4 > 0 GROUP BY ALL")
def merged_store(t) -> DataFrame:
    """Three logs that overlap, merged in two orders: both give the same records, each once."""
    e = t("events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("record_id"), (F.col("user_id") % 3).alias("part"), "event_id")
    a, b, c = (e.where(F.col("event_id") % 4 == k).drop("event_id") for k in (1, 2, 3))
    one, two = review.merge_store(review.merge_store(a, b), c), review.merge_store(c, review.merge_store(b, review.merge_store(a, a)))
    return one.join(two, ["record_id", "part"])


@query("""
WITH s AS (SELECT user_id AS id, event_type AS kind, (user_id % 20)::VARCHAR AS text FROM events), e AS (SELECT DISTINCT user_id AS id, event_type AS kind, (user_id % 20)::VARCHAR AS text FROM events WHERE user_id % 2 = 0)
SELECT s.id, s.kind, CASE WHEN e.id IS NULL THEN '' ELSE 'g' || e.id END AS match FROM s LEFT JOIN e USING (id, kind, text)
""")
def carried_matches(t) -> DataFrame:
    s = t("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 20).cast("string").alias("text"))
    earlier = s.where("id % 2 = 0").withColumn("match", F.concat(F.lit("g"), F.col("id").cast("string")))
    return evaluate.carry_adjudications(s, earlier).select("id", "kind", "match")

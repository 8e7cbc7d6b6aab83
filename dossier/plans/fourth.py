"""Queries on text functions, readers, sinks, rendering, evidence and views. Importing this adds them to QUERIES."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, evidence, judging, quotes, record, staleness, store, terms, views
from ..operators.shared import shared_folder
from ..sources import readers, sinks
from ..streaming import streams
from .more import LOG_SQL, event_log, page_diffs
from .queries import query, words_of


def scratch(df: DataFrame, name: str) -> str:
    return shared_folder(df.sparkSession, name)


NOISE_SQL = "['the', 'and', 'not', 'for', 'with', 'that', 'this', 'test', 'tests', 'fn']"
IDENTS = r"""list_filter(list_distinct(list_concat(
    list_filter(list_transform(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: lower(w)), lambda w: strlen(w) >= 3 AND NOT regexp_matches(w, '^\p{{N}}+$')),
    list_filter(flatten(list_transform(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: string_split(lower(regexp_replace(w, '(\p{{Lu}})', '_\1', 'g')), '_'))), lambda w: strlen(w) >= 3))),
    lambda w: NOT list_contains(""" + NOISE_SQL + ", w))"
FOLDED = r"""list_transform(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) >= 3), lambda w: regexp_replace(w, '^(.{{3,}}?)(ing|ed|es|ly|s)$', '\1'))"""


@query(rf"""
SELECT conv_id, turn, len({IDENTS.format('text')}) AS idents, md5(array_to_string({FOLDED.format('text')}, ' ')) AS folded,
    'see [id] and [id] in ' || role AS scrubbed, regexp_replace(role || ' ' || substr(text, 1, 9), '[^\p{{L}}\p{{N}}\-._]', '-', 'g') AS agent,
    sha256(role || chr(31) || text) AS print, coalesce(CASE WHEN turn > 1 THEN role END, 'none') AS role, substr(md5(text), 1, 12) AS short,
    CASE WHEN regexp_extract(text, '(?s)^(.*?\.) ', 1) <> '' THEN regexp_extract(text, '(?s)^(.*?\.) ', 1) ELSE left(text, 110) END AS sentence,
    CASE WHEN turn > 1 THEN role || ' ' || text ELSE role END AS claim,
    greatest(2000.0, (turn * 1000 - 500) * 3.5 - 4000) AS room, ceil(turn * 3.5 / 4)::BIGINT AS units,
    ceil(strlen(role) / 4.0)::BIGINT + ceil(strlen(text) / 4.0)::BIGINT + 100 AS reserve,
    least(ceil(strlen(role) / 4.0)::BIGINT + ceil(strlen(text) / 4.0)::BIGINT + 100 + 300 * turn, greatest(450, ceil(strlen(role) / 4.0)::BIGINT + ceil(strlen(text) / 4.0)::BIGINT + 612)) AS ceiling FROM conversations
""")
def scalar_functions(t) -> DataFrame:
    s, turn = F.col("text"), F.col("turn")
    reserve = T.check_reserve(T.token_cost(F.col("role")), T.token_cost(s), F.lit(100))
    ids = F.concat(F.lit("see d/g"), F.left(F.md5(s), F.lit(12)), F.lit("-1 and "), F.md5(s), F.lit(" in "), F.col("role"))
    return t("conversations").select(
        "conv_id", "turn", F.size(T.identifier_terms(s)).alias("idents"), F.md5(F.array_join(T.search_terms(s), " ")).alias("folded"), T.scrub_ids(ids).alias("scrubbed"),
        T.agent_name(F.concat("role", F.lit(" "), F.substring(s, 1, 9))).alias("agent"), T.fingerprint(F.col("role"), s).alias("print"),
        T.null_default(F.when(turn > 1, F.col("role")), "none").alias("role"), T.short_sha(F.md5(s)).alias("short"), T.first_sentence(s).alias("sentence"),
        T.claim_text(F.col("role"), F.when(turn > 1, s)).alias("claim"), T.input_room(turn * 1000, F.lit(500), F.lit(3.5)).alias("room"), T.budget_units(turn, 3.5).alias("units"),
        reserve.alias("reserve"), T.check_budget(reserve, 300 * turn, F.lit(450)).alias("ceiling"),
    )


@query("""
SELECT doc_id, md5(replace(array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> ''), ' '), chr(10), ' ')) AS one,
    len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> '')) > 1 AS several FROM documents
""")
def single_paragraphs(t) -> DataFrame:
    s = F.col("text")
    return t("documents").select("doc_id", F.md5(T.one_paragraph(s)).alias("one"), T.reflowed(s).alias("several"))


@query("""
SELECT event_id AS ask, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"verdicts": [{"label": "d/' || user_id || '", "reason": "' || event_type || '"}]}' END AS answer FROM events
""")
def salvaged_answers(t) -> DataFrame:
    row = F.concat(F.lit('{"verdicts": [{"label": "d/'), F.col("user_id").cast("string"), F.lit('", "reason": "'), "event_type", F.lit('"}'))
    cut = F.when(F.col("event_id") % 3 == 0, F.lit('{"verdicts": [{"label": "d')).otherwise(F.concat(row, F.lit(', {"label": "d/9", "rea')))
    return t("events").select(F.col("event_id").alias("ask"), T.salvage_json(cut).alias("answer"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN repeat('x', 1048577) WHEN doc_id % 3 = 0 THEN repeat('é', 4000) || chr(0) WHEN doc_id % 3 = 1 THEN repeat('é', 5000) || chr(0) ELSE text END AS a FROM documents)
SELECT doc_id AS sha, CASE WHEN doc_id % 50 <> 7 AND doc_id % 3 <> 0 THEN strlen(a) END AS bytes FROM c
""")
def commit_texts(t) -> DataFrame:
    k = F.col("doc_id")
    after = F.when(k % 50 == 7, F.repeat(F.lit("x"), 1048577)).when(k % 3 == 0, F.concat(F.repeat(F.lit("é"), 4000), F.lit("\0"))).when(
        k % 3 == 1, F.concat(F.repeat(F.lit("é"), 5000), F.lit("\0"))).otherwise(F.col("text"))
    got = readers.load_commit_texts(t("documents").select(k.alias("sha"), F.lit("f").alias("path"), F.lit("").alias("before"), after.alias("after")))
    return got.select("sha", F.octet_length("after").cast("long").alias("bytes"))


CI_SQL = """
w AS (SELECT DISTINCT p_brand AS repo, p_mfgr_ AS file, ['test', 'build', 'check', 'install', '+nightly doc'][(p_size % 5 + 1)::INT] AS command,
    [' --features a ${{ matrix.f }}', ' --features x --features y', ' --features  z', ' --features --all-features', ' ${{ matrix.flags }}', ' --features "b,a," --features=c'][(p_size % 6 + 1)::INT] AS rest
    FROM (SELECT *, 'w' || p_partkey % 2 AS p_mfgr_ FROM part)),
m AS (SELECT DISTINCT p_brand AS repo, 'w' || p_partkey % 2 AS file, CASE p_size % 3 WHEN 0 THEN '--all-features' WHEN 1 THEN '--no-default-features --features ' || lower(p_type) ELSE '--features b' END AS flags FROM part WHERE p_partkey % 2 = 0),
j AS (SELECT w.repo, command, concat_ws(' ', rest, flags) AS line FROM w LEFT JOIN m ON contains(rest, '${{') AND w.repo = m.repo AND w.file = m.file WHERE command IN ('test', 'build', 'install')),
f AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(line, '--features[ =]*([^ ]*)', 1), lambda x: string_split(x, ','))), lambda y: trim(y, '",')),
    lambda z: z <> '' AND NOT starts_with(z, '--')))) AS features FROM j),
b AS (SELECT DISTINCT repo, command, contains(line, '--all-features') AS all_features, NOT contains(line, '--no-default-features') AS default_features, array_to_string(features, ',') AS features FROM f)
"""


def workflows(t) -> DataFrame:
    """Two workflow files a brand; every line runs one command, the first file's list items are its matrix."""
    part = t("part").select("p_size", F.col("p_brand").alias("repo"), F.concat(F.lit("w"), (F.col("p_partkey") % 2).cast("string")).alias("file"), F.lower("p_type").alias("type"), "p_partkey")
    pick = lambda k, *items: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    command = pick(F.col("p_size") % 5, "test", "build", "check", "install", "+nightly doc")
    rest = pick(
        F.col("p_size") % 6, " --features a ${{ matrix.f }}", " --features x --features y", " --features  z", " --features --all-features", " ${{ matrix.flags }}", ' --features "b,a," --features=c'
    )
    flags = F.when(F.col("p_size") % 3 == 0, F.lit("--all-features")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("--no-default-features --features "), "type")).otherwise(F.lit("--features b"))
    runs = part.select("repo", "file", F.concat(F.lit("  - run: cargo "), command, rest).alias("line"))
    items = part.where("p_partkey % 2 = 0").select("repo", "file", F.concat(F.lit('      - "'), flags, F.lit('"')).alias("line"))
    return runs.unionByName(items).unionByName(part.select("repo", "file", F.lit("      - plain").alias("line")))


@query(f"WITH {CI_SQL} SELECT repo, command, all_features, default_features, features FROM b")
def ci_builds(t) -> DataFrame:
    b = readers.read_ci_builds(workflows(t))
    return b.select("repo", "command", "all_features", "default_features", F.array_join("features", ",").alias("features"))


@query(f"""WITH {CI_SQL}, k AS (SELECT row_number() OVER () AS build, unnest(string_split(features, ',')) AS feature FROM b WHERE features <> ''), n AS (SELECT DISTINCT p_type AS item, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE 'a' END AS feature FROM part),
h AS (SELECT n.item, k.build, count(DISTINCT n.feature) AS has FROM n JOIN k USING (feature) GROUP BY ALL), c AS (SELECT item, count(*) AS needed FROM n GROUP BY item),
g AS (SELECT c.item, count(h.build) FILTER (WHERE has = needed) AS holds FROM c LEFT JOIN h ON h.item = c.item GROUP BY c.item)
SELECT item, CASE WHEN holds = (SELECT count(DISTINCT build) FROM k) THEN 'always' WHEN holds = 0 THEN 'never' ELSE 'some' END AS coverage, holds AS builds FROM g""")
def ci_coverage(t) -> DataFrame:
    """What the workflows' builds cover, of features that go by part types."""
    b = readers.read_ci_builds(workflows(t)).where(F.size("features") > 0)
    builds = b.select(F.sha2(F.to_json(F.struct("*")), 256).alias("build"), F.explode("features").alias("feature"))
    needs = t("part").select(F.col("p_type").alias("item"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.lit("a")).alias("feature"), F.lit(False).alias("negated"))
    return evidence.feature_coverage(needs.select("item").distinct(), needs, builds)


@query("""
WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT 'decision' AS kind, conv_id::VARCHAR AS commit, 'D' || k AS id, role || ' ' || turn AS text FROM c
UNION ALL SELECT 'alternative', conv_id::VARCHAR, 'A' || k, CASE WHEN turn % 2 = 0 THEN 'not ' || turn ELSE 'not ' || turn || ' — ' || role END FROM c
""")
def extracted_items(t) -> DataFrame:
    c = t("conversations").select(F.col("conv_id").cast("string").alias("sha"), "turn", "role")
    n = F.col("turn").cast("string")
    decision = F.struct("turn", F.concat_ws(" ", "role", n).alias("decision"), F.lit("").alias("kind"))
    other = F.struct("turn", (F.col("turn") + 1).cast("int").alias("decision"), F.concat(F.lit("not "), n).alias("alternative"), F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("role")).alias("reason"))
    docs = c.groupBy("sha").agg(F.array_sort(F.collect_list(decision)).alias("decisions"), F.array_sort(F.collect_list(other)).alias("alternatives"))
    items = readers.explode_extractions(docs.select(F.lit("x").alias("recipe"), F.lit("r").alias("repo"), "sha", F.to_json(F.struct("decisions", "alternatives")).alias("value")))
    d = items["decisions"].where("kind = 'act'").select("repo", F.col("sha").alias("commit"), F.lit("decision").alias("kind"), F.col("ordinal").alias("pos"), F.col("decision").alias("text"), F.lit(None).cast("string").alias("reason"))
    a = items["alternatives"].select("repo", F.col("sha").alias("commit"), F.lit("alternative").alias("kind"), F.col("ordinal").alias("pos"), F.col("alternative").alias("text"), "reason")
    return evaluate.normalise_extracted(d.unionByName(a)).select("kind", "commit", "id", "text")


@query("""
WITH r AS (SELECT o_orderkey AS id, o_custkey % 2 = 0 AS again, o_orderkey % 3 = 0 AS found FROM orders),
l AS (SELECT id, CASE WHEN again THEN 1 ELSE 0 END AS run FROM r WHERE again OR found)
SELECT id::VARCHAR AS id, run, CASE WHEN id % 7 = 0 THEN 'patch' ELSE 'commit' END AS kind, CASE WHEN id % 7 = 0 THEN true ELSE id % 2 = 0 END AS contradicting, id % 5 = 0 AS failed FROM l
""")
def latest_results(t) -> DataFrame:
    """Two runs of cases as JSON: the second has half of the cases again; the first has findings for a third."""
    k = F.col("o_orderkey")
    finding = F.array(F.struct(F.lit("d/1").alias("label"), F.lit("x").alias("text")))
    row = lambda findings: [
        k.cast("string").alias("id"), F.lit("commit").alias("kind"), (k % 2 == 0).alias("contradicting"), findings.alias("findings"),
        F.array(F.when(k % 5 == 0, F.lit("a call failed: x")).otherwise(F.lit("slow"))).alias("warnings"),
    ]
    orders = t("orders")
    paths = [scratch(orders, "results") for _ in range(2)]
    orders.select(*row(F.when(k % 3 == 0, finding))).write.json(paths[0])
    orders.where("o_custkey % 2 = 0").select(*row(finding)).write.json(paths[1])
    results = readers.read_case_results(orders.sparkSession, paths)
    registry = orders.where(k % 7 == 0).select(k.cast("string").alias("id"), F.lit("patch").alias("kind"), F.lit(None).cast("int").alias("task"), F.lit(True).alias("contradicting"))
    whole, failed = readers.split_failed(evaluate.relabel_cases(results, registry))
    both = whole.withColumn("failed", F.lit(False)).unionByName(failed.withColumn("failed", F.lit(True)))
    return both.select("id", "run", "kind", "contradicting", "failed")


@query("SELECT event_type AS repo, count(DISTINCT user_id) AS records FROM events GROUP BY 1")
def rebuilt_store(t) -> DataFrame:
    """Each event type's users as records of commits, written twice; the store is rebuilt from all commits."""
    e = t("events").select(F.col("event_type").alias("repo"), (F.col("user_id") % 3).cast("string").alias("sha12"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("record_id"))
    commits, at = scratch(e, "commits"), scratch(e, "store")
    for _ in range(2):
        sinks.record_commits(e, commits)
    return sinks.rebuild_store(e.sparkSession, commits, at, buckets=8).groupBy("repo").agg(F.count("*").alias("records"))


@query("""
SELECT user_id % 5 = 0 AS again, count(DISTINCT event_type || '/' || user_id) AS records, count(DISTINCT event_type || '/' || user_id) AS logged FROM events GROUP BY 1
""")
def streamed_records(t) -> DataFrame:
    """Records as they arrive in files, merged twice into one store; the log keeps what is appended."""
    e = t("events").select((F.col("user_id") % 5 == 0).alias("again"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("record_id"))
    folder, at, log = (scratch(e, n) for n in ("arriving", "store", "log"))
    e.write.parquet(folder)
    for _ in range(2):
        arriving = e.sparkSession.readStream.schema(e.schema).parquet(folder)
        streams.merge_stream(arriving, at, scratch(e, "stream"), buckets=8).awaitTermination()
    stored = store.read_store(e.sparkSession, at, e)
    sinks.append_review(stored.where("again"), log)
    sinks.append_review(stored.where("not again"), log)
    logged = e.sparkSession.read.parquet(log).groupBy("again").agg(F.count("*").alias("logged"))
    return stored.groupBy("again").agg(F.count("*").alias("records")).join(logged, "again")


@query("""
WITH q AS (SELECT sha1(text) AS sha, doc_id FROM documents) SELECT DISTINCT sha FROM q WHERE doc_id % 3 < 2
    AND sha NOT IN (SELECT sha FROM q GROUP BY sha HAVING bool_and(doc_id % 4 = 0))
""")
def drained_commits(t) -> DataFrame:
    """Documents as queued commits; those whose files are all in the record's own folder are dropped."""
    d = t("documents").select(F.sha1(F.col("text").cast("binary")).alias("sha"), "doc_id")
    folder, at = scratch(d, "queue"), scratch(d, "drained")
    d.select(F.when(F.col("doc_id") % 3 < 2, F.col("sha")).otherwise(F.lit("no commit")).alias("value")).write.text(folder)
    files = d.select("sha", F.when(F.col("doc_id") % 4 == 0, F.lit("corpus/x")).otherwise(F.lit("src/x")).alias("path"))
    streams.drain_queue(d.sparkSession, folder, at, scratch(d, "stream"), files=files, buckets=8).awaitTermination()
    return store.read_store(d.sparkSession, at, d.select("sha"))


@query("""
WITH r AS (SELECT DISTINCT CASE WHEN event_id % 5 < 2 THEN 1 WHEN event_id % 5 < 4 THEN 2 ELSE 3 END AS batch, user_id || '/' || event_type AS record_id, 'd/' || user_id % 500 AS label, user_id % 1500 AS uid FROM events),
f AS (SELECT record_id, label, uid, min(batch) AS batch FROM r GROUP BY ALL), s AS (SELECT unnest([1, 2, 3]) AS batch),
c AS (SELECT s.batch, f.label FROM s JOIN f ON f.batch <= s.batch GROUP BY ALL HAVING max(f.batch) = s.batch AND count(DISTINCT uid) > 1),
a AS (SELECT s.batch, count(*) FILTER (WHERE f.batch = s.batch) AS added, count(*) AS total FROM s JOIN f ON f.batch <= s.batch GROUP BY s.batch)
SELECT batch AS step, added, total, added > 0 AS grew, (SELECT count(*) FROM c WHERE c.batch = a.batch) AS contentions FROM a
UNION ALL SELECT 4, 0, max(total), false, 0 FROM a
""")
def store_merges(t) -> DataFrame:
    """Events in three batches that overlap, merged one after the other, and the second one again."""
    k, user = F.col("event_id") % 5, F.col("user_id")
    e = t("events").select(
        F.when(k < 2, 1).when(k < 4, 2).otherwise(3).alias("batch"), F.concat_ws("/", user.cast("string"), "event_type").alias("record_id"),
        F.concat(F.lit("d/"), (user % 500).cast("string")).alias("label"), (user % 1500).alias("uid"),
    )
    at, spark, out = scratch(e, "store"), e.sparkSession, None
    for step, k in ((1, 1), (2, 2), (3, 3), (4, 2)):
        report = store.merge_into(spark, at, e.where(F.col("batch") == k), label="label", uid="uid", buckets=8)
        row = report.select(F.lit(step).alias("step"), "added", "total", "grew", "contentions")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
SELECT replace(c_name || ',' || c_mktsegment, ',', ';') AS test, c_custkey::VARCHAR AS commit, 'passed' AS outcome, c_acctbal::DOUBLE AS run_seconds FROM customer
""")
def readings_csv(t) -> DataFrame:
    r = t("customer").select(F.concat_ws(",", "c_name", "c_mktsegment").alias("test"), F.col("c_custkey").alias("commit"), F.lit("passed").alias("outcome"), F.col("c_acctbal").alias("run_seconds"), F.lit("t").alias("toolchain"))
    folder = scratch(r, "csv")
    sinks.write_readings_csv(r, folder)
    back = r.sparkSession.read.csv(folder, header=True, schema="test string, commit string, outcome string, run_seconds double, toolchain string")
    return back.drop("toolchain")


def short_units(t) -> DataFrame:
    """Turns as decisions (even) and prerequisites (odd) of their conversation, with short texts."""
    c = t("conversations").select(F.md5(F.col("conv_id").cast("string")).alias("sha"), F.col("turn").alias("pos"), "role")
    c = c.withColumn("decision", F.floor(F.col("pos") / 2).cast("int") + 1).withColumn("kind", F.when(F.col("pos") % 2 == 0, "decision").otherwise("prerequisite"))
    c = record.number_items(c).withColumns({
        "text": F.concat_ws(" ", "role", F.col("pos").cast("string")), "item_kind": F.lit("act"), "verified": F.lit(False), "run": F.lit(0),
        "status": F.when(F.col("pos") % 3 == 0, "cited").otherwise("speculative"), "source": F.concat(F.lit("f@"), "sha"),
    })
    return record.build_units(c)


SHORT_SQL = """
u AS (SELECT md5(conv_id::VARCHAR) AS sha, turn AS pos, turn // 2 + 1 AS decision, role || ' ' || turn AS text, turn % 2 = 0 AS head, CASE WHEN turn % 3 = 0 THEN 'cited' ELSE 'speculative' END AS status FROM conversations),
l AS (SELECT *, CASE WHEN head THEN 'd/g' || substr(sha, 1, 12) || '-' || decision ELSE 'p/g' || substr(sha, 1, 12) || '-' || decision || '-1' END AS label,
    sha256('{"kind":"' || CASE WHEN head THEN 'decision' ELSE 'constraint' END || '","code_kind":"act","gist":"' || text || '","body":null,"status":"' || status || '","source":' ||
    CASE WHEN status = 'cited' THEN '"f@' || sha || '"' ELSE 'null' END || ',"grounds":[],"payload":{"code:kind":"act"}}') AS uid FROM u)
"""


@query(f"WITH {SHORT_SQL} SELECT label, uid FROM l")
def unit_uids(t) -> DataFrame:
    return short_units(t).select("label", "uid")


@query(f"""WITH {SHORT_SQL}, g AS (SELECT sha, decision, max(CASE WHEN head THEN label || ' [' || status || ']' || chr(10) || '  ' || text || chr(10) || CASE WHEN decision % 2 = 0 THEN '  touches: a::' || decision || chr(10) ELSE '' END END) AS block,
    coalesce(string_agg('  needs: ' || text || ' [' || status || ']' || chr(10), '' ORDER BY strlen(label), label) FILTER (WHERE NOT head), '') AS needs FROM l GROUP BY ALL)
SELECT sha, any_value(sha || ': ' || d || ' decision(s), ' || p || ' prerequisite(s), 0 alternative(s), 0 consequence(s)' || chr(10)) || string_agg(chr(10) || block || needs, '' ORDER BY decision) AS document
FROM g JOIN (SELECT sha, count(*) FILTER (WHERE head) AS d, count(*) FILTER (WHERE NOT head) AS p FROM l GROUP BY sha) n USING (sha) WHERE block IS NOT NULL GROUP BY sha""")
def rendered_record(t) -> DataFrame:
    u = short_units(t)
    touches = u.where("item = 'decision' and decision % 2 = 0").select("sha", "decision", F.concat(F.lit("a::"), F.col("decision").cast("string")).alias("anchor"))
    return record.render_record(u, touches=touches)


@query(f"""WITH {SHORT_SQL}, b AS (SELECT p.label, d.label AS to_, d.head FROM l p JOIN l d ON p.uid = p.uid AND p.sha = d.sha AND p.decision = d.decision AND NOT p.head AND d.head)
SELECT l.label, l.label || ' (' || CASE WHEN l.head THEN 'decision' ELSE 'constraint' END || ', ' || status || CASE WHEN status = 'cited' THEN ', f@' || sha ELSE '' END || ')' || chr(10) || text || chr(10) ||
    coalesce('  conditions -> ' || b.to_, '') AS block FROM l LEFT JOIN b ON l.label = b.label""")
def rendered_units(t) -> DataFrame:
    u = short_units(t).withColumn("uid", F.sha2(F.concat("label", "uid"), 256))  # equal texts of two commits stay two units here
    return record.render_units(u, record.build_edges(u)).select("label", "block")


@query("""
WITH c AS (SELECT md5(conv_id::VARCHAR) AS sha, turn, text, role FROM conversations), k AS (SELECT *, turn % 2 = 0 AS head, CASE WHEN turn % 4 = 1 THEN substr(text, 3, 20) ELSE md5(text) END AS check_ FROM c),
v AS (SELECT k.sha, turn, NOT head AND trim(check_) <> '' AND EXISTS (SELECT 1 FROM c WHERE c.sha = k.sha AND contains(c.text, check_)) AS ok, head FROM k)
SELECT CASE WHEN ok THEN 'backs' ELSE 'none' END AS edge, count(*) AS n FROM v WHERE NOT head GROUP BY 1
UNION ALL SELECT 'causes', count(*) FROM v WHERE NOT head UNION ALL SELECT 'finding', count(*) FROM v WHERE ok
""")
def checked_consequences(t) -> DataFrame:
    """Odd turns as consequences that claim to be verified by a quote of their own turn, or by one that is nowhere."""
    c = t("conversations").select(F.md5(F.col("conv_id").cast("string")).alias("sha"), F.col("turn").alias("pos"), "text", "role")
    check = F.when(F.col("pos") % 4 == 1, F.substring("text", 3, 20)).otherwise(F.md5("text"))
    items = c.where("pos % 2 = 1").select("sha", "pos", F.lit(True).alias("claimed"), check.alias("check"))
    texts = c.select("sha", F.col("pos").alias("ord"), F.col("role").alias("place"), "text")
    got = quotes.check_consequences(items, texts).withColumn("kind", F.lit("consequence"))
    heads = c.where("pos % 2 = 0").select("sha", "pos", F.lit("decision").alias("kind"), F.lit(False).alias("verified"))
    all_ = heads.unionByName(got.select("sha", "pos", "kind", "verified", "check", "check_status", "check_source"), allowMissingColumns=True)
    # Texts are made unlike, so that no two units are one.
    all_ = all_.withColumns({
        "decision": F.floor(F.col("pos") / 2).cast("int") + 1, "text": F.concat_ws("/", "sha", F.col("pos").cast("string")), "item_kind": F.lit("act"), "run": F.lit(0),
        "status": F.lit("speculative"), "source": F.lit(None).cast("string"), "check": F.concat_ws(" ", "check", "sha", F.col("pos").cast("string")),
    })
    u = record.build_units(record.number_items(all_))
    edges = record.build_edges(u)
    n = lambda df, name: df.agg(F.lit(name).alias("edge"), F.count("*").alias("n"))
    none = items.join(got.where("verified").select("sha", "pos"), ["sha", "pos"], "left_anti")
    return n(edges.where("kind = 'backs'"), "backs").union(n(none, "none")).union(n(edges.where("kind = 'causes'"), "causes")).union(n(u.where("kind = 'finding'"), "finding"))


@query(f"WITH {LOG_SQL} SELECT user_id AS suite, 'm::t' || pos AS test, outcome, s::DOUBLE AS run_seconds FROM f WHERE outcome IS NOT NULL")
def streamed_readings(t) -> DataFrame:
    """The test log as it arrives in four pieces, with what still waits when it ends."""
    log, spark = event_log(t), t("events").sparkSession
    folder, out, at = (scratch(log, n) for n in ("log", "readings", "stream"))
    most = log.agg(F.max("pos")).first()[0] or 0
    for k in range(4):
        log.where((F.col("pos") * 4 > k * most) & (F.col("pos") * 4 <= (k + 1) * most) | ((k == 0) & (F.col("pos") <= 0))).write.mode("append").parquet(folder)
        readings = streams.stream_test_log(spark.readStream.schema(log.schema).parquet(folder))
        readings.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).unionByName(streams.waiting_tests(spark, at))
    return rows.select("suite", "test", "outcome", "run_seconds")


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'ignored' ELSE 'passed' END AS outcome FROM events),
k AS (SELECT *, ['verifies', 'exercises', 'unrelated'][(event_id % 3 + 1)::INT] AS kind FROM r WHERE outcome IS NOT NULL)
SELECT CASE WHEN kind = 'exercises' THEN 'x.code/exercises' WHEN outcome = 'passed' THEN 'backs' ELSE 'rebuts' END AS kind, 'm::t' || event_id AS src, event_id AS dst, 'm::t' || event_id || ' ' || outcome || ' at c' AS gist, 'tool' AS agent_kind
FROM k WHERE kind <> 'unrelated'
""")
def linked_tests(t) -> DataFrame:
    readings = evidence.read_test_log(event_log(t))
    kind = F.element_at(F.array(*map(F.lit, ["verifies", "exercises", "unrelated"])), (F.col("event_id") % 3 + 1).cast("int"))
    links = t("events").select(F.col("event_id").alias("claim"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("test"), kind.alias("kind"))
    edges = evidence.edge_from_link(evidence.link_readings(links, readings))
    units = evidence.readings_to_units(readings.withColumn("commit", F.lit("c")))
    signed = units.join(evidence.reading_attestations(units, "importer"), F.col("uid") == F.col("target")).select(F.col("test").alias("src"), "gist", "agent_kind")
    return edges.join(signed, "src").select("kind", "src", "dst", "gist", "agent_kind")


@query("""
WITH l AS (SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS line, CASE WHEN l_linenumber % 4 = 0 THEN '// a == b' WHEN l_linenumber % 4 = 1 THEN 'if a < ' || l_partkey WHEN l_linenumber % 4 = 2 THEN 'say("a == b")' ELSE 'a + true' END AS text FROM lineitem),
m AS (SELECT file, line, text AS before, CASE WHEN contains(text, ' < ') THEN replace(text, ' < ', ' >= ') ELSE replace(text, 'true', 'false') END AS after, CASE WHEN contains(text, ' < ') THEN '< to >=' ELSE 'true to false' END AS operator, row_number() OVER (PARTITION BY file ORDER BY line, text) AS k
    FROM l WHERE NOT starts_with(text, '//') AND NOT contains(text, '"') AND line BETWEEN 100 AND 40000)
SELECT file, line, before, after, operator FROM m WHERE k <= 5
""")
def mutants(t) -> DataFrame:
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, F.lit("// a == b")).when(k == 1, F.concat(F.lit("if a < "), F.col("l_partkey").cast("string"))).when(k == 2, F.lit('say("a == b")')).otherwise(F.lit("a + true"))
    lines = t("lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), text.alias("text"))
    functions = lines.select("file").distinct().select("file", F.lit("f").alias("label"), F.lit(100).alias("start"), F.lit(40000).alias("end"))
    return evidence.mutant_rows(lines, functions).select("file", "line", "before", "after", "operator")


@query("""
WITH f AS (SELECT page_id, page_id % 3 = 0 AS s, page_id % 4 = 0 AS test, strlen(coalesce(html, '')) % 5 = 0 AS nodoc, page_id % 2 = 0 AS prose, url FROM pages)
SELECT page_id AS fact, s OR (NOT nodoc AND prose) AS is_prose, test AS is_test,
    'f' || page_id || '(x) -> y, ' || url || ' line ' || page_id || CASE WHEN test THEN ' [test]' ELSE '' END || ' [cfg ' || CASE WHEN test THEN 'test' ELSE 'unix' END || ']' ||
    CASE WHEN nodoc THEN '' ELSE chr(10) || 'prose: about' END || chr(10) || CASE WHEN prose THEN 'prose ' ELSE '' END || 'call: g' AS text FROM f
""")
def page_facts(t) -> DataFrame:
    """Pages as facts: every third a string constant, every fourth a test, most documented, with one event."""
    k = F.col("page_id")
    f = t("pages").select(
        k.alias("fact"), F.when(k % 3 == 0, "string").otherwise("function").alias("kind"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.lit("x").alias("params"), F.lit("y").alias("returns"),
        F.col("url").alias("file"), k.alias("line"), F.array(F.lit("cfg"), F.when(k % 4 == 0, "test").otherwise("unix")).alias("cfg"),
        F.when(F.octet_length(F.coalesce("html", F.lit(""))) % 5 > 0, F.lit("about\nmore")).alias("doc"), F.array(F.struct(F.lit("call").alias("kind"), (k % 2 == 0).alias("prose"), F.lit("g").alias("text"))).alias("events"),
    )
    f = f.withColumns({"is_prose": evidence.is_prose_fact(F.col("kind"), F.col("doc"), F.col("events")), "is_test": evidence.is_test_fact(F.col("cfg"), F.array().cast("array<string>"))})
    return f.select("fact", "is_prose", "is_test").join(evidence.render_fact(f), "fact")


@query("SELECT count(DISTINCT p_type) AS files, count(*) FILTER (WHERE p_size % 2 = 0) AS functions, sum(p_size) AS events, count(*) FILTER (WHERE p_size % 2 = 1) AS other_items FROM part")
def fact_totals(t) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "function").otherwise("const")
    return evidence.facts_summary(t("part").select(F.col("p_type").alias("file"), kind.alias("item_kind"), F.col("p_size").alias("n_events")))


VIEW_SQL = """
raw AS (SELECT page_id AS change, string_split('preamble' || chr(10) || 'diff --git a/x b/' || page_id || chr(10) || coalesce(html, ''), chr(10)) AS ls FROM pages),
ln AS (SELECT change, unnest(range(1, len(ls))) AS pos, unnest(ls[2:]) AS line FROM raw),
v AS (SELECT change, pos, line, starts_with(line, 'diff --git ') AS h, 0 AS in_file, 0 AS shown, 0 AS used, NULL::INT AS shown_no FROM ln WHERE pos = 0
  UNION ALL SELECT n.change, n.pos, n.line, n.h, n.in_file, n.shown + n.fits::INT, n.used + CASE WHEN n.fits AND NOT n.h THEN n.need + 1 ELSE 0 END, CASE WHEN n.fits THEN n.shown + 1 END
    FROM (SELECT ln.change, ln.pos, ln.line, starts_with(ln.line, 'diff --git ') AS h, ceil(strlen(ln.line) / 4.0)::INT AS need, v.shown, v.used,
        CASE WHEN starts_with(ln.line, 'diff --git ') THEN 0 ELSE v.in_file + 1 END AS in_file,
        CASE WHEN starts_with(ln.line, 'diff --git ') THEN v.shown < 60 ELSE v.shown < 60 AND v.in_file + 1 <= 40 AND v.used + ceil(strlen(ln.line) / 4.0) <= 2000 END AS fits
      FROM v JOIN ln ON ln.change = v.change AND ln.pos = v.pos + 1) n)
"""


def page_view(t) -> DataFrame:
    return views.number_shown_lines(page_diffs(t), most=60, per_file=40, window=4_000)


SEED_SQL = VIEW_SQL.replace("FROM ln WHERE pos = 0", "FROM (SELECT change, 0 AS pos, '' AS line FROM raw) ln")


@query(f"WITH RECURSIVE {SEED_SQL} SELECT change::VARCHAR AS change, pos, shown_no FROM v WHERE pos > 0")
def shown_lines(t) -> DataFrame:
    return page_view(t).select("change", "pos", "shown_no")


GROUP_SQL = """
c AS (SELECT page_id AS change, unnest(range(1, 10)) AS pos, strlen(coalesce(html, '')) % 97 AS base FROM pages), k AS (SELECT change, pos, (base * pos) % 500 + 100 AS cost FROM c),
g AS (SELECT change, pos, 0 AS grp, 1 AS n, 64 + cost + 8 AS used FROM k WHERE pos = 1
  UNION ALL SELECT k.change, k.pos, CASE WHEN g.n >= 4 OR g.used + k.cost + 8 > 1200 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.n >= 4 OR g.used + k.cost + 8 > 1200 THEN 1 ELSE g.n + 1 END,
    CASE WHEN g.n >= 4 OR g.used + k.cost + 8 > 1200 THEN 64 ELSE g.used END + k.cost + 8 FROM g JOIN k ON k.change = g.change AND k.pos = g.pos + 1)
"""


def page_groups(t) -> DataFrame:
    """Nine units a page in groups of at most four that fit a room."""
    base = F.octet_length(F.coalesce("html", F.lit(""))) % 97
    p = t("pages").select(F.col("page_id").cast("string").alias("change"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("pos"), base.alias("base"))
    u = p.select("change", "pos", F.concat(F.lit("d/"), F.col("pos").cast("string")).alias("label"), ((F.col("base") * F.col("pos")) % 500 + 100).cast("long").alias("cost"))
    return views.fit_groups(u, most=4, room=1200)


@query(f"WITH RECURSIVE {GROUP_SQL} SELECT change::VARCHAR AS change, pos, grp AS \"group\" FROM g")
def grouped_units(t) -> DataFrame:
    return page_groups(t).select("change", "pos", "group")


@query(f"""WITH RECURSIVE {SEED_SQL}, {GROUP_SQL}, s AS (SELECT change, count(shown_no) AS shown, count(*) AS lines, count(shown_no) < count(*) AS truncated, count(*) FILTER (WHERE shown_no IS NOT NULL AND NOT h) = 0 AS hidden FROM v WHERE pos > 0 GROUP BY change),
n AS (SELECT change, count(DISTINCT grp) AS calls FROM g GROUP BY change)
SELECT s.change::VARCHAR AS change, 'd/1,d/2,d/3,d/4,d/5,d/6,d/7,d/8,d/9' AS judged, calls, shown, lines, CASE WHEN hidden THEN s.change::VARCHAR ELSE '' END AS unexamined,
    concat_ws(',', CASE WHEN calls > 1 THEN 'split into ' || calls || ' calls' END, CASE WHEN truncated THEN 'truncated' END, CASE WHEN hidden THEN '1 files unexamined' END) AS warnings FROM s JOIN n USING (change)""")
def previewed_asks(t) -> DataFrame:
    units, view = page_groups(t), page_view(t)
    p = views.preview_asks(units, view).join(views.fit_report(units, view).select("change", F.array_join("warnings", ",").alias("warnings")), "change")
    return p.withColumns({"judged": F.array_join("judged", ","), "unexamined": F.array_join("unexamined", ",")})


@query(f"""WITH RECURSIVE {SEED_SQL}, {GROUP_SQL}, a AS (SELECT change, string_agg(lpad(shown_no::VARCHAR, 4, ' ') || '| ' || line, chr(10) ORDER BY shown_no) AS ls, count(shown_no) < count(*) AS cut FROM v WHERE pos > 0 GROUP BY change),
b AS (SELECT change, grp, string_agg('unit ' || pos, chr(10) || chr(10) ORDER BY pos) AS blocks, string_agg('d/' || pos, ' ' ORDER BY pos) AS labels FROM g GROUP BY ALL)
SELECT b.change::VARCHAR AS change, grp AS "group", md5(blocks || chr(10) || 'JUDGE: ' || labels || chr(10) || ls || CASE WHEN cut THEN chr(10) || '(truncated)' ELSE '' END) AS prompt FROM b JOIN a USING (change)""")
def composed_asks(t) -> DataFrame:
    units = page_groups(t)
    blocks = units.select("label", F.concat(F.lit("unit "), F.col("pos").cast("string")).alias("block")).distinct()
    return views.compose_asks(units, blocks, page_view(t)).select("change", "group", F.md5("prompt").alias("prompt"))


@query("""
WITH RECURSIVE f AS (SELECT source AS sha, doc_id, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS path, least(strlen(coalesce(text, '')), 20000 - 100) AS n, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 9, '0')) AS k FROM documents),
p AS (SELECT sha, path, k, n, 0 AS part, n AS used FROM f WHERE k = 1
  UNION ALL SELECT f.sha, f.path, f.k, f.n, p.part + (p.used > 0 AND p.used + f.n > 19900)::INT, CASE WHEN p.used > 0 AND p.used + f.n > 19900 THEN f.n ELSE p.used + f.n END FROM p JOIN f ON f.sha = p.sha AND f.k = p.k + 1)
SELECT sha, path, CASE WHEN part < 4 THEN part END AS part, n AS bytes FROM p
""")
def commit_parts(t) -> DataFrame:
    files = t("documents").select(F.col("source").alias("sha"), F.repeat(F.lit("m"), 100).alias("message"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    return views.split_commit(files, 20_000).select("sha", "path", "part", "bytes")


@query("""
WITH RECURSIVE l AS (SELECT o_custkey AS change, o_orderkey AS file, o_orderkey % 37 + 2 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
c AS (SELECT change, bool_or(n > 30) OR sum(n) > 40 AS cut FROM l GROUP BY change),
p AS (SELECT change, file, k, n, 0 AS part, least(n, 30) AS used, n > 30 AS full_ FROM l WHERE k = 1
  UNION ALL SELECT l.change, l.file, l.k, l.n, CASE WHEN p.part >= 3 THEN 4 WHEN full_ OR l.n > 30 OR used + l.n > 40 THEN p.part + 1 ELSE p.part END,
    CASE WHEN full_ OR l.n > 30 OR used + l.n > 40 THEN least(l.n, 30) ELSE used + l.n END, l.n > 30 FROM p JOIN l ON l.change = p.change AND l.k = p.k + 1)
SELECT change::VARCHAR AS change, file::VARCHAR AS file, CASE WHEN NOT cut THEN 0 WHEN part < 4 THEN part END AS part, n AS lines FROM p JOIN c USING (change)
""")
def change_parts(t) -> DataFrame:
    """Customers as changes, their orders as files of up to 38 lines, cut into at most four parts: 60 lines, 30 a file and
    80 tokens, that is 40 lines."""
    o = t("orders").select(F.col("o_custkey").cast("string").alias("change"), F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderkey").alias("k"))
    lines = o.select("change", "file", "k", F.explode(F.sequence(F.lit(0), F.col("k") % 37 + 1)).alias("i"))
    lines = lines.select("change", "file", (F.col("k") * 64 + F.col("i")).cast("int").alias("pos"), F.lit("+").alias("marker"), F.lit("x").alias("content"))
    return views.split_change(lines, most=60, per_file=30, window=160).groupBy("change", "file").agg(F.max("part").alias("part"), F.count("*").alias("lines"))


@query("""
SELECT source AS sha, md5('about ' || source || chr(10) || string_agg('--- f' || lpad(doc_id::VARCHAR, 9, '0') || ' ---' || chr(10) || coalesce(text, ''), chr(10) ORDER BY lpad(doc_id::VARCHAR, 9, '0'))) AS input FROM documents GROUP BY source
""")
def commit_inputs(t) -> DataFrame:
    files = t("documents").select(F.col("source").alias("sha"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("after"))
    messages = files.select("sha").distinct().select("sha", F.concat(F.lit("about "), "sha").alias("message"))
    return record.commit_input(files, messages).select("sha", F.md5("input").alias("input"))


def judge(prompt: str) -> tuple[str, int]:
    """A stand-in for a model: fails on prompts that start with an error."""
    if prompt.startswith("error"):
        raise ValueError("no answer")
    return prompt.upper(), len(prompt)


@query("""
SELECT event_id AS ask, CASE WHEN event_type <> 'error' THEN upper(event_type || ' ' || user_id) END AS answer, CASE WHEN event_type <> 'error' THEN length(event_type || ' ' || user_id) END AS tokens,
    CASE WHEN event_type = 'error' THEN 'a call failed: no answer' END AS warning, sha256('judge the units') AS prompt_print, 3.5::DOUBLE AS chars_per_token, 32000 AS window_tokens FROM events
""")
def asked_prompts(t) -> DataFrame:
    asks = t("events").select(F.col("event_id").alias("ask"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("prompt"))
    return judging.with_settings(judging.ask_all(asks, judge), prompt="judge the units", chars_per_token=3.5, window_tokens=32_000)


@query("""
WITH m AS (SELECT doc_id, source FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0)
SELECT source AS repo, count(*) AS moved, count(l.doc_id) AS with_decisions, min(m.doc_id)::VARCHAR AS least, (SELECT count(*) FROM documents d WHERE d.source = m.source) AS units FROM m LEFT JOIN labels l USING (doc_id) GROUP BY source
""")
def stale_documents(t) -> DataFrame:
    from .queries import moved_documents

    moved, d = moved_documents(t)
    anchors = d.select(F.concat_ws("::", "file", "item").alias("gist"), F.concat(F.lit("a"), "item").alias("uid"))
    edges = t("labels").select(F.lit("x.code/touches").alias("kind"), F.concat(F.lit("l"), F.col("toxic").cast("string")).alias("src"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("dst"))
    r = staleness.stale_report(moved, staleness.stale_counts(d, moved), staleness.stale_decisions(moved, anchors, edges))
    least = F.array_min(F.transform("items", lambda i: i["item"].cast("long"))).cast("string")
    return r.select("repo", F.size("items").cast("long").alias("moved"), F.size(F.filter("items", lambda i: F.size(i["decisions"]) > 0)).cast("long").alias("with_decisions"), least.alias("least"), "units")


@query("SELECT count(*) AS flags, count(*) AS numbers, md5(string_agg(event_type || ' ' || user_id, '' ORDER BY event_id)) AS texts FROM events")
def blind_flags(t) -> DataFrame:
    """All flags come back under numbers from 1, each once; the key leads from a number to its flag."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("change"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"))
    sheet, key = evaluate.blind_sheet(e, 7)
    j = sheet.join(key, "flag")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "")
    n = F.regexp_extract("flag", "^F0*([0-9]+)$", 1).cast("long")
    return j.agg(F.count("*").alias("flags"), F.max(n).alias("numbers"), F.md5(ordered).alias("texts"))


@query("SELECT o_orderkey AS id, 'q' AS question, o_orderstatus || ' [id]' AS one, o_orderpriority AS two FROM orders")
def blind_answers(t) -> DataFrame:
    """Pairs in either order, ids scrubbed; the key puts them back."""
    a = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("q").alias("question"), F.concat_ws(" ", "o_orderstatus", F.md5("o_orderstatus")).alias("first"), F.col("o_orderpriority").alias("second"))
    sheet, key = evaluate.blind_pairs(a, 3)
    swapped = F.col("a_is") == "second"
    return sheet.join(key, "id").select("id", "question", F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("one"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("two"))




@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: strlen(t) >= 3) AS ws FROM documents),
v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 3 = 0 THEN ws ELSE ws[1:len(ws) // 2] END AS ts FROM w),
f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM v) GROUP BY term)
SELECT df, count(*) AS terms, (SELECT count(*) FROM v WHERE len(ts) > 0) AS n_docs, (SELECT sum(len(ts))::BIGINT FROM v) AS n_terms FROM f GROUP BY df
""")
def kept_terms(t) -> DataFrame:
    """Frequencies kept over four batches: halves of all texts, whole texts, older versions of those, and withdrawals."""
    d = t("documents").select(F.col("doc_id").cast("string").alias("doc"), "doc_id", "text", words_of("text").alias("ws")).where("text is not null")
    half = F.slice("ws", F.lit(1), F.floor(F.size("ws") / 2).cast("int"))
    batch = lambda rows, version, words: rows.select("doc", F.lit(version).cast("long").alias("version"), words.alias("terms"))
    at, spark = scratch(d, "terms"), d.sparkSession
    thirds, none = d.where("doc_id % 3 = 0"), F.lit(None).cast("array<string>")
    for rows in (batch(d, 1, half), batch(thirds, 3, F.col("ws")), batch(thirds, 2, F.reverse("ws")), batch(d.where("doc_id % 5 = 0"), 4, none)):
        terms.update_term_stats(spark, at, rows, buckets=8)
    n = terms.kept_lengths(spark, at).first()
    return terms.kept_term_stats(spark, at).groupBy("df").agg(F.count("*").alias("terms")).select("df", "terms", F.lit(n.n_docs).alias("n_docs"), F.lit(n.n_terms).alias("n_terms"))


@query("SELECT event_id AS id, user_id AS task, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, NULL::BOOLEAN AS contradicting FROM events")
def json_rows(t) -> DataFrame:
    """Events as JSON lines, read by a schema with a field that none has and one that some lack; other fields are left."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), F.lit(1).alias("more"))
    at = scratch(e, "json")
    e.write.json(at)
    return readers.read_json_table(e.sparkSession, at, "id long, task long, kind string, contradicting boolean")

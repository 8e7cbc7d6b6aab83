"""Queries on packing, validation, shortlists and touched items. Importing this adds them to QUERIES."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, evidence, graph, judging, record, retrieval, review, staleness
from .queries import PREMISES_SQL, premises, query


@query("""
WITH b AS (SELECT p_partkey AS item, p_type AS path, md5(p_name) AS h FROM part WHERE p_partkey % 5 > 0), a AS (SELECT p_partkey AS item, p_type AS path, CASE WHEN p_size % 4 = 0 THEN md5(md5(p_name)) ELSE md5(p_name) END AS h FROM part)
SELECT a.item, a.path FROM a LEFT JOIN b ON a.item = b.item AND a.path = b.path WHERE a.h IS DISTINCT FROM b.h
""")
def touched_parts(t) -> DataFrame:
    p = t("part").select(F.lit("s").alias("sha"), F.col("p_type").alias("path"), F.col("p_partkey").alias("item"), F.md5("p_name").alias("body_hash"), "p_size")
    after = p.withColumn("body_hash", F.when(F.col("p_size") % 4 == 0, F.md5("body_hash")).otherwise(F.col("body_hash")))
    return record.touched_items(p.where("item % 5 > 0"), after).select("item", "path")


@query(f"WITH {PREMISES_SQL} SELECT src, dst FROM e WHERE src IN (SELECT 'n' || n_nationkey FROM nation) AND dst IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)")
def edges_inside(t) -> DataFrame:
    chosen = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid")).union(
        t("customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    )
    return record.inner_edges(premises(t), chosen).select("src", "dst")


@query("""
WITH g AS (SELECT o_custkey AS sha, bool_and(o_orderpriority LIKE '%1-URGENT%' OR o_orderpriority LIKE '%2-HIGH%') AS only_ FROM orders GROUP BY 1) SELECT sha FROM g WHERE only_
""")
def record_only_commits(t) -> DataFrame:
    path = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("record/x")).otherwise(F.lit("recorded/x"))
    return record.corpus_only_commits(t("orders").select(F.col("o_custkey").alias("sha"), path.alias("path")), "record")


@query("SELECT c_custkey AS sha FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0) AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id % 3 = 0)")
def commits_not_recorded(t) -> DataFrame:
    sha = lambda df, c: df.select(F.col(c).alias("sha")).distinct()
    recorded, own = sha(t("orders").where("o_orderkey % 7 = 0"), "o_custkey"), sha(t("events").where("user_id % 3 = 0"), "user_id")
    return record.not_recorded(sha(t("customer"), "c_custkey"), recorded, own)


@query("""
WITH s AS (SELECT DISTINCT p_type FROM part WHERE p_size = 1) SELECT p_partkey AS label, CASE WHEN p_size = 1 THEN 'Touched' ELSE 'Calls' END AS reason FROM part JOIN s USING (p_type)
""")
def scope_of_parts(t) -> DataFrame:
    """Parts as facts named by their type, which they call: a hop from the smallest finds all parts of their types."""
    p = t("part").select(F.col("p_partkey").alias("label"), F.col("p_type").alias("name"), "p_size")
    start = p.where("p_size = 1").select("label", F.lit("Touched").alias("reason"))
    return graph.scope_select(p.select("label", "name"), p.select("label", F.col("name").alias("callee")), start, 1)


@query("""
WITH c AS (SELECT o_custkey AS change, o_orderkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, (o_orderkey % 90 + 10) AS cost FROM orders),
p AS (SELECT *, sum(cost) OVER (PARTITION BY change ORDER BY rank) AS used FROM c) SELECT change, uid, rank FROM p WHERE used <= 400
""")
def packed_units(t) -> DataFrame:
    from pyspark.sql import Window

    c = t("orders").select(F.col("o_custkey").alias("change"), F.col("o_orderkey").alias("uid"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return retrieval.pack_prefix(c, c.select("uid", (F.col("uid") % 90 + 10).alias("cost")), 400)


@query("""
WITH o AS (SELECT o_custkey AS change, 'd/' || lpad(o_orderkey::VARCHAR, 9, '0') AS label, CASE WHEN o_orderkey % 3 = 0 THEN row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 = 0 ORDER BY o_orderkey DESC) END AS rank FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY rank IS NULL, rank, label) AS k, count(*) OVER (PARTITION BY change) AS n FROM o),
j AS (SELECT change, label, least(n, 24) AS m, k FROM k WHERE k <= 24) SELECT change, label, ((k - 1 - 5) % m + m) % m + 1 AS pos, (((k - 1 - 5) % m + m) % m) // 6 AS chunk FROM j
""")
def judging_order(t) -> DataFrame:
    """A third of each customer's orders as candidates, newest first, then all of them as packed units."""
    from pyspark.sql import Window

    label = F.concat(F.lit("d/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    units = t("orders").select(F.col("o_custkey").alias("change"), label.alias("label"), "o_orderkey")
    candidates = units.where("o_orderkey % 3 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("change").orderBy(F.desc("o_orderkey"))))
    judged = retrieval.judged_units(candidates.select("change", "label", "rank"), units.select("change", "label"))
    return retrieval.chunk_units(retrieval.rotate_units(judged, 5), 6)


@query("""
WITH h AS (SELECT l_orderkey AS change, 'd/' || l_suppkey AS label, max(l_quantity) AS score FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), a AS (SELECT DISTINCT l_orderkey AS change, 'd/' || l_suppkey AS label FROM lineitem WHERE l_linenumber >= 3),
j AS (SELECT coalesce(h.change, a.change) AS change, coalesce(h.label, a.label) AS label, h.score, a.label IS NOT NULL AS anchored FROM h FULL JOIN a ON h.change = a.change AND h.label = a.label),
b AS (SELECT *, greatest(1, coalesce(max(score) OVER (PARTITION BY change), 0)) AS best FROM j), s AS (SELECT change, label, anchored, coalesce(score, 0) + CASE WHEN anchored THEN best / 2 ELSE 0 END AS score FROM b)
SELECT change, label, anchored, round(score, 6) AS score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY change ORDER BY score DESC, label) <= 12
""")
def merged_candidates(t) -> DataFrame:
    l = t("lineitem").select(F.col("l_orderkey").alias("change"), F.concat(F.lit("d/"), F.col("l_suppkey").cast("string")).alias("label"), "l_quantity", "l_linenumber")  # noqa: E741
    hits = l.where("l_linenumber < 4").groupBy("change", "label").agg(F.max("l_quantity").alias("score"))
    return retrieval.merge_candidates(hits, l.where("l_linenumber >= 3").select("change", "label").distinct()).select("change", "label", "anchored", F.round("score", 6).alias("score"))


@query("""
WITH v AS (SELECT l_orderkey AS change, 'd/' || l_suppkey AS label, l_linenumber AS seq, l_linenumber AS line FROM lineitem), k AS (SELECT * FROM v WHERE line % 2 = 1 AND substr(label, 3)::INT % 3 > 0)
SELECT change, label, min(seq) AS seq FROM k GROUP BY ALL
""")
def valid_verdicts(t) -> DataFrame:
    v = t("lineitem").select(
        F.col("l_orderkey").alias("change"), F.concat(F.lit("[d/"), F.col("l_suppkey").cast("string"), F.lit("]")).alias("label"), F.col("l_linenumber").alias("seq"), F.lit("contradicts").alias("verdict"),
        F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("diff_line"), F.lit("").alias("reason"),
    )
    clean = v.withColumn("label", T.clean_label(F.col("label")))
    judged = clean.where("cast(substring(label, 3) as int) % 3 > 0").select("change", "label").distinct()
    view = v.where("line % 2 = 1").select("change", F.col("line").alias("shown_no"), F.lit("x").alias("content")).distinct()
    kept, _ = judging.validate_verdicts(v, judged, view)
    return kept.select("change", "label", "seq")


@query("""
WITH c AS (SELECT l_orderkey AS claim, l_suppkey AS fact, l_returnflag AS part, l_linenumber % 2 = 0 AS covered FROM lineitem), j AS (SELECT *, fact % 4 > 0 AS known FROM c),
p AS (SELECT claim, part, bool_or(covered AND known) AS ok FROM j GROUP BY ALL) SELECT claim, coalesce(string_agg(part, ',' ORDER BY part) FILTER (WHERE ok), '') AS covered, coalesce(string_agg(part, ',' ORDER BY part) FILTER (WHERE NOT ok), '') AS uncovered FROM p GROUP BY claim
""")
def valid_citations(t) -> DataFrame:
    c = t("lineitem").select(F.col("l_orderkey").alias("claim"), F.lit("r").alias("run"), F.col("l_returnflag").alias("part"), F.col("l_suppkey").alias("fact"), F.lit("S").alias("kind"), (F.col("l_linenumber") % 2 == 0).alias("covered"))
    got, _ = judging.validate_citations(c, c.where("fact % 4 > 0").select("claim", "fact"))
    return got.select("claim", F.array_join("covered", ",").alias("covered"), F.array_join("uncovered", ",").alias("uncovered"))


@query("""
WITH l AS (SELECT l_orderkey AS claim, l_suppkey AS test, min(l_linenumber) AS seq FROM lineitem GROUP BY ALL) SELECT claim, test, seq FROM l WHERE test % 3 > 0
""")
def valid_links(t) -> DataFrame:
    l = t("lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("test"), F.col("l_linenumber").alias("seq"))  # noqa: E741
    kept, _ = judging.validate_links(l, l.where("test % 3 > 0").select("claim", "test"))
    return kept.select("claim", "test", "seq")


@query("""
WITH g AS (SELECT lang AS kind, doc_id, CASE WHEN lang = 'en' THEN 'decision' ELSE 'prerequisite' END AS item, md5(text) AS id, doc_id % 6 = 0 AS blank, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents),
d AS (SELECT DISTINCT id FROM g WHERE item = 'decision'), e AS (SELECT item AS kind, id, unnest([CASE WHEN n > 1 THEN 'repeated id' END, CASE WHEN blank THEN 'blank text' END,
    CASE WHEN item <> 'decision' AND doc_id % 4 = 0 AND md5(id) NOT IN (SELECT id FROM d) THEN 'unlabelled decision' END]) AS error FROM g)
SELECT kind, error, count(*) AS n, min(id) AS first FROM e WHERE error IS NOT NULL GROUP BY ALL
""")
def gold_errors(t) -> DataFrame:
    item = F.when(F.col("lang") == "en", "decision").otherwise("prerequisite")
    of = F.when((F.col("lang") != "en") & (F.col("doc_id") % 4 == 0), F.md5(F.md5("text")))
    g = t("documents").select(F.lit("r").alias("repo"), F.lit("c").alias("commit"), item.alias("kind"), F.md5("text").alias("id"), of.alias("decision"), F.when(F.col("doc_id") % 6 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("text"))
    return evaluate.validate_gold(g).groupBy("kind", "error").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("SELECT event_type AS pass, count(*) AS flags, count(DISTINCT user_id) AS flagged, count(DISTINCT CASE WHEN event_id % 5 = 0 THEN event_id END) AS hits FROM events GROUP BY 1")
def pass_tallies(t) -> DataFrame:
    e = t("events").select(F.col("event_type").alias("pass"), F.col("user_id").alias("change"), F.col("event_id").alias("id"))
    return evaluate.pass_tally(e, e.where("id % 5 = 0").select("pass", "id"))


@query("""
WITH s AS (SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' WHEN 2 THEN 'close' ELSE 'other' END AS a, o_custkey::VARCHAR AS target, CASE WHEN o_custkey % 2 = 0 THEN 'why' END AS reason FROM orders),
u AS (SELECT *, sha256(concat_ws(chr(31), target, reason)) AS uid FROM s),
r AS (SELECT seq, unnest(CASE WHEN a = 'confirm' THEN [{'kind': 'attestation', 'target': target, 'step': 0}] WHEN a = 'reject' AND reason IS NOT NULL THEN [{'kind': 'reason', 'target': uid, 'step': 0}, {'kind': 'attestation', 'target': uid, 'step': 1}, {'kind': 'withdrawal', 'target': target, 'step': 2}]
    WHEN a = 'close' THEN [{'kind': 'note', 'target': uid, 'step': 0}, {'kind': 'attestation', 'target': uid, 'step': 1}, {'kind': 'resolution', 'target': target, 'step': 2}] ELSE [] END) AS x FROM u)
SELECT seq, x.kind AS kind, x.target AS target, x.step AS step FROM r
""")
def review_log(t) -> DataFrame:
    k = F.col("o_orderkey") % 4
    action = F.when(k == 0, "confirm").when(k == 1, "reject").when(k == 2, "close").otherwise("other")
    a = t("orders").select(F.col("o_orderkey").alias("seq"), action.alias("action"), F.col("o_custkey").cast("string").alias("target"), F.lit("edge").alias("target_kind"), F.lit("ann").alias("agent"), F.when(F.col("o_custkey") % 2 == 0, "why").alias("reason"))
    return review.apply_review(a)[0].select("seq", "kind", "target", "step")


@query("""
WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0) SELECT doc_id::VARCHAR AS item, 'l' || l.toxic AS decision FROM m JOIN labels l USING (doc_id)
""")
def stale_reasoning(t) -> DataFrame:
    from .queries import moved_documents

    moved, d = moved_documents(t)
    anchors = d.select(F.concat_ws("::", "file", "item").alias("gist"), F.concat(F.lit("a"), "item").alias("uid"))
    edges = t("labels").select(F.lit("x.code/touches").alias("kind"), F.concat(F.lit("l"), F.col("toxic").cast("string")).alias("src"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("dst"))
    return staleness.stale_decisions(moved, anchors, edges).select("item", F.explode("decisions").alias("decision"))


@query("""
SELECT l_partkey AS test, ['equal sides'] = list(DISTINCT 'equal sides') AS vacuous FROM lineitem WHERE l_quantity = l_linenumber GROUP BY 1
""")
def tests_that_assert_nothing(t) -> DataFrame:
    args = F.format_string("f(%d, %d), f(%d, 0)", F.col("l_quantity").cast("int"), F.lit(0), F.col("l_linenumber"))
    ev = t("lineitem").select(F.col("l_partkey").alias("test"), F.lit("assert_eq").alias("macro"), args.alias("args"))
    return evidence.vacuous_tests(ev).select("test", (F.array_join("reasons", ",") == "equal sides").alias("vacuous"))

"""Queries over the topic hierarchy and the argumentation, annotation and interpretation layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans import hierarchy, layers
from lodestone.queries import query
from lodestone.sources.files import table


def _hierarchy(spark, d) -> hierarchy.Hierarchy:
    """Parts as papers, nations below 9 as topics, two memberships a part by its size; topics 9 and 10 have no node."""
    size, key = F.col("p_size"), F.col("p_partkey")
    part = table(spark, d, "part")
    id_ = F.concat(F.lit("p"), "p_partkey").alias("paper_id")
    articles = part.select(id_, F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year"), size.cast("long").alias("claim_count"), F.when(size <= 1, "not_applicable").alias("article_type"), F.array("p_brand", "p_type").alias("theories"), F.array("p_type").alias("sensors"), F.array().cast("array<string>").alias("fronts"), key.alias("ordinal"))
    topic = lambda n: F.concat(F.lit("t"), size % n).alias("topic_id")
    some = part.where("p_partkey % 10 <> 0")
    one = some.select(id_, topic(7), F.lit("primary").alias("role"), F.lit(0.9).alias("confidence"))
    two = some.where("p_size % 7 <> p_size % 11").select(id_, topic(11), F.lit("secondary").alias("role"), F.lit(0.5).alias("confidence"))
    hidden = part.where("p_partkey % 20 = 0").select(id_, F.lit("hidden").alias("reason"), F.lit(True).alias("missing_iv"), F.lit(True).alias("missing_dv"))
    k = F.col("n_nationkey")
    named = lambda prefix, n: F.concat(F.lit(prefix), k % n)
    nodes = table(spark, d, "nation").where(k < 9).select(
        F.concat(F.lit("t"), k).alias("id"), F.col("n_name").alias("label"), named("r", 2).alias("iv_root"), named("Root ", 2).alias("iv_root_label"), named("r.n", 4).alias("iv_node"), named("Node ", 4).alias("iv_label"),
        F.lit("o").alias("dv_root"), F.lit("O").alias("dv_root_label"), named("o.", 3).alias("dv_focus"), named("Focus ", 3).alias("dv_focus_label"),
    )
    return hierarchy.canonical(articles, one.union(two), hidden, nodes, "red")


_MEMBERS = """placed AS (SELECT *, 'p' || p_partkey AS paper_id FROM part WHERE p_partkey % 10 <> 0),
m AS (SELECT *, p_size % 7 AS t, 0 AS second FROM placed UNION ALL SELECT *, p_size % 11, 1 FROM placed WHERE p_size % 7 <> p_size % 11),
k AS (SELECT m.*, n_name FROM m JOIN nation ON t = n_nationkey WHERE t < 9)"""


@query(f"""WITH {_MEMBERS}, s AS (SELECT t, p_partkey, 0 AS b, p_brand AS name FROM k UNION ALL SELECT t, p_partkey, 1, p_type FROM k),
c AS (SELECT t, name, count(*) AS n, min(p_partkey * 2 + b) AS first FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, first) AS rank FROM c),
v AS (SELECT t, paper_id, row_number() OVER (PARTITION BY t ORDER BY second, p_size DESC, paper_id) AS rank FROM k)
SELECT 't' || t AS id, n_name AS label, count(*) AS paper_count, (SELECT string_agg(name, '|' ORDER BY rank) FROM r WHERE r.t = k.t AND rank <= 6) AS theories,
(SELECT string_agg(paper_id, '|' ORDER BY rank) FROM v WHERE v.t = k.t AND rank <= 14) AS preview FROM k GROUP BY t, n_name""")
def q121_topic_hierarchy(spark, d):
    t = _hierarchy(spark, d).topics
    return t.select("id", "label", "paper_count", F.array_join("theories", "|").alias("theories"), F.array_join(F.transform("paper_preview", lambda x: x["paper_id"]), "|").alias("preview"))


@query(f"""WITH {_MEMBERS} SELECT 'r' || t % 2 AS iv_root, 'r.n' || t % 4 AS iv_node, count(DISTINCT paper_id) AS paper_count, count(DISTINCT t) AS topic_count FROM k GROUP BY 1, 2""")
def q122_topic_branches(spark, d):
    return _hierarchy(spark, d).children.select("iv_root", "iv_node", "paper_count", "topic_count")


@query(f"""WITH {_MEMBERS}, lost AS (SELECT paper_id, 'membership references missing topic node t' || t AS reason FROM m WHERE t >= 9),
w AS (SELECT 'p' || p_partkey AS paper_id, p_partkey % 20 = 0 AS h, contains(lower(p_name), 'red') OR p_size <= 1 AS gone FROM part WHERE p_partkey % 10 = 0)
SELECT paper_id, reason, 'repair' AS state FROM lost UNION ALL
SELECT paper_id, CASE WHEN h THEN 'hidden' ELSE 'no visible canonical topic membership' END, CASE WHEN h AND gone THEN 'excluded' ELSE 'repair' END FROM w""")
def q123_topic_queues(spark, d):
    h = _hierarchy(spark, d)
    return h.repair.select("paper_id", "reason", F.lit("repair").alias("state")).union(h.excluded.select("paper_id", "reason", F.lit("excluded").alias("state")))


def _claims(spark, d):
    """Turns as claims; each turn answers the one before, and every third asks for a search."""
    c = table(spark, d, "conversations")
    belief = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    turn = F.col("turn")
    claims = c.select(belief(turn).alias("belief_id"), F.col("conv_id").cast("string").alias("paper_id"), F.col("role").alias("content_preview"), (turn % 3).alias("incoming_support_count"), F.when(turn % 5 == 1, 1).alias("incoming_attack_count"), F.lit(None).cast("int").alias("contradiction_count"), F.lit(None).cast("string").alias("warrant_status"))
    edges = c.where("turn > 0").select(belief(turn).alias("source"), belief(turn - 1).alias("target"), F.when(turn % 2 == 0, "attack").otherwise("support").alias("relation"), F.lit("s").alias("scheme_hint"), F.lit(0.5).alias("strength"), turn.alias("ordinal"))
    targets = c.where("turn % 3 = 0").select(belief(turn).alias("belief_id"), F.col("conv_id").cast("string").alias("paper_id"), F.concat(F.lit("why  "), turn).alias("resolution_question"), F.lit("soon").alias("review_urgency"), F.array(F.lit("h")).alias("attack_scheme_hints"), turn.alias("ordinal"))
    return claims, edges, targets


@query("""SELECT c.conv_id || '-' || c.turn AS belief_id, CAST(c.turn % 3 AS BIGINT) AS supports, CAST(CASE WHEN c.turn % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS attacks,
CASE WHEN c.turn % 3 = 0 THEN 'why ' || c.turn ELSE '' END AS question, CASE WHEN n.turn % 2 = 0 THEN n.conv_id || '-' || n.turn END AS attacked_by, CASE WHEN n.turn % 2 = 1 THEN n.role END AS supported_by
FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def q124_claim_nodes(spark, d):
    out = layers.claim_nodes(*_claims(spark, d))
    return out.select("belief_id", F.col("incoming_support_count").alias("supports"), F.col("incoming_attack_count").alias("attacks"), F.col("resolution_question").alias("question"), F.get("top_attacks", F.lit(0))["source"].alias("attacked_by"), F.get("top_supports", F.lit(0))["source_preview"].alias("supported_by"))


@query("""SELECT conv_id::VARCHAR AS paper_id, count(*) AS claim_count, CAST(count_if(turn % 3 = 0) AS BIGINT) AS search_target_count FROM conversations GROUP BY 1""")
def q125_paper_nodes(spark, d):
    claims, _, targets = _claims(spark, d)
    papers = claims.groupBy("paper_id").agg(F.count("*").alias("claim_count")).select("paper_id", F.lit(None).cast("string").alias("belief_id"), F.lit("x").alias("content_preview"), F.lit(0).alias("contradiction_count"), "claim_count", F.lit("").alias("dominant_stance"), F.array().cast("array<string>").alias("theories"))
    return layers.paper_nodes(papers, targets).select("paper_id", "claim_count", "search_target_count")


def _annotations(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("type"), F.lit("paper").alias("target_type"), F.col("conv_id").cast("string").alias("target_id"), F.col("text").alias("content"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("status"))


@query("""SELECT role AS type, count(*) AS "count" FROM conversations GROUP BY 1""")
def q126_annotation_types(spark, d):
    return layers.annotations(_annotations(spark, d))[0]


@query(r"""SELECT conv_id || '-' || turn AS id, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(substr(c, 1, 219)) || '…' END AS content, '' AS status
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM conversations)""")
def q127_annotations(spark, d):
    return layers.annotations(_annotations(spark, d))[1].select("id", "content", "status")


def _frontier(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ")
    return o.select(key.alias("frontier_id"), key.alias("belief_id"), name.alias("resolved_framework_name"), F.lit(None).cast("string").alias("resolved_framework_id"), F.col("o_totalprice").alias("voi_score"), F.when(F.col("o_totalprice") > 300000, "high").otherwise("low").alias("voi_bucket"), F.col("o_orderstatus").alias("zone"), F.array(*map(F.lit, "abcd")).alias("questions"), F.when(F.col("o_custkey") % 2 == 0, F.array(key)).alias("matching_paper_ids"))


@query("""SELECT o_orderkey::VARCHAR AS frontier_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderkey::VARCHAR END AS framework_name, o_totalprice AS voi_score, 'a,b,c' AS questions, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS papers
FROM orders ORDER BY o_totalprice DESC, 2, 1 LIMIT 20""")
def q128_frontier_questions(spark, d):
    return layers.frontier_questions(_frontier(spark, d)).select("frontier_id", "framework_name", "voi_score", F.array_join("question_set", ",").alias("questions"), F.col("matching_paper_count").alias("papers"))


@query("""SELECT s_suppkey::VARCHAR AS belief_id, s_nationkey AS challenging_evidence_count FROM supplier ORDER BY s_nationkey DESC, s_acctbal, 1 LIMIT 20""")
def q129_validation_beliefs(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("belief_id"), F.col("s_acctbal").alias("validation_completeness"), F.lit("r").alias("replication_status"), F.lit(1).alias("supporting_evidence_count"), F.col("s_nationkey").alias("challenging_evidence_count"), F.lit(True).alias("scope_specified"))
    return layers.validation_beliefs(rows).select("belief_id", "challenging_evidence_count")


@query("""SELECT 'argumentation' AS id, (SELECT count(*) FROM conversations WHERE turn > 0) AS primary_metric UNION ALL SELECT 'annotations', count(*) FROM conversations
UNION ALL SELECT 'interpretation', CAST(count_if(o_totalprice > 300000) AS BIGINT) FROM orders""")
def q130_layers(spark, d):
    return layers.layers(_claims(spark, d)[1], _annotations(spark, d), _frontier(spark, d)).select("id", "primary_metric")


@query("""SELECT (SELECT count(*) FROM documents) AS article_count, (SELECT count(*) FROM benchmark) AS evidence_count, CAST(least(6, (SELECT count(*) FROM benchmark)) AS BIGINT) AS evaluated, CAST(15 AS BIGINT) AS target""")
def q131_dashboard(spark, d):
    return layers.dashboard(table(spark, d, "documents"), table(spark, d, "benchmark"))

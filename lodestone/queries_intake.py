"""Queries of article intake, title matches, documents, shared samples and assignment, each with DuckDB SQL that states it row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as agg
from lodestone.operators import dedup, graphs
from lodestone.plans import classes, hierarchy, submissions
from lodestone.queries import query
from lodestone.queries_layers import _MEMBERS, _hierarchy
from lodestone.scratch import scratch
from lodestone.sources.files import table


def _plain_words(c: str) -> str:
    """DuckDB: the text with punctuation as spaces, collapsed."""
    out = rf"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')"
    return f"trim({out})"


#: DuckDB: whether the titles t and u, of the word lists a and b, match: one inside the other, or one word apart from three words on.
_MATCH = """(contains(t, u) OR contains(u, t) OR (len(a) >= 3 AND len(b) >= 3 AND abs(len(a) - len(b)) <= 1
  AND coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda k: a[k] = b[k]), false) - 1, least(len(a), len(b)))
    + coalesce(list_position(list_transform(range(0, least(len(a), len(b))), lambda k: a[len(a) - k] = b[len(b) - k]), false) - 1, least(len(a), len(b)))
    >= CASE WHEN len(a) = len(b) THEN len(a) - 1 ELSE least(len(a), len(b)) END))"""


@query(rf"""WITH n AS (SELECT p_partkey AS place, md5(p_name || p_brand || CAST(p_size AS VARCHAR)) AS hash, '10.5/' || p_brand || '/' || CAST(p_size AS VARCHAR) || p_type AS doi,
  p_size % 10 = 0 AS bad, {_plain_words("p_type || ' ' || p_name || ' of ' || p_brand")} AS title FROM part),
t AS (SELECT title AS t, string_split(title, ' ') AS a, min(place) FILTER (WHERE NOT bad) AS lo FROM n GROUP BY title),
near AS (SELECT x.t AS title, min(y.lo) AS lo FROM t x JOIN (SELECT t AS u, a AS b, lo FROM t) y ON {_MATCH} GROUP BY x.t),
first AS (SELECT n.*, (SELECT min(m.place) FROM n m WHERE m.hash = n.hash) AS h, (SELECT min(m.place) FROM n m WHERE m.doi = n.doi AND NOT m.bad) AS d, near.lo AS l FROM n JOIN near USING (title)),
hit AS (SELECT place, bad, CASE WHEN h < place THEN h WHEN d < place THEN d WHEN l < place THEN l END AS match,
  CASE WHEN h < place THEN 'exact_hash' WHEN d < place THEN 'exact_doi' WHEN l < place THEN 'title_fuzzy_1word' END AS kind FROM first),
id AS (SELECT place, 'ART-' || repeat('0', CAST(greatest(0, 4 - length(CAST(row_number() OVER (ORDER BY place) AS VARCHAR))) AS INT)) || CAST(row_number() OVER (ORDER BY place) AS VARCHAR) AS article_id FROM n)
SELECT id.article_id, CASE WHEN bad THEN 'rejected' WHEN match IS NULL THEN 'staged' ELSE 'duplicate' END AS status, CASE WHEN NOT bad THEN other.article_id END AS match_id, CASE WHEN NOT bad THEN kind END AS match_type
FROM hit JOIN id USING (place) LEFT JOIN id other ON other.place = hit.match""")
def q132_staged(spark, d):
    """Parts handed in one after the other: each against all before it."""
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    title = F.concat_ws(" ", "p_type", "p_name", F.lit("of"), "p_brand")
    fields = {"pdf_hash": F.md5(F.concat("p_name", "p_brand", size)), "doi": F.concat(F.lit("10.5/"), "p_brand", F.lit("/"), size, "p_type"), "title": title}
    new = p.select(F.col("p_partkey").alias("ordinal"), *(c.alias(k) for k, c in fields.items()), (F.col("p_size") % 10 != 0).alias("pdf_valid"), F.lit(None).cast("string").alias("authors"), F.lit("").alias("abstract"))
    known = spark.createDataFrame([], "article_id string, pdf_hash string, doi string, title string, authors string")
    return submissions.staged(new, known).select("article_id", "status", "match_id", "match_type")


@query(rf"""WITH k AS (SELECT t, min(id) AS lo, string_split(t, ' ') AS a FROM (SELECT s_suppkey AS id, {_plain_words("s_name")} AS t FROM supplier) GROUP BY t),
n AS (SELECT c_custkey, {_plain_words("'Supplier ' || substr(c_name, length('Customer#') + 1) || CASE WHEN c_mktsegment < 'C' THEN '' ELSE ' of ' || c_mktsegment END")} AS u FROM customer),
x AS (SELECT c_custkey, lo FROM (SELECT DISTINCT c_custkey, u, string_split(u, ' ') AS b FROM n) n JOIN k ON {_MATCH})
SELECT c_custkey AS article_id, min(lo) AS match_id, 'title_fuzzy_1word' AS match_type FROM x GROUP BY c_custkey""")
def q133_titles_inside(spark, d):
    """The cascade's title tier: names of customers against those that suppliers hold, at any place."""
    name = F.concat(F.lit("Supplier "), F.expr("substr(c_name, length('Customer#') + 1)"), F.when(F.col("c_mktsegment") < "C", "").otherwise(F.concat(F.lit(" of "), "c_mktsegment")))
    none = [F.lit(None).cast("string").alias(c) for c in ("pdf_hash", "doi", "authors")]
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"), name.alias("title"), *none)
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("article_id"), F.col("s_name").alias("title"), *none)
    return dedup.duplicate_cascade(new, known).select("article_id", "match_id", "match_type")


@query(f"""WITH {_MEMBERS}, t AS (SELECT 't' || t AS id, 'r' || t % 2 AS root, 'r.n' || t % 4 AS node, n_name AS label, count(*) AS n FROM k GROUP BY t, n_name),
c AS (SELECT 'r' || t % 2 AS root, 'r.n' || t % 4 AS node, count(DISTINCT paper_id) AS n FROM k GROUP BY 1, 2), r AS (SELECT 'r' || t % 2 AS root, count(DISTINCT paper_id) AS n FROM k GROUP BY 1)
SELECT r.root, r.n AS root_papers, c.node, c.n AS node_papers, t.id, t.n AS paper_count, row_number() OVER (ORDER BY r.n DESC, r.root, c.n DESC, c.node, t.n DESC, t.label) AS place
FROM t JOIN c USING (root, node) JOIN r USING (root)""")
def q134_hierarchy_document(spark, d):
    """The nested topic document, written by many tasks and read back: its leaves in their order."""
    at = scratch(spark, "document") + ".json"
    hierarchy.write_hierarchy(_hierarchy(spark, d), at)
    schema = "roots array<struct<id: string, paper_count: long, children: array<struct<id: string, paper_count: long, topics: array<struct<id: string, paper_count: long>>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(at)
    roots = doc.select(F.posexplode("roots").alias("i", "r"))
    nodes = roots.select("i", "r", F.posexplode("r.children").alias("j", "c"))
    leaves = nodes.select("i", "j", "r", "c", F.posexplode("c.topics").alias("k", "t"))
    from lodestone.operators.ordering import numbered

    out = numbered(leaves, "place", F.col("i"), F.col("j"), F.col("k"))
    return out.select(F.col("r.id").alias("root"), F.col("r.paper_count").alias("root_papers"), F.col("c.id").alias("node"), F.col("c.paper_count").alias("node_papers"), F.col("t.id").alias("id"), F.col("t.paper_count").alias("paper_count"), "place")


@query("""WITH RECURSIVE p AS (SELECT l_suppkey AS claim, l_partkey AS paper, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part WHERE p_size % 4 = 0),
x AS (SELECT p.claim, e.a, e.b FROM e JOIN p ON p.paper = e.a JOIN p q ON q.paper = e.b AND q.claim = p.claim), both_ways AS (SELECT claim, a, b FROM x UNION SELECT claim, b, a FROM x),
reach AS (SELECT claim, paper AS a, paper AS b FROM p UNION SELECT r.claim, r.a, w.b FROM reach r JOIN both_ways w ON w.claim = r.claim AND w.a = r.b),
root AS (SELECT claim, a AS paper, min(b) AS root FROM reach GROUP BY 1, 2), s AS (SELECT claim, root, max(n) AS once, sum(n) AS n, count(*) AS papers FROM p JOIN root USING (claim, paper) GROUP BY 1, 2)
SELECT claim, CAST(sum(papers) AS BIGINT) AS papers, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(once) AS BIGINT) AS n_unique, max(papers) > 1 AS overlap FROM s GROUP BY claim""")
def q135_unique_samples(spark, d):
    """Suppliers as claims, their parts as papers; parts near each other share a sample."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("claim"), F.col("l_partkey").alias("paper"), F.col("l_quantity").cast("long").alias("n"))
    edges = table(spark, d, "part").where("p_size % 4 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("b"))
    return agg.unique_samples(li, edges, "claim", "paper", "n")


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey % 1000 AS b FROM orders WHERE o_totalprice < 60000), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM w UNION SELECT r.node, w.b FROM reach r JOIN w ON w.a = r.other) SELECT node, min(other) AS root FROM reach GROUP BY node""")
def q136_components(spark, d):
    """Customers and order numbers that cheap orders join."""
    cheap = table(spark, d, "orders").where("o_totalprice < 60000")
    return graphs.components(cheap.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b")))


@query("""WITH q AS (SELECT p_brand AS question_id FROM part GROUP BY 1), c AS (SELECT DISTINCT p_brand AS question_id, p_size % 9 + 1 AS round FROM part WHERE p_size > 12),
need AS (SELECT question_id, coalesce(sum(p_size), 0) AS total FROM q LEFT JOIN (SELECT p_brand AS question_id, p_size FROM part WHERE p_size > 12 AND p_partkey % 3 <> 0) USING (question_id) GROUP BY 1),
free AS (SELECT n.question_id, r.round, row_number() OVER (ORDER BY r.round, n.total, n.question_id) AS k FROM need n, (SELECT unnest(range(1, 100)) AS round) r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.question_id = n.question_id AND c.round = r.round)),
u AS (SELECT c_custkey AS user_id, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS k FROM customer), least AS (SELECT question_id FROM need ORDER BY total, question_id LIMIT 1)
SELECT user_id, coalesce(free.question_id, least.question_id) AS question_id, CAST(coalesce(free.round, 2) AS BIGINT) AS round FROM u LEFT JOIN free USING (k), least""")
def q137_assigned_all(spark, d):
    """Brands as questions, parts as earlier claims; every customer is given one, by balance."""
    part, users = table(spark, d, "part"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    released = F.when(F.col("p_partkey") % 3 == 0, "x")
    claims = part.where("p_size > 12").select(F.col("p_brand").alias("question_id"), F.col("p_partkey").alias("user_id"), (F.col("p_size") % 9 + 1).alias("round"), released.alias("released_at"), F.col("p_size").alias("task1_count"), F.lit(0).alias("task2_count"))
    return classes.assigned_all(part.select(F.col("p_brand").alias("question_id")).distinct(), claims, users, "c_acctbal")

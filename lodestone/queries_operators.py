"""Further queries of the driver: operators that the headline queries leave out, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import lodestone.queries_intake  # noqa: F401 - registers its queries
import lodestone.queries_layers  # noqa: F401 - registers its queries
import lodestone.queries_texts  # noqa: F401 - registers its queries
from lodestone.functions import citations, collections, rules, taxonomy, text
from lodestone.functions.matching import authors_match, titles_match
from lodestone.operators import aggregates as agg
from lodestone.operators import dedup, filters, joins, ordering, sets
from lodestone.plans import arguments, classes, sync, topics
from lodestone.queries import query
from lodestone.scratch import scratch
from lodestone.sources import files, sinks
from lodestone.sources.files import table
from lodestone.sources.papers import write_papers


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q61_json_lines(spark, d):
    """A payload written as JSON lines and read back, bad lines dropped."""
    at = scratch(spark, "json")
    sinks.json_payload(table(spark, d, "nation"), at)
    spark.createDataFrame([("not json",), ("{",)], "value string").write.mode("append").text(at)
    return files.json_lines(spark, at, "n_nationkey int, n_name string, n_regionkey int").where("n_nationkey is not null")


@query("SELECT r_regionkey, r_name FROM region")
def q62_json_document(spark, d):
    """A whole-file JSON array; the first path that exists is read."""
    at = scratch(spark, "document")
    one = table(spark, d, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    one.write.text(at)
    return files.first_available(spark, [at + "-absent", at], "r_regionkey int, r_name string")


@query("SELECT 's' || s_suppkey AS paper_id, s_name FROM supplier")
def q63_per_paper(spark, d):
    """JSON documents below nested folders, keyed by their content."""
    at = scratch(spark, "papers")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("paper_id"), "s_name", (F.col("s_suppkey") % 3).alias("folder"))
    write_papers(rows, at, "folder")
    return files.per_paper(spark, f"{at}/*.json", "paper_id string, s_name string", recursive=True)


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def q64_roster_csv(spark, d):
    """A CSV with fixed fields in order, read by header aliases."""
    at = scratch(spark, "roster")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias(" ID "), F.col("c_name").alias("Full Name"), F.col("c_mktsegment").alias("Group"))
    sinks.crlf_csv(rows, at)
    out = files.roster_csv(spark, at, {"id": ("id",), "name": ("full name",), "segment": ("group", "segment")}, ("id", "name"))
    return out.withColumn("id", F.col("id").cast("long"))


@query("SELECT page_id, length(html) AS size FROM pages")
def q65_containers(spark, d):
    """Items of the first container that is there: an array, or the values of a map."""
    p = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("size"))
    item = F.struct("page_id", "size")
    none = F.lit(None)
    odd = F.col("page_id") % 2 == 1
    rows = p.select(F.when(odd, F.array(item)).otherwise(none).alias("rows"), F.when(~odd, F.create_map(F.lit("k"), item)).otherwise(none).alias("by_key"))
    return files.items(rows, "rows", "by_key")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 0, 'added' """)
def q66_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("changed")).union(spark.createDataFrame([(0, "added")], "k long, s string"))
    return sinks.upserted(c, changes, ["c_custkey"])


@query("""SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'new' """)
def q67_ensured(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return sinks.ensured(r, spark.createDataFrame([(0, "stays"), (99, "new"), (99, "new")], "r_regionkey int, r_name string"), ["r_regionkey"])


@query("""SELECT c_custkey, 'c' || c_custkey || ',' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) END AS line FROM customer""")
def q68_roster_lines(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("who"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("grade"))
    return rows.select("c_custkey", sinks.roster_line(["who", "grade"], "grade").alias("line"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 3""")
def q69_optional_filters(spark, d):
    rows = table(spark, d, "orders").withColumn("m", F.col("o_custkey") % 7)
    return filters.optional(rows, o_orderstatus="F", m=3, o_orderpriority=None).select("o_orderkey")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'visible' ELSE 'hidden' END AS visibility, CASE WHEN quality = 1 THEN '' ELSE 'low quality' END AS hide_reason, quality = 1 AS defended FROM labels""")
def q70_visibility(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality", F.lit("visible").alias("visibility"), F.lit("").alias("hide_reason"))
    out = filters.hidden_unless(rows, F.col("quality") == 1, "low quality")
    return out.select("doc_id", "visibility", "hide_reason", filters.defended(F.col("quality").cast("double")).alias("defended"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7)""")
def q71_focus(spark, d):
    return filters.focused(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") == 7).select("o_orderkey")


@query("""SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def q72_lookup_defaults(spark, d):
    return joins.lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], {"quality": -1})


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def q73_first_per_key(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return joins.first_per_key(rows, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def q74_best_confidence(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.best_confidence(rows, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)""")
def q75_missing_pairs(spark, d):
    r = table(spark, d, "region").select("r_regionkey")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    have = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return joins.missing_pairs(r, n, ["r_regionkey"], have, ["n_nationkey"]).select("r_regionkey", "n_nationkey")


@query("""SELECT l_orderkey, l_linenumber, p_name AS source_p_name, CAST(NULL AS VARCHAR) AS target_p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def q76_endpoints(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"), (-1 - F.col("l_suppkey")).alias("target"))
    return joins.endpoints(e, table(spark, d, "part"), "p_partkey", ["p_name"]).select("l_orderkey", "l_linenumber", "source_p_name", "target_p_name")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'P' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'Q' || s_suppkey END AS paper FROM supplier""")
def q77_paper_of(spark, d):
    k = F.col("s_suppkey")
    belief = F.when(k % 3 == 0, F.concat(F.lit("P"), k, F.lit("_MPX_001"))).when(k % 3 == 1, F.concat(F.lit("bel_Q"), k, F.lit("_V5_001"))).otherwise(F.lit("odd"))
    return table(spark, d, "supplier").select("s_suppkey", joins.paper_of(belief).alias("paper"))


@query("""SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q78_by_name(spark, d):
    """A join on names without regard to case, and a single-value lookup."""
    n = table(spark, d, "nation")
    s = joins.single_value(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), n.select("n_nationkey", "n_name"), ["n_nationkey"], "n_name")
    return joins.by_name(s.select("s_suppkey", F.lower("n_name").alias("name")), n.select(F.upper("n_name").alias("other"), "n_regionkey"), "name", "other").select("s_suppkey", "n_regionkey")


@query("""WITH q AS (SELECT DISTINCT r_regionkey AS q, unnest(['k' || r_regionkey, 'k' || (r_regionkey + 1)]) AS k FROM region), p AS (SELECT DISTINCT s_suppkey AS p, unnest(['k' || s_suppkey % 9, 'k' || s_suppkey % 4]) AS k FROM supplier),
h AS (SELECT DISTINCT p, q FROM q JOIN p USING (k)) SELECT p, count(*) AS n_references, array_to_string(list_sort(list(q)), ',') AS questions FROM h GROUP BY 1""")
def q79_keyword_matches(spark, d):
    k = lambda c: F.concat(F.lit("k"), c.cast("string"))
    q = table(spark, d, "region").select(F.col("r_regionkey").alias("q"), F.array(k(F.col("r_regionkey")), k(F.col("r_regionkey") + 1)).alias("keywords"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p"), F.array(k(F.col("s_suppkey") % 9), k(F.col("s_suppkey") % 4)).alias("keywords"))
    return joins.keyword_matches(q, p, "q", "p").select("p", "n_references", F.array_join(F.transform("question_ids", lambda x: x.cast("string")), ",").alias("questions"))


@query("""SELECT CAST(count(*) AS BIGINT) AS total, count_if(o_orderstatus = 'F') AS "o_orderstatus_F", count_if(o_orderstatus = 'O') AS "o_orderstatus_O", count_if(o_orderpriority = '1-URGENT') AS "o_orderpriority_1-URGENT" FROM orders""")
def q80_tally(spark, d):
    return agg.tally(table(spark, d, "orders"), {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT",)})


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END)::BIGINT AS "F", sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END)::BIGINT AS "O" FROM lineitem GROUP BY 1""")
def q81_pivot(spark, d):
    return agg.pivoted(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.col("l_quantity").cast("long"))


@query("""WITH e AS (SELECT event_id, unnest(list_distinct(['p' || user_id, 'p' || (user_id + 1)])) AS paper_id, event_type AS s, 't' || event_id % 5 AS t FROM events)
SELECT paper_id, count(*) AS n_edges, array_to_string(list_sort(list_distinct(flatten(list([s, t])))), ',') AS nodes FROM e GROUP BY 1""")
def q82_edges_by_paper(spark, d):
    u = F.col("user_id")
    papers = F.to_json(F.array(F.concat(F.lit("p"), u), F.concat(F.lit("p"), u + 1)))
    e = table(spark, d, "events").select(papers.alias("papers"), F.col("event_type").alias("source"), F.concat(F.lit("t"), F.col("event_id") % 5).alias("target"))
    return agg.edges_by_paper(e, "papers").withColumn("nodes", F.array_join("nodes", ","))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest([event_type, 'u' || user_id % 4]) AS tag FROM events) GROUP BY 1""")
def q83_tag_counts(spark, d):
    tags = F.to_json(F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 4)))
    return agg.tag_counts(table(spark, d, "events").select(tags.alias("tags")), "tags")


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN n = 0 THEN 'missing' WHEN n < 300 THEN 'stub' WHEN n < 600 THEN 'brief' ELSE 'full' END AS band FROM (SELECT len(string_split(text, ' ')) AS n FROM documents)) GROUP BY 1""")
def q84_word_bands(spark, d):
    return table(spark, d, "documents").select(rules.word_band(F.size(F.split("text", " "))).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, CAST(sum(CASE WHEN s = 'PASS' THEN w WHEN s = 'WARN' THEN w / 2 ELSE 0 END) AS DOUBLE) AS points FROM (
SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'WARN' ELSE 'FAIL' END AS s, CAST(1 + o_orderkey % 4 AS DOUBLE) AS w FROM orders) GROUP BY 1""")
def q85_points(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "WARN").otherwise("FAIL")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(agg.points(s, (1 + F.col("o_orderkey") % 4).cast("double")).alias("points"))


@query("""SELECT share, CASE WHEN share >= 0.95 THEN 'complete' WHEN share >= 0.8 THEN 'mostly' WHEN share >= 0.5 THEN 'partial' ELSE 'sparse' END AS band FROM (
SELECT round(avg(CASE WHEN text <> '' AND quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS share FROM documents LEFT JOIN labels USING (doc_id))""")
def q86_completeness(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return agg.completeness(j, ["text", "quality"]).withColumn("share", F.round("share", 9))


@query("""SELECT p_brand, least(20.0, max(x) + least(4.0, count_if(x > 12))) AS best FROM (SELECT p_brand, p_size % 18 * 1.0 AS x FROM part) GROUP BY 1""")
def q87_best_of(spark, d):
    x = (F.col("p_size") % 18).cast("double")
    return table(spark, d, "part").groupBy("p_brand").agg(agg.best_of(x, x > 12).alias("best"))


@query("""SELECT count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders""")
def q88_set_sizes(spark, d):
    return agg.set_sizes(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


@query("""SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS "F", sum(CASE WHEN o_orderstatus = 'P' THEN 1 END)::BIGINT AS "P" FROM orders GROUP BY 1""")
def q89_grouped_tallies(spark, d):
    return agg.pivoted(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "P"], F.lit(1))


@query("""SELECT key, round(avg(value), 6) AS mean, count(value) AS n FROM (SELECT event_type AS key, value FROM events UNION ALL SELECT 'all', value FROM events) GROUP BY 1""")
def q90_mean_by_key(spark, d):
    tags = F.create_map(F.col("event_type"), F.col("value"), F.lit("all"), F.col("value"))
    return agg.mean_by_key(table(spark, d, "events").select(tags.alias("tags")), "tags").withColumn("mean", F.round("mean", 6))


@query("""WITH a AS (SELECT doc_id::VARCHAR AS path, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'only_right' WHEN b.path IS NULL THEN 'only_left' WHEN a.text = b.text THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def q91_compared_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    b = docs.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return agg.compared_files(docs.where("doc_id % 3 <> 0"), b.where("doc_id % 4 <> 0"))


@query("""SELECT c_mktsegment, round(sum(coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_acctbal END, 0), 1)), 2) AS total FROM customer GROUP BY 1 ORDER BY total DESC, c_mktsegment LIMIT 5""")
def q92_page_briefing(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("a"), F.lit(1.0).alias("b"))
    return agg.page_briefing(rows, "c_mktsegment", ("a", "b")).withColumn("total", F.round("total", 2))


@query("""SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def q93_exploded_counts(spark, d):
    return agg.exploded_counts(table(spark, d, "part").select(F.split("p_type", " ").alias("words")), "words", 5)


@query("""WITH x AS (SELECT c_mktsegment AS g, 1 + c_custkey % 5 AS se, c_acctbal / 1000 AS e FROM customer), s AS (SELECT g, count(*) AS k, sum(1.0 / (se * se)) AS w, sum(e / (se * se)) AS wx, sum(e * e / (se * se)) AS wxx FROM x GROUP BY 1)
SELECT g, k, round(wx / w, 6) AS mean, round(wxx - wx * wx / w, 4) AS q, round(greatest(0.0, 100 * ((wxx - wx * wx / w) - (k - 1)) / (wxx - wx * wx / w)), 4) AS i_squared FROM s""")
def q94_heterogeneity(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), (1 + F.col("c_custkey") % 5).cast("double").alias("se"), (F.col("c_acctbal") / 1000).alias("e"))
    out = agg.heterogeneity(rows, ["g"], "e", "se")
    return out.select("g", "k", F.round("mean", 6).alias("mean"), F.round("q", 4).alias("q"), F.round("i_squared", 4).alias("i_squared"))


@query("""SELECT c_custkey, letter FROM (SELECT c_custkey, chr(CAST(65 + c_custkey % 4 AS INT)) AS letter FROM customer) ORDER BY CASE letter WHEN 'C' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, c_custkey LIMIT 40""")
def q95_rank_order(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.char(65 + F.col("c_custkey") % 4).alias("letter"))
    return rows.orderBy(ordering.by_rank(F.col("letter"), ["C", "A"]), "c_custkey").limit(40)


@query("""SELECT p_partkey, p_name FROM part ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END, length(p_name) DESC, p_name, p_partkey LIMIT 30""")
def q96_last_and_longest(spark, d):
    p = table(spark, d, "part")
    return p.orderBy(ordering.last_if(F.col("p_size") > 25), F.desc(F.length("p_name")), "p_name", "p_partkey").limit(30).select("p_partkey", "p_name")


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':7'), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
WHERE r <= greatest(1, floor(n * 0.1))""")
def q97_audit_sample(spark, d):
    return ordering.audit_sample(table(spark, d, "customer"), ["c_mktsegment"], 0.1, 7, "c_custkey").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':3'), c_custkey LIMIT 20""")
def q98_sampled(spark, d):
    return ordering.sampled(table(spark, d, "customer"), 20, 3, "c_custkey").select("c_custkey")


@query("""SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def q99_id_union(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return sets.id_union(c, s, "k")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(coalesce(doi, ''), '', ''), '^\s+|\s+$', '', 'g'), '\.+$', '')) AS found, CASE WHEN y BETWEEN 1900 AND 2027 THEN y END AS year FROM (
SELECT doc_id, '10.1234/x' || doc_id AS doi, CAST(1800 + doc_id % 300 AS INT) AS y FROM documents)""")
def q100_doi_and_year(spark, d):
    k = F.col("doc_id")
    said = F.concat(F.lit("see doi 10.1234/x"), k, F.lit(".. and more"))
    return table(spark, d, "documents").select("doc_id", citations.find_doi(said).alias("found"), citations.sane_year((1800 + k % 300).cast("string"), 2026).alias("year"))


@query("""SELECT s_suppkey, 'Smith, A. & Lee, B' AS authors, CAST(1990 + s_suppkey % 30 AS VARCHAR) AS year, 'Light and mood ' || s_suppkey AS title FROM supplier""")
def q101_citation_lines(spark, d):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("Smith, A. & Lee, B. ("), 1990 + k % 30, F.lit("). Light and mood "), k, F.lit(". Journal of Light, 3. https://doi.org/10.1/"), k)
    c = citations.citation(line)
    return table(spark, d, "supplier").select("s_suppkey", *(c[n].alias(n) for n in ("authors", "year", "title")))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'A B|C D' WHEN 1 THEN 'A B|C D|E' WHEN 2 THEN 'Lee|Ann' ELSE 'Solo' END AS names, CASE WHEN s_suppkey % 2 = 0 THEN 'missing' ELSE 'good' END AS doi_status FROM supplier""")
def q102_authors_and_statuses(spark, d):
    k = F.col("s_suppkey") % 4
    said = F.when(k == 0, "A B and C D").when(k == 1, "A B; C D; E").when(k == 2, "Lee, Ann").otherwise("Solo")
    doi = F.when(k % 2 == 0, "x.json").otherwise("10.1/y")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(citations.authors(said), "|").alias("names"), citations.doi_status(doi).alias("doi_status"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'high' WHEN s_suppkey % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'provisional' ELSE 'missing' END AS state,
CASE WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'good' END AS subjects, round(s_suppkey * 0.5 * 2 / 4, 6) AS rice, 'k' || s_suppkey || '::' || s_nationkey AS key FROM supplier""")
def q103_small_ladders(spark, d):
    k = F.col("s_suppkey")
    doi, title, who = F.when(k % 3 == 0, "d"), F.when(k % 3 < 2, "t"), F.when(k % 3 < 2, "w")
    state = F.when(k % 3 == 0, " Accepted").when(k % 3 == 1, "PROVISIONAL").otherwise("?")
    return table(spark, d, "supplier").select(
        "s_suppkey", citations.metadata_confidence(doi, title, who).alias("confidence"), citations.review_state(state).alias("state"), citations.subject_status(k % 3).alias("subjects"),
        F.round(rules.rice(k, F.lit(0.5), F.lit(2.0), F.lit(4.0)), 6).alias("rice"), collections.dedupe_key(F.concat(F.lit("k"), k), F.col("s_nationkey")).alias("key"),
    )


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id END AS page, 'ART-' || lpad(CAST(100 + page_id AS VARCHAR), 4, '0') AS article, substr(sha256(lower(trim(url))), 1, 12) AS short FROM pages""")
def q104_ids_and_pages(spark, d):
    k = F.col("page_id")
    name = F.when(k % 2 == 0, F.concat(F.lit("scan_Page_"), k, F.lit(".png"))).otherwise("cover.png")
    return table(spark, d, "pages").select("page_id", text.page_number(name).alias("page"), text.sequential_id("ART-", F.lit(100), k).alias("article"), text.digest_id(F.col("url")).alias("short"))


@query("""SELECT item_id, upper(substr(text, 1, 0)) || CASE WHEN item_id % 2 = 0 THEN 'valid' ELSE 'no_magic' END AS verdict, CASE WHEN item_id % 2 = 0 THEN 'accepted' ELSE 'bad_file' END AS strict FROM benchmark""")
def q105_pdf_checks(spark, d):
    head = F.when(F.col("item_id") % 2 == 0, "%PDF-1.4 ").otherwise("plain ")
    content = F.to_binary(F.concat(head, F.col("text"), F.lit(" %%EOF")), F.lit("utf-8"))
    check = rules.pdf_check(content)
    return table(spark, d, "benchmark").select("item_id", F.when(check["valid"], "valid").otherwise(check["problem"]).alias("verdict"), rules.pdf_quarantine(content, F.lit("a.pdf")).alias("strict"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN substr('The title line number ' || item_id, 1, 200) ELSE 'none' END AS title, 'The study asks how light and mood go together in item ' || item_id || '.' AS abstract FROM benchmark""")
def q106_title_and_abstract(spark, d):
    k = F.col("item_id")
    first = F.when(k % 2 == 0, F.concat(F.lit("The title line number "), k)).otherwise(F.concat(F.lit("http://x.org/article/"), k))
    whole = F.concat(first, F.lit("\nAbstract: The study asks how light and mood go together in item "), k, F.lit(".\n\nMore."))
    return table(spark, d, "benchmark").select("item_id", text.title_of(whole, "none").alias("title"), text.abstract_of(whole).alias("abstract"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'A=one;B=two' ELSE 'Core Finding=Light helps.' END AS sections FROM benchmark""")
def q107_sections(spark, d):
    said = F.when(F.col("item_id") % 2 == 0, '{"sections": {"A": " one ", "B": "**two**", "C": " "}}').otherwise("**Light** helps.\n## Rest\nmore")
    pairs = F.array_sort(F.transform(F.map_entries(text.science_sections(said)), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return table(spark, d, "benchmark").select("item_id", F.array_join(pairs, ";").alias("sections"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority, CASE s_suppkey % 3 WHEN 0 THEN 'Half day' WHEN 1 THEN '30–60 min' ELSE '15 min' END AS effort,
CASE s_suppkey % 3 WHEN 0 THEN 'Address the ''' || s_name || ''' violation' WHEN 1 THEN 'Tighten the ''' || s_name || ''' dimension' ELSE 'Review ''' || s_name || '''' END AS opening FROM supplier""")
def q108_critiques(spark, d):
    k = F.col("s_suppkey") % 3
    c = rules.critique(F.when(k == 0, "major").when(k == 1, "minor").otherwise("pass"), F.col("s_name"), F.lit(None).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", c["priority"].alias("priority"), c["effort"].alias("effort"), F.substring_index(c["suggestion"], " on this page.", 1).alias("opening"))


@query("""SELECT conv_id, max(CASE WHEN rn = 1 THEN turn END) AS turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) GROUP BY 1""")
def q109_latest_files(spark, d):
    name = F.format_string("%08d", F.col("turn"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), F.lit("d").alias("deliverable_id"), F.col("turn").alias("path"), name.alias("name"))
    return classes.latest_files(rows).select(F.col("user_id").alias("conv_id"), F.col("path").alias("turn"))


@query("""SELECT (SELECT count(*) FROM region) AS n_papers, (SELECT count(*) FROM nation) AS n_claims, (SELECT count(*) FROM lineitem) AS n_claim_edges, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_attack_edges""")
def q110_layer_summary(spark, d):
    e = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "Attack").otherwise("support").alias("relation"))
    return arguments.layer_summary(table(spark, d, "nation"), e, table(spark, d, "region"))


@query("""SELECT scheme, count(*) AS n FROM (SELECT CASE WHEN l_linestatus = 'O' THEN CAST(year(l_shipdate) AS VARCHAR) ELSE 'unspecified_attack' END AS scheme FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def q111_scheme_counts(spark, d):
    e = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", " ATTACK ").otherwise("support").alias("relation"), F.when(F.col("l_linestatus") == "O", F.substring(F.col("l_shipdate").cast("string"), 1, 4)).otherwise(" ").alias("scheme_hint"))
    return arguments.scheme_counts(e)


@query("""SELECT "column", n_filled, n_papers FROM (SELECT 'quality' AS "column", count(quality) AS n_filled, count(*) AS n_papers FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(toxic), count(*) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'all_empty', count_if(quality IS NULL AND toxic IS NULL), count(*) FROM documents LEFT JOIN labels USING (doc_id))""")
def q112_verified(spark, d):
    return sync.verified(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic"])


@query("""WITH s AS (SELECT doc_id FROM labels), r AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 10 <> 0)
SELECT count_if(r.doc_id IS NOT NULL) AS eligible, count_if(r.quality IS NOT NULL) AS synced, count_if(r.doc_id IS NULL) AS skipped, count_if(r.quality IS NOT NULL) >= 0.95 * count_if(r.doc_id IS NOT NULL) AS passed FROM s LEFT JOIN r USING (doc_id)""")
def q113_pass_summary(spark, d):
    source = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), "quality")
    registry = table(spark, d, "documents").where("doc_id % 10 <> 0").select(F.col("doc_id").alias("paper_id"))
    return sync.pass_summary(source, sync.synced(registry, source), ["quality"], 0.95)


@query("""SELECT c_custkey, titles, people FROM (SELECT c_custkey, c_custkey % 3 < 2 AS titles, c_custkey % 2 = 0 AS people FROM customer)""")
def q114_fuzzy_matches(spark, d):
    k = F.col("c_custkey")
    a = F.concat(F.lit("Light and mood in room "), k)
    b = F.when(k % 3 == 0, F.concat(F.lit("LIGHT, and mood: in room "), k, F.lit(" again and again"))).when(k % 3 == 1, F.concat(F.lit("Light with mood in room "), k)).otherwise(F.lit("Sound without any effect on sleep"))
    x, y = F.lit("Smith and others"), F.when(k % 2 == 0, "smith et al.").otherwise("Jones Brown Green White")
    return table(spark, d, "customer").select("c_custkey", titles_match(a, b).alias("titles"), authors_match(x, y).alias("people"))


@query("""SELECT doc_id, quality FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')""")
def q115_exclusions(spark, d):
    hidden = table(spark, d, "documents").where("source = 'src0'").select("doc_id")
    return joins.anti(filters.with_filled(table(spark, d, "labels"), "quality").where("quality = 1"), hidden, ["doc_id"]).select("doc_id", "quality")


@query("""SELECT level, key, count(DISTINCT l_orderkey) AS paper_count FROM (
SELECT 'iv_root' AS level, split_part(lower(replace(p_brand, '#', '.')), '.', 1) AS key, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'iv_node', lower(replace(p_brand, '#', '.')), l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'dv_focus', lower(p_type), l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""")
def q116_level_counts(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("iv_node"), F.lower("p_type").alias("dv_focus"))
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("paper_id")).join(parts, "l_partkey")
    return topics.level_counts(rows)


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'untested' WHEN 1 THEN 'conflict' ELSE 'credence' END AS gap, CASE WHEN v >= 0.7 THEN 'high' WHEN v >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM (SELECT *, s_suppkey % 10 / 10.0 AS v FROM supplier)""")
def q117_gap_rules(spark, d):
    k = F.col("s_suppkey")
    size, against = F.when(k % 3 == 0, 8).otherwise(9), F.when(k % 3 == 1, 1).otherwise(0)
    return table(spark, d, "supplier").select("s_suppkey", rules.gap_type(size, against).alias("gap"), rules.value_band((k % 10) / 10.0).alias("band"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'track1' WHEN 1 THEN 'track2' END AS track, CASE WHEN s_suppkey % 2 = 0 THEN 'a|c' ELSE 'b|a|c' END AS moved, [s_nationkey % 5]::VARCHAR AS one FROM supplier""")
def q118_maps_and_arrays(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, " T1 ").when(k % 3 == 1, "track 2").otherwise("?")
    front = collections.move_to_front(F.when(k % 2 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("c"))), F.when(k % 2 == 0, "a").otherwise("b"))
    return table(spark, d, "supplier").select("s_suppkey", rules.mapped(name, {"t1": "track1", "Track 2": "track2"}).alias("track"), F.array_join(front, "|").alias("moved"), F.concat(F.lit("["), F.col("s_nationkey") % 5, F.lit("]")).alias("one"))


@query("""SELECT p_partkey, parts, p FROM (SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, lower(replace(p_type, ' ', '.')) AS p FROM part)""")
def q119_split_commas(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_commas(F.replace("p_type", F.lit(" "), F.lit(" , "))), "|").alias("parts"), taxonomy.normal_id(F.replace("p_type", F.lit(" "), F.lit("."))).alias("p"))


@query("""SELECT text AS t, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q120_equal_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    groups = dedup.exact_groups(docs, "doc_id", F.col("text")).where("n > 1 and doc_id = keep_id")
    return groups.join(docs, "doc_id").select(F.col("text").alias("t"), F.col("keep_id").alias("first"), "n")

"""The queries of the driver: operators applied to its tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import citations, rules, taxonomy, text
from lodestone.functions.collections import capped_ratio, json_number
from lodestone.functions.matching import titles_match
from lodestone.operators import aggregates as agg
from lodestone.operators import dedup, filters, joins, ordering, related, sets
from lodestone.plans import arguments, classes, evidence, sync, topics
from lodestone.sources.files import table
from lodestone.streaming.events import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders o
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def q01_latest_with_ties(spark, d):
    return joins.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("""SELECT c_custkey, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS f_total,
round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS o_total,
round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS p_total,
round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def q02_conditional_totals(spark, d):
    rows = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice"), "c_custkey", "left")
    out = agg.status_totals(rows, ["c_custkey"], F.col("o_orderstatus"), ["F", "O", "P"], F.col("o_totalprice"))
    return out.select("c_custkey", *(F.round(f"{x}_total", 2).alias(f"{x.lower()}_total") for x in "FOP"), F.round("total", 2).alias("total"))


@query("""SELECT c_nationkey, count(DISTINCT o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total,
CASE WHEN count(DISTINCT o_orderkey) < 5 THEN 'high' WHEN count(DISTINCT o_orderkey) < 15 THEN 'medium' ELSE 'low' END AS need_level
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_nationkey""")
def q03_need_ranking(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rows = joins.left_where(c, o, c.c_custkey == o.o_custkey, F.col("o_orderstatus") == "O")
    out = rows.groupBy("c_nationkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))
    return out.withColumn("need_level", rules.need_level(F.col("n_orders"))).orderBy("n_orders", "c_nationkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def q04_orphan_rows(spark, d):
    return joins.anti(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_orderstatus <> '' GROUP BY 1")
def q05_status_counts(spark, d):
    return filters.with_filled(table(spark, d, "orders"), "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def q06_page_of_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ordering.page(rows, 25, 50, F.desc("o_totalprice"), F.col("o_orderkey"))[0]


@query("""SELECT event_type, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*) AS n
FROM events WHERE event_type <> '' GROUP BY 1""")
def q07_json_avg(spark, d):
    return table(spark, d, "events").where("event_type <> ''").groupBy("event_type").agg(F.round(F.avg(json_number(F.col("props"), "$.k")), 6).alias("mean_k"), F.count("*").alias("n"))


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median,
list_sort(list(c_acctbal))[count(c_acctbal) // 2 + 1] AS upper_median, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1""")
def q08_summary_stats(spark, d):
    return agg.summary(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


@query("""SELECT c_custkey, c_acctbal, round(100.0 * cume_dist() OVER (ORDER BY c_acctbal), 1) AS percentile FROM customer""")
def q09_percentile(spark, d):
    out = ordering.percentile_rank(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", "c_acctbal", "percentile")


@query("""SELECT p_brand, p_partkey, p_retailprice, CAST(r AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM (
SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part) WHERE p_retailprice >= 0.55 * top) WHERE r <= 3""")
def q10_relative_topk(spark, d):
    return ordering.near_top(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", 0.55, None, 3, ["p_partkey"])


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, value, round(ln(1 + value) / ln(1 + (SELECT max(value) FROM c)), 6) AS intensity FROM c""")
def q11_heatmap(spark, d):
    out = agg.heat_map(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long"))
    return out.withColumn("intensity", F.round("intensity", 6))


@query("""SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_discount >= 0 AND l_discount < 0.025 THEN '[0,0.025)' WHEN l_discount >= 0.025 AND l_discount < 0.055 THEN '[0.025,0.055)'
WHEN l_discount >= 0.055 AND l_discount < 0.2 THEN '[0.055,0.2)' END AS bin FROM lineitem) WHERE bin IS NOT NULL GROUP BY 1""")
def q12_histogram(spark, d):
    return agg.histogram(table(spark, d, "lineitem"), "l_discount", [0, 0.025, 0.055, 0.2])


@query("""WITH j AS (SELECT d.doc_id, text, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT "column", CAST(n AS BIGINT) AS n, round_even(100.0 * n / (SELECT count(*) FROM j), 1) AS pct FROM (
SELECT 'text' AS "column", count_if(text <> '') AS n FROM j UNION ALL SELECT 'lang', count_if(lang <> '') FROM j UNION ALL SELECT 'source', count_if(source <> '') FROM j
UNION ALL SELECT 'quality', count(quality) FROM j UNION ALL SELECT 'toxic', count(toxic) FROM j)""")
def q13_coverage(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return agg.coverage(j, ["text", "lang", "source", "quality", "toxic"])


_HINTS = [("art.the", "the "), ("art.le", "le "), ("art.der", "der "), ("art.el", "el "), ("conj.and", " and "), ("conj.et", " et "), ("art.the", " that ")]


@query("""WITH h(node, hint) AS (VALUES ('art.the', 'the '), ('art.le', 'le '), ('art.der', 'der '), ('art.el', 'el '), ('conj.and', ' and '), ('conj.et', ' et '), ('art.the', ' that '))
SELECT doc_id, node, CAST(count(*) * 1.6 AS DOUBLE) AS score FROM documents, h WHERE contains(lower(text), hint) GROUP BY 1, 2""")
def q14_lexicon_score(spark, d):
    lexicon = spark.createDataFrame(_HINTS, "node string, hint string")
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(1.6).alias("weight"))
    out = topics.lexicon_hits(docs, lexicon, "doc_id", "text")
    return out.select("doc_id", "node", F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS normal,
substr(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]', '_', 'g'), '_'), 1, 80) AS slug,
CASE WHEN length(c) <= 220 THEN c ELSE rtrim(substr(c, 1, 219)) || '…' END AS short
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)""")
def q15_text_normalise(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalised(c)).alias("normal"), text.slugify(c).alias("slug"), text.compact(c).alias("short"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<(svg|noscript)\b[^>]*>.*?</(svg|noscript)>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, h, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM p)
SELECT page_id, trim(regexp_replace(coalesce(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '\s+', ' ', 'g')) AS title, substr(body, 1, 1500) AS excerpt, CAST(length(body) AS INT) AS full_len FROM b""")
def q16_html_extract(spark, d):
    f = text.html_page(F.col("html"), decode=False)
    return table(spark, d, "pages").select("page_id", f["title"].alias("title"), f["excerpt"].alias("excerpt"), f["full_len"].alias("full_len"))


def _plain(c: str, blanks: str = "") -> str:
    """DuckDB SQL: tags to spaces, the entities of the tables decoded, white space collapsed."""
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, shown in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{entity}', '{shown}', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<(svg|noscript)\b[^>]*>.*?</(svg|noscript)>', ' ', 'g') AS h FROM pages),
x AS (SELECT page_id, {_plain("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, CAST(length({_plain("h")}) AS INT) AS full_len,
list_filter(list_transform(regexp_extract_all(h, '(?is)<h[1-3][^>]*>.*?</h[1-3]>'), lambda g: {_plain("g")}), lambda g: g <> '') AS l FROM p)
SELECT page_id, title, array_to_string(list_filter(l, lambda g, i: list_position(l, g) = i)[1:30], '|') AS headings, full_len FROM x""")
def q16b_html_headings(spark, d):
    f = text.html_page(F.col("html"))
    return table(spark, d, "pages").select("page_id", f["title"].alias("title"), F.array_join(f["headings"], "|").alias("headings"), f["full_len"].alias("full_len"))


@query("""WITH g AS (SELECT sha256(text) AS hash, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id, hash, keep_id, n FROM documents JOIN g ON sha256(text) = hash""")
def q17_exact_dup(spark, d):
    return dedup.exact_groups(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
l AS (SELECT w, min(doc_id) AS lo, max(doc_id) AS hi, (list_sort(list(doc_id)))[2] AS second, len(w) AS n, md5(array_to_string(w[1:len(w) // 2], ' ')) AS a, md5(array_to_string(w[len(w) // 2 + 1:], ' ')) AS b,
md5(array_to_string(w[1:(len(w) - 1) // 2], ' ')) AS c, md5(array_to_string(w[len(w) - (len(w) - 1 - (len(w) - 1) // 2) + 1:], ' ')) AS d FROM t WHERE len(w) >= 3 GROUP BY w),
p AS (SELECT x.lo AS i, y.lo AS j, x.w AS u, y.w AS v FROM l x JOIN l y ON x.n = y.n AND x.a = y.a AND x.lo <> y.lo UNION SELECT x.lo, y.lo, x.w, y.w FROM l x JOIN l y ON x.n = y.n AND x.b = y.b AND x.lo <> y.lo
UNION SELECT x.lo, y.lo, x.w, y.w FROM l x JOIN l y ON x.n + 1 = y.n AND x.a = y.c UNION SELECT x.lo, y.lo, x.w, y.w FROM l x JOIN l y ON x.n + 1 = y.n AND x.b = y.d),
s AS (SELECT i, j, len(u) AS m, len(v) AS n, coalesce(list_position(list_transform(range(1, len(u) + 1), lambda k: u[k] = v[k]), false) - 1, len(u)) AS pre,
coalesce(list_position(list_transform(range(0, len(u)), lambda k: u[len(u) - k] = v[len(v) - k]), false) - 1, len(u)) AS suf FROM p),
e AS (SELECT i, j FROM s WHERE pre + suf >= CASE WHEN m = n THEN m - 1 ELSE m END), near AS (SELECT i, min(j) AS j FROM (SELECT i, j FROM e UNION SELECT j, i FROM e) GROUP BY i),
r AS (SELECT doc_id, least(CASE WHEN doc_id = lo THEN second ELSE lo END, near.j) AS match FROM t JOIN l USING (w) LEFT JOIN near ON near.i = l.lo)
SELECT doc_id, match FROM r WHERE match IS NOT NULL""")
def q18_fuzzy_dup(spark, d):
    return dedup.within_one_word(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""SELECT key, ends, lines FROM (
SELECT 'p' || l_partkey AS key, count(*) AS ends, count(*) AS lines FROM lineitem GROUP BY 1
UNION ALL SELECT 's' || l_suppkey, count(*), count(*) FROM lineitem GROUP BY 1)""")
def q19_degree_counts(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"))
    ends = agg.degrees(e, "source", "target").select(F.col("node").alias("key"), F.col("degree").alias("ends"))
    return ends.join(agg.participation(e, [F.col("source"), F.col("target")]).withColumnRenamed("n_edges", "lines"), "key")


@query("""WITH p AS (SELECT p_brand, p_type, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, n_additive, n_distinct FROM (SELECT p_brand, CAST(sum(n) AS BIGINT) AS n_additive FROM p GROUP BY 1)
JOIN (SELECT p_brand, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) USING (p_brand)""")
def q20_additive_vs_distinct(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    return agg.two_level_rollup(rows, "p_brand", "p_type", "l_orderkey")


@query("""WITH s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CAST((CASE WHEN a.p_brand = b.p_brand THEN 4 ELSE 0 END) + (CASE WHEN a.p_type = b.p_type THEN 2 ELSE 0 END) AS DOUBLE) AS score
FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_type = b.p_type)
WHERE a.p_size = b.p_size)
SELECT p_partkey, other, score, CAST(rank AS INT) AS rank FROM (SELECT a AS p_partkey, b AS other, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) WHERE rank <= 4""")
def q21_scored_pairs(spark, d):
    size = F.col("p_size").cast("string")
    key = lambda c: F.array(F.concat_ws("|", c, size))
    rows = table(spark, d, "part").select("p_partkey", key(F.col("p_brand")).alias("brand"), key(F.col("p_type")).alias("type"))
    return related.related(rows, "p_partkey", {"brand": (4.0, None), "type": (2.0, 2.0)}, k=4)


@query("""WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL)
SELECT l.event_type AS a, r.event_type AS b, CAST(count(*) AS DOUBLE) AS weight FROM u l JOIN u r ON l.user_id = r.user_id AND l.event_type < r.event_type GROUP BY 1, 2""")
def q22_cooccurrence(spark, d):
    return agg.cooccurrence(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown_to_us' WHEN v > 1 THEN 'service_disagreement' WHEN NOT (quality = 1 OR toxic = 1) THEN 'no_our_classification'
WHEN rel >= 0.7 AND quality = 1 THEN 'agree' WHEN rel < 0.4 AND quality = 1 THEN 'our_disagreement' ELSE 'mixed' END AS flag
FROM (SELECT doc_id, CASE WHEN source = 'src0' THEN 2 ELSE 1 END AS v, least(1.0, n_chars / 4000.0) AS rel FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q23_agreement_flag(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "src0", 2).otherwise(1).alias("v"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("rel"))
    j = docs.join(table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    flag = rules.agreement_flag(F.coalesce("known", F.lit(False)), F.col("v"), F.col("rel"), F.col("quality") == 1, F.col("toxic") == 1)
    return j.select("doc_id", flag.alias("flag"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE lang END AS lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def q24_field_merge(spark, d):
    earlier = table(spark, d, "documents").select("doc_id", "lang", "source")
    later = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").otherwise("").alias("lang"), "quality")
    return sets.merged(earlier, later, "doc_id")


@query("""WITH t AS (SELECT turn + 1 AS round, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1)
SELECT coalesce(min(r.round), 1) AS round FROM (SELECT unnest(range(1, 100)) AS round) r LEFT JOIN t ON r.round = t.round WHERE n IS NULL OR n < (SELECT count(DISTINCT conv_id) FROM conversations)""")
def q25_first_incomplete_round(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("round"))
    return classes.current_round(c.select("question_id").distinct(), c)


@query("""SELECT 'quality_binary' AS "check", bool_and(quality IN (0, 1)) AS ok FROM labels UNION ALL SELECT 'unique_ids', count(DISTINCT doc_id) = count(*) FROM labels
UNION ALL SELECT 'mean_in_range', avg(quality) BETWEEN 0.5 AND 1 FROM labels
UNION ALL SELECT 'all', bool_and(quality IN (0, 1)) AND count(DISTINCT doc_id) = count(*) AND avg(quality) BETWEEN 0.5 AND 1 FROM labels""")
def q26_validators(spark, d):
    checks = {"quality_binary": F.bool_and(F.col("quality").isin(0, 1)), "unique_ids": ordering.unique(table(spark, d, "labels"), ["doc_id"]), "mean_in_range": ordering.within(F.col("quality"), 0.5, 1)}
    return agg.verdict(table(spark, d, "labels"), checks)


@query("""SELECT o_orderpriority, round_even(15 * sum(CASE WHEN o_orderstatus <> 'P' THEN w ELSE 0 END) / sum(w), 0) AS score, bool_and(NOT (gating AND o_orderstatus = 'P')) AS gate_ok
FROM (SELECT *, CAST(1 + o_orderkey % 3 AS DOUBLE) AS w, o_custkey % 50 = 0 AS gating FROM orders) GROUP BY 1""")
def q26b_weighted_gate(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", (1 + F.col("o_orderkey") % 3).cast("double").alias("w"), F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("PASS").alias("s"), (F.col("o_custkey") % 50 == 0).alias("g"))
    return rows.groupBy("o_orderpriority").agg(agg.weighted_score(rows, "w", F.col("s") == "PASS").alias("score"), agg.gate(F.col("s"), F.col("g")).alias("gate_ok"))


@query("""SELECT 'supplier' AS kind, s_name AS name, s_acctbal AS acctbal, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_name, c_acctbal, c_mktsegment FROM customer""")
def q27_union_shapes(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return sets.union_shapes(s, c, tag="kind", tags=["supplier", "customer"])


@query("""SELECT o_orderkey, o_custkey, (SELECT count(*) FROM customer) AS n_customers FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q28_semi_and_broadcast(spark, d):
    c = table(spark, d, "customer")
    rows = joins.semi(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey")), c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])
    return joins.with_constant(rows, c.agg(F.count("*").alias("n_customers")))


@query("""WITH c AS (SELECT quality a, toxic b, count(*) n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
x AS (SELECT sum(l.x * r.y) AS ch FROM (SELECT a AS v, sum(n) AS x FROM c GROUP BY 1) l JOIN (SELECT b AS v, sum(n) AS y FROM c GROUP BY 1) r USING (v))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 9) AS observed, round(coalesce(ch, 0) / (n * n), 9) AS expected, round((same / n - ch / (n * n)) / (1 - ch / (n * n)), 9) AS kappa FROM t, x""")
def q29_kappa(spark, d):
    out = agg.kappa(table(spark, d, "labels"), "quality", "toxic")
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, abs(s_acctbal) AS s FROM supplier)
SELECT s_nationkey, round(sum(s * s) / (sum(s) * sum(s)), 9) AS hhi, count(*) AS n_members FROM s GROUP BY 1""")
def q30_hhi(spark, d):
    return agg.concentration(table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", F.abs("s_acctbal")).withColumn("hhi", F.round("hhi", 9))


@query("""SELECT direction, key, total, members FROM (
SELECT 'l_returnflag by l_linestatus' AS direction, l_returnflag AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS members FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus by l_returnflag', l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') FROM lineitem GROUP BY 2)""")
def q31_both_ways(spark, d):
    return agg.both_ways(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long")).withColumn("members", F.array_join("members", ","))


@query("""SELECT "group", round(sum(p_retailprice), 2) AS total, count(*) AS n FROM (SELECT *, CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'other' END AS "group" FROM part) GROUP BY 1""")
def q32_prefix_totals(spark, d):
    return agg.prefix_totals(table(spark, d, "part"), "p_type", {"STANDARD": "standard", "PROMO": "promo"}, F.col("p_retailprice")).withColumn("total", F.round("total", 2))


@query("""SELECT CAST(count_if(v BETWEEN 0 AND 5000) AS BIGINT) AS n_good, CAST(count_if(v IS NOT NULL AND NOT v BETWEEN 0 AND 5000) AS BIGINT) AS n_out_of_range, CAST(count_if(v IS NULL AND coalesce(t, '') <> '') AS BIGINT) AS n_not_numeric, CAST(count_if(coalesce(t, '') = '') AS BIGINT) AS n_missing,
round(avg(CASE WHEN v BETWEEN 0 AND 5000 THEN v END), 6) AS mean, min(CASE WHEN v BETWEEN 0 AND 5000 THEN v END) AS min, max(CASE WHEN v BETWEEN 0 AND 5000 THEN v END) AS max
FROM (SELECT CAST(c_acctbal AS VARCHAR) AS t, c_acctbal AS v FROM customer)""")
def q33_numeric_profile(spark, d):
    return agg.numeric_profile(table(spark, d, "customer"), "c_acctbal", 0, 5000).withColumn("mean", F.round("mean", 6))


@query("""SELECT event_type, user_id, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first) AS rank FROM (
SELECT event_type, user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)) WHERE rank <= 3""")
def q34_most_common(spark, d):
    return agg.most_common(table(spark, d, "events"), ["event_type"], "user_id", "event_id", 3)


@query("""SELECT n_nationkey, n_name, array_to_string(list_sort(list(s_suppkey)), ',') AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def q35_nested_lists(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    out = agg.nested(j, ["n_nationkey", "n_name"], ["s_suppkey"])
    return out.select("n_nationkey", "n_name", F.array_join(F.transform("items", lambda x: x["s_suppkey"].cast("string")), ",").alias("suppliers"))


@query("""SELECT conv_id, bool_and(coalesce(prev >= l, TRUE)) AS ok FROM (SELECT conv_id, length(text) AS l, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""")
def q36_descending(spark, d):
    return ordering.descending(table(spark, d, "conversations").withColumn("l", F.length("text")), ["conv_id"], "turn", "l")


@query("""SELECT n_name, CAST(least(100, floor(100.0 * n / 7 + 0.5)) AS INT) AS pct FROM (SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1)""")
def q37_capacity(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    rows = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))
    return rows.select("n_name", capped_ratio(F.col("n"), F.lit(7)).alias("pct"))


@query("""SELECT DISTINCT a.l_orderkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'A')""")
def q38_set_difference(spark, d):
    li = table(spark, d, "lineitem")
    return sets.id_difference(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'A' WHEN c_acctbal >= 7000 THEN 'B' WHEN c_acctbal >= 3000 THEN 'C' ELSE 'F' END AS letter, greatest(0, least(c_acctbal, 5000)) AS clamped FROM customer""")
def q39_grades(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", rules.letter_grade(b, [(9000, "A"), (7000, "B"), (3000, "C")]).alias("letter"), rules.clamped(b, 5000.0).alias("clamped"))


@query("""SELECT page_id, CASE WHEN d IS NULL OR d = '' THEN NULL ELSE d END AS host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS d FROM pages)""")
def q40_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), F.lit("")).alias("host"))


@query("""SELECT c_custkey, upper(c_mktsegment) AS seg FROM customer WHERE lower(c_mktsegment) LIKE 'build%' AND lower(trim(c_mktsegment)) = 'building'""")
def q41_case_filters(spark, d):
    c = F.col("c_mktsegment")
    return table(spark, d, "customer").where(filters.starts_with(c, "Build") & filters.same_text(c, " building ")).select("c_custkey", F.upper(c).alias("seg"))


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE r <= 5""")
def q42_top_per_group(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return ordering.top_per_group(o, ["o_orderpriority"], 5, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS BIGINT) AS n FROM lineitem""")
def q43_numbered(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ordering.numbered(rows, "n", F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "n")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def q44_windowed_counts(spark, d):
    out = windowed_counts(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_SAID = ("meta-analysis", "a scoping review with EEG and surveys", "case report, salivary cortisol", "participants, survey results", "we propose a conceptual model", "editorial on HRV ", "", "one trial of pupils")


def _any(marks) -> str:
    """DuckDB SQL: whether t holds any of the marks."""
    return "(" + " OR ".join(f"contains(t, '{m}')" for m in marks) + ")"


def _sum(marks) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{m}') AS INT)" for m in marks) + ")"


def _article_type_sql() -> str:
    ladder = [(r"regexp_matches(t, '\bmeta[\s-]?analysis\b')", "meta_analysis", 0.96)]
    ladder += [(_any(marks), label, confidence) for label, confidence, _, marks in rules.ARTICLE_PHRASES]
    ladder += [(f"{_sum(rules.EMPIRICAL_TERMS)} >= 2", "empirical_research", 0.78), (f"{_sum(rules.THEORETICAL_TERMS)} > 0 AND {_sum(rules.EMPIRICAL_TERMS)} = 0", "theoretical", 0.72)]
    label, confidence = (" ".join(f"WHEN {row[0]} THEN {row[i]!r}" for row in ladder) for i in (1, 2))
    named = ", ".join(f"CASE WHEN {_any(marks).replace('(t,', '(s,')} THEN '{name}' END" for name, marks in evidence.INSTRUMENTS.items())
    tail = ", ".join(f"'{x}'" for x in _SAID)
    return f"""SELECT item_id, CASE {label} ELSE 'unknown' END AS label, CAST(CASE {confidence} ELSE 0.35 END AS DOUBLE) AS confidence, coalesce(array_to_string([{named}], '|'), '') AS instruments
FROM (SELECT item_id, t, ' ' || t || ' ' AS s FROM (SELECT item_id, lower(text || ' ' || [{tail}][item_id % 8 + 1]) AS t FROM benchmark))"""


@query(_article_type_sql())
def q45_article_types(spark, d):
    """Benchmark texts, each with one of eight endings that speak for a type or an instrument."""
    ending = F.get(F.array(*map(F.lit, _SAID)), F.col("item_id") % 8)
    rows = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", "text", ending).alias("text"))
    kind = rules.article_type(F.col("text"))
    return rows.select("item_id", kind["label"].alias("label"), kind["confidence"].alias("confidence"), F.array_join(evidence.instruments(F.col("text")), "|").alias("instruments"))


@query("""SELECT user_id, percentile FROM (SELECT user_id, round(100.0 * cume_dist() OVER (ORDER BY v), 1) AS percentile FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS v FROM events GROUP BY 1))""")
def q46_user_percentile(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("v"))
    return ordering.percentile_rank(n, "v").select("user_id", "percentile")


@query("""SELECT p_brand, p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand), 9) AS share FROM part""")
def q47_share_of_max(spark, d):
    return ordering.share_of_max(table(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", "p_partkey", F.round("share", 9).alias("share"))


@query("""WITH t AS (SELECT conv_id, count_if(role = 'user') AS u, count_if(role = 'assistant') AS a, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CAST(u AS BIGINT) AS user_turns, CAST(a AS BIGINT) AS assistant_turns, n FROM t""")
def q48_role_pivot(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.count("*").alias("n"))


@query("""SELECT lang, max(CASE WHEN quality = 1 THEN 'good' END) AS good, max(CASE WHEN quality = 0 THEN 'bad' END) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def q49_pass_states(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("name", F.when(F.col("quality") == 1, "good").otherwise("bad")).withColumn("state", F.col("name"))
    return agg.passes(j, ["lang"], "name", "state", ["good", "bad"])


@query("""SELECT source, round(100.0 * avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 4) AS clean_pct, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def q50_source_quality(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(F.round(100.0 * F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)), 4).alias("clean_pct"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2""")
def q51_funnel(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy("l_returnflag", "l_linestatus")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND (o_orderstatus = 'O' OR o_custkey = 7)""")
def q52_between_or(spark, d):
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, d, "orders").where(F.col("o_orderdate").between(day("1996-01-01"), day("1996-12-31")) & ((F.col("o_orderstatus") == "O") | (F.col("o_custkey") == 7))).select("o_orderkey", "o_totalprice")


@query("""SELECT s_nationkey, n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def q53_lookup_chain(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = joins.lookup(joins.lookup(table(spark, d, "supplier"), n, ["s_nationkey"]), table(spark, d, "region"), ["r_regionkey"])
    return out.groupBy("s_nationkey", "n_name", "r_name").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey, string_split(replace(lower(p_type || '.' || p_name), ' ', '.') || CASE p_partkey % 3 WHEN 0 THEN '.stress.x' WHEN 1 THEN '.task' ELSE '.one' END, '.') AS w FROM part)
SELECT p_partkey, array_to_string(w, '.') AS node, array_to_string(w[1:2], '.') AS focus, array_to_string(w[1:CASE p_partkey % 3 WHEN 0 THEN len(w) - 1 ELSE 3 END], '.') AS outcome, upper(w[-1][1]) || substr(w[-1], 2) AS label FROM s""")
def q54_topic_ids(spark, d):
    """Ids of a type, a name of two words, and an ending: a focus with a leaf, a measurement, or another word."""
    ending = F.when(F.col("p_partkey") % 3 == 0, ".Stress.x").when(F.col("p_partkey") % 3 == 1, ".task").otherwise(".one")
    raw = F.concat(F.regexp_replace(F.concat_ws(".", "p_type", "p_name"), " ", "."), ending)
    rows = table(spark, d, "part").select("p_partkey", taxonomy.normal_id(raw).alias("node"))
    return rows.select("p_partkey", "node", taxonomy.environment_focus(F.col("node")).alias("focus"), taxonomy.outcome_focus(F.col("node")).alias("outcome"), taxonomy.environment_label(F.col("node")).alias("label"))


@query("""SELECT lower(p_type) AS outcome_term_id, upper(p_type[1]) || lower(substr(p_type, 2)) AS outcome_label, CAST(sum(n) AS BIGINT) AS paper_count, count(*) AS topic_count
FROM (SELECT p_brand, p_type, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY p_type""")
def q55_crosswalk(spark, d):
    """Brands as environments, types as outcomes, orders as papers: the additive crosswalk and its index."""
    j = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    node = lambda c: F.lower(F.regexp_replace(c, "[ #]", "."))
    none = F.array().cast("array<string>")
    assigned = j.select(F.col("l_orderkey").cast("string").alias("paper_id"), node("p_brand").alias("iv_node"), node("p_type").alias("dv_focus"), none.alias("theories"), none.alias("sensors"))
    h = topics.hierarchy(assigned).withColumns({"dv_focus_label": taxonomy.outcome_label(F.col("dv_focus")), "iv_root_label": taxonomy.environment_root_label(F.col("iv_root")), "iv_label": taxonomy.environment_label(F.col("iv_node")), "fronts": none})
    return topics.crosswalk_index(topics.crosswalk(h, h), "outcome_term_id", "outcome_label").select("outcome_term_id", "outcome_label", "paper_count", "topic_count")


@query("""WITH c AS (SELECT conv_id::VARCHAR AS paper_id, conv_id || '-' || turn AS belief_id, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN turn % 5 = 1 THEN 1 ELSE 0 END AS a FROM conversations),
e AS (SELECT conv_id || '-' || (turn - 1) AS target, CASE WHEN role = 'user' THEN 'attack' ELSE 'support' END AS relation FROM conversations WHERE turn > 0),
x AS (SELECT paper_id, count_if(relation = 'attack') AS direct_attack_edges, count_if(relation = 'support') AS direct_support_edges FROM e JOIN c ON target = belief_id GROUP BY 1)
SELECT paper_id, CAST(sum(s) AS BIGINT) AS incoming_support_total, CAST(sum(a) AS BIGINT) AS incoming_attack_total, CAST(count_if(a > 0) AS BIGINT) AS contested_claim_count, 0 AS defeated_claim_count,
CAST(coalesce(max(direct_attack_edges), 0) AS BIGINT) AS direct_attack_edges, CAST(coalesce(max(direct_support_edges), 0) AS BIGINT) AS direct_support_edges FROM c LEFT JOIN x USING (paper_id) GROUP BY 1""")
def q56_argument_totals(spark, d):
    """Conversations as papers, turns as claims, and each answer as an edge to the turn before."""
    c = table(spark, d, "conversations")
    belief = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    claims = c.select(belief(F.col("turn")).alias("belief_id"), F.col("conv_id").cast("string").alias("paper_id"), F.when(F.col("turn") % 3 == 0, 1).otherwise(0).alias("incoming_support_count"), F.when(F.col("turn") % 5 == 1, 1).otherwise(0).alias("incoming_attack_count"), F.lit("IN").alias("warrant_status"))
    edges = c.where("turn > 0").select(belief(F.col("turn")).alias("source"), belief(F.col("turn") - 1).alias("target"), F.when(F.col("role") == "user", "attack").otherwise("support").alias("relation"))
    return arguments.paper_totals(claims, edges)


@query("""SELECT paper_id, count(*) AS n_constraints_from_paper FROM (
SELECT l_orderkey, l_linenumber, unnest(list_distinct(['o' || l_orderkey, 's' || l_suppkey])) AS paper_id FROM lineitem) GROUP BY 1""")
def q57_constraint_sync(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey", F.lit("_MPX_"), "l_linenumber").alias("source_id"), F.concat(F.lit("bel_s"), "l_suppkey", F.lit("_V5_1")).alias("target_id"))
    return sync.constraint_pass(e)


@query(r"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark),
e AS (SELECT item_id, t, CASE item_id % 5 WHEN 0 THEN regexp_replace(t, '^\S+', 'zz') WHEN 1 THEN 'zz ' || t || ' zz' WHEN 2 THEN regexp_replace(regexp_replace(t, '^\S+', 'zz'), '\S+$', 'zz') WHEN 3 THEN regexp_replace(t, '^(\S+) \S+ ', '\1 ') ELSE '...' END AS u FROM b),
n AS (SELECT item_id, t, trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS x, trim(regexp_replace(regexp_replace(lower(u), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS y FROM e),
w AS (SELECT *, string_split(x, ' ') AS p, string_split(y, ' ') AS q FROM n), k AS (SELECT *, least(len(p), len(q)) AS m, greatest(len(p), len(q)) AS l FROM w),
s AS (SELECT *, coalesce(list_position(list_transform(range(1, m + 1), lambda i: p[i] = q[i]), false) - 1, m) AS pre, coalesce(list_position(list_transform(range(0, m), lambda i: p[len(p) - i] = q[len(q) - i]), false) - 1, m) AS suf FROM k)
SELECT item_id, CASE WHEN x = '' OR y = '' THEN FALSE WHEN contains(x, y) OR contains(y, x) THEN TRUE ELSE m >= 3 AND l - m <= 1 AND pre + suf >= l - 1 END AS match, CASE WHEN len(string_split(t, ' ')) < 3 THEN '' ELSE t END AS title FROM s""")
def q58_title_matches(spark, d):
    """Each whole text against itself changed: one word, framed, two words, a word left out, or nothing but marks."""
    t = text.collapsed(F.col("text"))
    first = F.regexp_replace(t, r"^\S+", "zz")
    changed = F.when(F.col("item_id") % 5 == 0, first).when(F.col("item_id") % 5 == 1, F.concat(F.lit("zz "), t, F.lit(" zz"))).when(F.col("item_id") % 5 == 2, F.regexp_replace(first, r"\S+$", "zz"))
    changed = changed.when(F.col("item_id") % 5 == 3, F.regexp_replace(t, r"^(\S+) \S+ ", "$1 ")).otherwise("...")
    return table(spark, d, "benchmark").select("item_id", titles_match(F.col("text"), changed).alias("match"), citations.publishable_title(F.col("text")).alias("title"))


@query("""SELECT item_id % 5 AS bucket, count_if(length(t) > 50 AND ends_with(rtrim(t), '?')) AS n_questions, count_if(regexp_matches(t, '\\b(AND|OR)\\b') AND contains(t, '"')) AS n_boolean
FROM (SELECT item_id, text || CASE WHEN item_id % 3 = 0 THEN ' ?' WHEN item_id % 3 = 1 THEN ' AND "x"' ELSE '' END AS t FROM benchmark) GROUP BY 1""")
def q59_well_formed(spark, d):
    tail = F.when(F.col("item_id") % 3 == 0, " ?").when(F.col("item_id") % 3 == 1, ' AND "x"').otherwise("")
    rows = table(spark, d, "benchmark").select((F.col("item_id") % 5).alias("bucket"), F.concat("text", tail).alias("t"))
    return rows.groupBy("bucket").agg(*(c.alias(n) for n, c in agg.well_formed(F.col("t")).items()))


@query("""WITH e AS (SELECT event_type, list_sort(list(DISTINCT user_id % 7)) AS seen FROM events GROUP BY 1) SELECT event_type, CAST(len(list_intersect(seen, [0, 2, 4, 11])) AS INT) AS covered FROM e""")
def q60_vocabulary(spark, d):
    seen = (F.col("user_id") % 7).cast("string")
    return table(spark, d, "events").groupBy("event_type").agg(agg.vocabulary_covered(seen, ["0", "2", "4", "11"]).alias("covered"))

"""Queries of the scalar operators over the texts and columns of whole tables; the DuckDB SQL states each operation on the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import citations, collections, rules, text
from lodestone.functions.matching import authors_match, titles_match
from lodestone.operators import aggregates as agg
from lodestone.operators import ordering
from lodestone.plans import evidence
from lodestone.queries import query
from lodestone.queries_intake import _MATCH, _plain_words
from lodestone.sources.files import table


def _collapsed(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' doi 10.' || n_chars || '/' || source || '.' || lang || repeat('.', n_chars % 3) || ' end' AS said,
CAST(n_chars % 3000 AS VARCHAR) || CASE WHEN lang = 'de' THEN 'x' ELSE '' END AS y, source || CASE WHEN n_chars % 2 = 0 THEN '.json ' ELSE ' ' END AS doi, {_collapsed("text")} AS t FROM documents)
SELECT doc_id, nullif(rtrim(regexp_extract(said, '10\.\d{{4,9}}/\S+'), '.'), '') AS found, CASE WHEN TRY_CAST(y AS INT) BETWEEN 1900 AND 2027 THEN TRY_CAST(y AS INT) END AS year,
CASE WHEN trim(doi) LIKE '%.json' THEN 'missing' ELSE 'good' END AS doi_status,
md5(CASE WHEN starts_with(t, '•') OR len(string_split(t, ' ')) < 3 OR contains(lower(t), 'disgusting') THEN '' ELSE t END) AS title,
CASE WHEN trim(t) = '' THEN 'missing' WHEN starts_with(t, '•') OR len(string_split(t, ' ')) < 3 OR contains(lower(t), 'disgusting') THEN 'blocked'
WHEN ends_with(t, ',') OR ends_with(t, ':') OR len(string_split(t, ' ')) < 5 THEN 'provisional' ELSE 'good' END AS title_status,
md5(a) AS abstract, CASE WHEN length(a) = 0 THEN 'missing' WHEN length(a) < 350 THEN 'provisional' ELSE 'good' END AS abstract_status
FROM (SELECT *, CASE WHEN instr(t, '. The') - 1 > 200 THEN rtrim(substr(t, 1, instr(t, '. The') - 1)) WHEN instr(t, ' und ') - 1 > 200 THEN rtrim(substr(t, 1, instr(t, ' und ') - 1)) ELSE t END AS a FROM d)""")
def q140_document_fields(spark, d):
    """DOIs, years, titles and abstracts out of every document's text and columns."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" doi 10."), "n_chars", F.lit("/"), "source", F.lit("."), "lang", F.expr("repeat('.', cast(n_chars % 3 as int))"), F.lit(" end"))
    year = F.concat((F.col("n_chars") % 3000).cast("string"), F.when(F.col("lang") == "de", "x").otherwise(""))
    doi = F.concat("source", F.when(F.col("n_chars") % 2 == 0, ".json ").otherwise(" "))
    c, bad, marks = F.col("text"), ("disgusting",), (". The", " und ")
    return table(spark, d, "documents").select(
        "doc_id", citations.find_doi(said).alias("found"), citations.sane_year(year, 2026).alias("year"), citations.doi_status(doi).alias("doi_status"),
        F.md5(citations.publishable_title(c, bad)).alias("title"), citations.title_status(c, bad).alias("title_status"),
        F.md5(citations.trimmed_abstract(c, marks)).alias("abstract"), citations.abstract_status(c, marks).alias("abstract_status"),
    )


@query(rf"""WITH c AS (SELECT conv_id, turn, {_collapsed("text")} AS t FROM conversations), s AS (SELECT *, list_transform(string_split(t, ','), lambda x: trim(x)) AS h,
CASE WHEN contains(t, ';') THEN ';' WHEN contains(t, ' and ') THEN ' and ' WHEN contains(t, ' & ') THEN ' & ' END AS sep FROM c)
SELECT conv_id, turn, md5(array_to_string(CASE WHEN t = '' THEN [] WHEN sep IS NOT NULL THEN list_filter(list_transform(string_split(t, sep), lambda x: trim(x, ' ,')), lambda x: x <> '')
WHEN len(h) = 2 AND h[1] <> '' AND h[2] <> '' THEN h ELSE [t] END, '|')) AS names FROM s""")
def q141_authors(spark, d):
    """Every turn's text read as a list of authors."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(citations.authors(F.col("text")), "|")).alias("names"))


@query(r"""WITH c AS (SELECT conv_id, turn, replace(role || ', B. & Lee ' || CASE WHEN turn % 3 = 0 THEN '' ELSE '(' || (1890 + conv_id % 150) || '). ' END || text || ' https://doi.org/10.1234/' || conv_id, chr(10), ' ') AS l FROM conversations),
f AS (SELECT *, regexp_matches(l, '^(.+?)\s*\(\d{4}\)\.\s*(.+)') AS apa, regexp_extract(l, '^(.+?)\s*\(\d{4}\)\.\s*(.+)', 1) AS who, regexp_extract(l, '^(.+?)\s*\(\d{4}\)\.\s*(.+)', 2) AS rest, regexp_extract(l, '\((\d{4})\)', 1) AS y FROM c)
SELECT conv_id, turn, CASE WHEN apa THEN rtrim(rtrim(trim(who), ','), '.') ELSE '' END AS authors, CASE WHEN y <> '' THEN y ELSE regexp_extract(l, '\b((?:19|20)\d{2})\b', 1) END AS year,
md5(CASE WHEN apa THEN trim(CASE WHEN regexp_extract(rest, '^(.+?)\.\s+[A-Z]', 1) <> '' THEN regexp_extract(rest, '^(.+?)\.\s+[A-Z]', 1) ELSE split_part(rest, '.', 1) END)
ELSE rtrim(trim(regexp_replace(regexp_replace(l, '\s*https?://doi\.org/\S+', '', 'g'), '\s*10\.\d{4,9}/\S+', '', 'g')), '.') END) AS title FROM f""")
def q142_citation_lines(spark, d):
    """Every turn as a citation line, with a year in brackets or without."""
    when = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("("), 1890 + F.col("conv_id") % 150, F.lit("). ")))
    line = F.replace(F.concat("role", F.lit(", B. & Lee "), when, "text", F.lit(" https://doi.org/10.1234/"), "conv_id"), F.lit("\n"), F.lit(" "))
    c = citations.citation(line)
    return table(spark, d, "conversations").select("conv_id", "turn", c["authors"].alias("authors"), c["year"].alias("year"), F.md5(c["title"]).alias("title"))


def _clean(c: str) -> str:
    """DuckDB: Markdown without front matter, bold marks and surplus blanks."""
    t = f"trim(replace(coalesce({c}, ''), chr(13), chr(10)), ' ' || chr(9) || chr(10))"
    t = rf"regexp_replace({t}, '\A---\s*\n(?s:.*?)\n---\s*\n', '')"
    t = rf"regexp_replace(replace({t}, '**', ''), '\n\s+', chr(10), 'g')"
    return rf"trim(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"


_BODY = "CASE WHEN n_chars % 2 = 0 THEN '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source : \"' || source || '\"' || chr(10) || '---' || chr(10) ELSE '' END || '**' || coalesce(text, '') || '**' || chr(10) || '## Rest' || chr(10) || lang"


@query(rf"""WITH d AS (SELECT doc_id, lang, source, n_chars % 2 = 0 AS headed, {_BODY} AS said, {_clean("text")} AS t FROM documents), e AS (SELECT *, {_clean("said")} AS c FROM d)
SELECT doc_id, md5(c) AS clean, CASE WHEN headed THEN lang || '|' || source ELSE '|' END AS matter, md5(trim(regexp_replace(c, '\n##\s+(?s:.*)\z', ''), ' ' || chr(9) || chr(13) || chr(10))) AS finding,
CASE WHEN t = '' THEN '' ELSE lang || '=' || md5(t) END AS sections FROM e""")
def q143_markdown(spark, d):
    """Every document as a Markdown note with front matter, and as a JSON summary of sections."""
    matter = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("---\nlang: "), "lang", F.lit('\nsource : "'), "source", F.lit('"\n---\n'))).otherwise("")
    said = F.concat(matter, F.lit("**"), F.coalesce("text", F.lit("")), F.lit("**\n## Rest\n"), "lang")
    summary = F.to_json(F.struct(F.map_from_arrays(F.array("lang", F.lit("none")), F.array(F.coalesce("text", F.lit("")), F.lit(" **** "))).alias("sections")))
    given = text.science_sections(summary)
    got = text.front_matter(said)
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text.clean_markdown(said)).alias("clean"), F.concat(F.coalesce(got["lang"], F.lit("")), F.lit("|"), F.coalesce(got["source"], F.lit(""))).alias("matter"),
        F.md5(text.science_sections(said)["Core Finding"]).alias("finding"),
        F.array_join(F.transform(F.map_entries(given), lambda x: F.concat(x["key"], F.lit("="), F.md5(x["value"]))), "|").alias("sections"),
    )


@query(r"""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN ' Accepted' WHEN 'F' THEN 'PROVISIONAL ' ELSE o_orderpriority END AS s, nullif(o_orderstatus, 'F') AS doi, CASE WHEN o_orderpriority LIKE '%LOW' THEN '' ELSE o_orderpriority END AS title, nullif(CAST(o_custkey % 7 AS VARCHAR), '0') AS who FROM orders),
l AS (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R') AS against, sum(l_tax) AS tax, max(l_quantity) AS q, avg(l_discount) AS d, min(l_linenumber) - 1 AS e FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(doi, '') <> '' AND title <> '' AND coalesce(who, '') <> '' THEN 'high' WHEN coalesce(doi, '') <> '' OR (title <> '' AND coalesce(who, '') <> '') THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN lower(trim(s)) IN ('accepted', 'provisional', 'review_required') THEN lower(trim(s)) ELSE 'missing' END AS state, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' ELSE 'good' END AS subjects,
CASE WHEN n <= 8 THEN 'untested' WHEN against > 0 THEN 'conflict' WHEN n > 8 THEN 'credence' ELSE CASE WHEN coalesce(against, 0) > 0 THEN 'conflict' ELSE 'credence' END END AS gap,
CASE WHEN tax >= 0.7 THEN 'high' WHEN tax >= 0.45 THEN 'medium' ELSE 'low' END AS band, CASE WHEN n < 5 THEN 'high' WHEN n < 15 THEN 'medium' ELSE 'low' END AS need,
round(CASE WHEN e <> 0 THEN q * d * tax / e END, 6) AS rice, coalesce(doi, '') || '::' || title || '::' || coalesce(who, '') AS key
FROM o LEFT JOIN l ON l_orderkey = o_orderkey""")
def q144_ladders(spark, d):
    """States, confidences, gaps and priorities of orders by their lines, whose taxes and discounts are added in row order."""
    lines = agg.in_row_order(table(spark, d, "lineitem"), ["l_orderkey"], tax=F.sum("l_tax"), d=F.avg("l_discount"))
    li = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("against"), F.max("tax").alias("tax"), F.max("l_quantity").alias("q"), F.max("d").alias("d"), (F.min("l_linenumber") - 1).alias("e")
    )
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", " Accepted").when(F.col("o_orderstatus") == "F", "PROVISIONAL ").otherwise(F.col("o_orderpriority"))
    doi, who = F.nullif("o_orderstatus", F.lit("F")), F.nullif((F.col("o_custkey") % 7).cast("string"), F.lit("0"))
    title = F.when(F.col("o_orderpriority").endswith("LOW"), "").otherwise(F.col("o_orderpriority"))
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        "o_orderkey", citations.metadata_confidence(doi, title, who).alias("confidence"), citations.review_state(state).alias("state"), citations.subject_status(F.col("n")).alias("subjects"),
        rules.gap_type(F.col("n"), F.col("against")).alias("gap"), rules.value_band(F.col("tax")).alias("band"), rules.need_level(F.col("n")).alias("need"),
        collections.rounded(rules.rice(F.col("q"), F.col("d"), F.col("tax"), F.col("e")), 6).alias("rice"), collections.dedupe_key(doi, title, who).alias("key"),
    )


@query(r"""WITH p AS (SELECT page_id, url, CASE WHEN length(url) % 3 = 0 THEN '%PDF-' WHEN length(url) % 3 = 1 THEN '%PDF' ELSE '%PDF-1.7' END AS head, length(html) % 2900 AS rest, contains(url, '/en/') AS sealed FROM pages)
SELECT page_id, starts_with(head, '%PDF-') AS valid, CASE WHEN NOT starts_with(head, '%PDF-') THEN 'no_magic' END AS problem, CASE WHEN starts_with(head, '%PDF-') AND rest + 5 > 1024 THEN 'no_eof' END AS warning,
CASE WHEN contains(url, '#') OR NOT starts_with(head, '%PDF-') THEN 'bad_file' WHEN rest + 5 > 2048 THEN 'malformed' WHEN sealed THEN 'encrypted' ELSE 'accepted' END AS strict FROM p""")
def q145_pdf_bytes(spark, d):
    """Pages' bytes behind heads of PDF files or nearly so, with the end mark at many distances from the end."""
    n = F.length("url") % 3
    head = F.when(n == 0, "%PDF-").when(n == 1, "%PDF").otherwise("%PDF-1.7")
    sealed = F.when(F.col("url").contains("/en/"), " /Encrypt 5").otherwise("")
    content = F.to_binary(F.concat(head, sealed, F.lit("\n"), "html", F.lit("%%EOF"), F.expr("repeat('x', length(html) % 2900)")), F.lit("utf-8"))
    check = rules.pdf_check(content)
    name = F.when(F.col("url").contains("#"), "a.txt").otherwise("a.PDF")
    return table(spark, d, "pages").select("page_id", check["valid"].alias("valid"), check["problem"].alias("problem"), check["warning"].alias("warning"), rules.pdf_quarantine(content, name).alias("strict"))


@query(r"""WITH d AS (SELECT doc_id, lang || CASE WHEN n_chars % 3 = 0 THEN ' Abstract:  ' ELSE ' ' END || coalesce(text, '') || chr(10) || chr(10) || 'Keywords' AS said FROM documents),
l AS (SELECT doc_id, said, list_filter(list_transform(string_split_regex(said, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) > 10)[1][1:200] AS f FROM d),
a AS (SELECT *, regexp_extract(said, '(?i)\babstract\b[:\s]*(.{50,800}?)(?:\n\n|\bintroduction\b|\bkeywords\b)', 1) AS x FROM l)
SELECT doc_id, CASE WHEN f IS NULL OR length(f) <= 15 OR starts_with(lower(f), 'http') OR starts_with(lower(f), 'doi') OR starts_with(lower(f), 'volume') OR starts_with(lower(f), 'journal') THEN 'none' ELSE f END AS title,
md5(trim(CASE WHEN x <> '' THEN x ELSE said[1:300] END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS abstract FROM a""")
def q146_titles_and_abstracts(spark, d):
    """What every document names as its title and abstract."""
    said = F.concat("lang", F.when(F.col("n_chars") % 3 == 0, " Abstract:  ").otherwise(" "), F.coalesce("text", F.lit("")), F.lit("\n\nKeywords"))
    return table(spark, d, "documents").select("doc_id", text.title_of(said, "none").alias("title"), F.md5(text.abstract_of(said)).alias("abstract"))


@query(r"""WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'major' WHEN 'click' THEN 'minor' ELSE event_type END AS r, event_type || ' ' || user_id AS label, CASE WHEN value > 10 THEN ' ' || props ELSE ' ' END AS note FROM events)
SELECT event_id, CASE r WHEN 'major' THEN 'Address the ''' || label || ''' violation' WHEN 'minor' THEN 'Tighten the ''' || label || ''' dimension' ELSE 'Review ''' || label || '''' END || ' on this page.' ||
CASE WHEN trim(note) <> '' THEN ' Student observed: "' || trim(note) || '"' ELSE '' END || ' Review the heuristic''s standard remedies (see Nielsen/Shneiderman/Tufte source) and apply the smallest change that resolves the issue.' AS suggestion,
CASE r WHEN 'major' THEN 'High' WHEN 'minor' THEN 'Medium' ELSE 'Low' END AS priority, CASE r WHEN 'major' THEN 'Half day' WHEN 'minor' THEN '30–60 min' ELSE '15 min' END AS effort,
CASE lower(trim(label)) WHEN 'view 1' THEN 'first' WHEN 'click 2' THEN 'second' END AS mapped FROM e""")
def q147_critiques(spark, d):
    """A suggestion for every event, by its kind, user and properties."""
    kind = F.col("event_type")
    rating = F.when(kind == "error", "major").when(kind == "click", "minor").otherwise(kind)
    label, note = F.concat("event_type", F.lit(" "), "user_id"), F.when(F.col("value") > 10, F.concat(F.lit(" "), "props")).otherwise(" ")
    c = rules.critique(rating, label, note)
    return table(spark, d, "events").select("event_id", *(c[n].alias(n) for n in ("suggestion", "priority", "effort")), rules.mapped(label, {"View 1": "first", "click 2": "second"}).alias("mapped"))


@query(rf"""WITH b AS (SELECT item_id, list_filter(string_split({_collapsed("text")}, ' '), lambda x: x <> '') AS w FROM benchmark), k AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM b)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i), ' ') AS kept, w[len(w)] || '|' || array_to_string(list_filter(w, lambda x: x <> w[len(w)]), '|') AS moved FROM k""")
def q148_word_lists(spark, d):
    """Words of every item in their first spelling, and with the last word moved to the front."""
    words = F.filter(F.split(text.collapsed(F.col("text")), " "), lambda x: x != "")
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.kept_order(words), " ").alias("kept"), F.array_join(collections.move_to_front(words, F.element_at(words, -1)), "|").alias("moved"))


@query(rf"""WITH p AS (SELECT a.conv_id, a.turn, {_plain_words("a.text")} AS t, {_plain_words("b.text")} AS u, {_plain_words("a.role || ' et al'")} AS x, {_plain_words("b.role || ' and others ' || b.turn % 3")} AS y
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), s AS (SELECT *, string_split(t, ' ') AS a, string_split(u, ' ') AS b FROM p)
SELECT conv_id, turn, CASE WHEN t = '' OR u = '' THEN false ELSE {_MATCH} END AS titles, x = y OR (split_part(x, ' ', 1) = split_part(y, ' ', 1) AND (contains(x, 'et al') OR contains(y, 'et al'))) AS people FROM s""")
def q149_turns_that_match(spark, d):
    """Each turn's text against the next one's as titles, and their speakers as authors."""
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"), F.col("role").alias("other"), (F.col("turn") % 3).alias("k"))
    x, y = F.concat("role", F.lit(" et al")), F.concat("other", F.lit(" and others "), "k")
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", titles_match(F.col("text"), F.col("next")).alias("titles"), authors_match(x, y).alias("people"))


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY length(p_name) DESC, p_name, p_partkey) AS place FROM part""")
def q150_longest_first(spark, d):
    """Names, longest first: the place of each."""
    out = ordering.longest_first(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")
    return ordering.numbered(out, "place", F.desc(F.length("p_name")), F.col("p_name"), F.col("p_partkey"))


@query(rf"""SELECT 'd' || doc_id AS paper_id, coalesce(nullif(trim(source), ''), 'unspecified') AS node_id, md5(CASE WHEN length({_collapsed("text")}) <= 400 THEN {_collapsed("text")} ELSE rtrim(substr({_collapsed("text")}, 1, 399)) || '…' END) AS summary FROM documents""")
def q151_paper_notes(spark, d):
    """Every document as a paper's note under its source."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), F.col("source").alias("node_id"), F.col("text").alias("summary"))
    return evidence.paper_pnus(rows).withColumn("summary", F.md5("summary"))

"""The queries ``opN_<name>``: each operator over its whole table, with the contract's digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.encoding import default_tokenizer
from lodestone.llm.quality_rules import BOILERPLATE, boilerplate_pattern


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_dedup import dedup_lines

    out = dedup_lines(_documents(spark, sf_dir), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_store import write_tokens

    docs = _documents(spark, sf_dir)
    store = write_tokens(docs, default_tokenizer(), end_id=2)
    return store.read(docs.select("doc_id")).withColumnRenamed("key", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality_rules import judge

    out = judge(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.exact_topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(_documents(spark, sf_dir), width=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack

    return pack(_documents(spark, sf_dir), default_tokenizer(), end_id=0, size=2048)


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.class_lm import score_texts

    return score_texts(_documents(spark, sf_dir), folds=7, fold=2)


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality_crf import fit_quality, held_out, score_quality

    docs = _documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Wanted shares of the expected tokens of the domains that the labelled table names.
MIX_WEIGHTS = {"good": 0.90, "low": 0.05, "toxic": 0.05}


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.soft_mixing import label_domain, mix

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    out = mix(_documents(spark, sf_dir), labelled, MIX_WEIGHTS)
    shares = [F.get("p", k).alias(f"p_{d}") for k, d in enumerate(MIX_WEIGHTS)]
    return out.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import near_duplicates

    out = near_duplicates(_documents(spark, sf_dir), width=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.hard_negatives import mine_negatives

    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine_negatives(vectors, F.col("vec_id") % 50 == 0, noisy, positives=5, negatives=3, low=50, high=95, whole=100, scale=256)


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.yinyang import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, seed=2, dims=64, scale=256)


def op13_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secret_grammar import find_secrets, fit_formats

    docs = _documents(spark, sf_dir)
    out = find_secrets(docs, fit_formats(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


#: DuckDB: line dedup with the same keys and counts.
_OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, rn, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rn) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY rn, doc_id
"""

#: DuckDB: every query against every candidate, in integers.
_OP4_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM good
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x) AS score
  FROM parts q JOIN parts c ON q.d = c.d WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

#: DuckDB: the same counts and line rules. The patterns stand for those of quality_rules.
_OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rn, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), windows AS (
  SELECT rn, i, list_slice(ws, i, i + 7) AS v FROM (SELECT rn, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), again AS (
  SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, v) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rn
), lines AS (
  SELECT rn, unnest(string_split(t, chr(10))) AS l FROM d
), measured AS (
  SELECT rn, l, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars, length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) AS symbols, length(regexp_replace(l, '[^\p{Lu}]+', '', 'g')) AS upper,
    len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM lines
), judged AS (
  SELECT rn, l, chars, chars > 0 AND (symbols > 0.05 * chars OR (upper > 0.5 * chars AND chars >= 8) OR regexp_matches(l, '(^|\s)[|»›](\s|$)')
    OR chars - length(regexp_replace(regexp_replace(lower(l), '@BOILERPLATE', '', 'g'), '[\x20\x09-\x0D]+', '', 'g')) >= 0.5 * chars
    OR (NOT regexp_matches(l, '[.!?…:;"''”’»)\]。！？]\s*$') AND words < 5)) AS fails FROM measured
), lost AS (
  SELECT rn, coalesce(sum(chars) FILTER (WHERE fails), 0) AS gone, count(*) FILTER (WHERE chars > 0) - count(DISTINCT l) FILTER (WHERE chars > 0) AS dup FROM judged GROUP BY rn
), counted AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    CAST(dup AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, gone
  FROM d JOIN w USING (rn) JOIN lost USING (rn) LEFT JOIN repeated USING (rn)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND gone <= 0.3 * word_chars AS kept FROM counted
"""

_OP3_SQL = _OP3_SQL.replace("@BOILERPLATE", boilerplate_pattern(BOILERPLATE).replace("'", "''"))

#: DuckDB: every window of every document, by digest.
_OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rn, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT rn, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w)
), first AS (
  SELECT h, min(doc_id) AS lo FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT rn, unnest(range(i, i + 50)) AS p FROM windows JOIN first USING (h) WHERE lo < doc_id
), words AS (
  SELECT rn, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w
), kept AS (
  SELECT words.rn, count(gone.p) AS n, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t FROM words LEFT JOIN gone ON gone.rn = words.rn AND gone.p = words.p GROUP BY words.rn
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rn)
"""

#: DuckDB: every anchor against every row, in integers.
_OP11_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT vec_id, label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM good
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, any_value(a.label = r.label) AS same, sum(a.x * r.x) AS score
  FROM parts a JOIN parts r ON a.d = r.d WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id GROUP BY 1, 2
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scores n USING (anchor_id)
  WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM ranked WHERE rank <= 3
"""



def _lloyd_sql(k: int, rounds: int, seed: int, dims: int) -> str:
    """Plain rounds: every vector against every centroid, in integers (doubles below 2^53)."""
    floor = "CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)"
    steps = [f"""good AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims} AND len(embedding) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM good ORDER BY h LIMIT {k})
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rn, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, d * {k} + j) AS j, CAST(min(d) AS BIGINT) AS d
  FROM (SELECT rn, vec_id, v, j, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM good, c{r}) GROUP BY rn
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT j, p, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT j, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM a{r}) GROUP BY j, p
), n{r} AS (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS c FROM m{r} GROUP BY j
), c{r + 1} AS MATERIALIZED (
  SELECT o.j, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n ON n.j = o.j
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, CAST(a.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_token_store, op3_quality_rules, op4_exact_topk, op5_substring_dedup, op6_best_fit_packing, op7_class_lm, op8_quality_crf, op9_soft_mixing, op10_simhash, op11_hard_negatives, op12_yinyang, op13_secret_grammar)}

ORACLES: dict[str, str] = {"op1_line_dedup": _OP1_SQL, "op3_quality_rules": _OP3_SQL, "op4_exact_topk": _OP4_SQL, "op5_substring_dedup": _OP5_SQL, "op11_hard_negatives": _OP11_SQL, "op12_yinyang": _lloyd_sql(40, 5, 2, 64)}

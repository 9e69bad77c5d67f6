"""Evidence and articles: claims to evidence rows, article derivation, details, theories, mechanisms and fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import any_marker, compact, first_present, present, slugify
from lodestone.operators.aggregates import most_common
from lodestone.operators.joins import first_per_key
from lodestone.operators.ordering import numbered, percentile_rank, top_per_group

#: Instruments by what a text says.
INSTRUMENTS = {"EEG": (" eeg ", "electroencephal", "alpha asymmetry", "frontal theta", "erp "), "EDA": (" eda ", "electrodermal", "skin conductance", "scr ", "scl "), "HRV": (" hrv ", "heart rate variability", "rmssd", "heart rate"), "Cortisol": ("cortisol", "salivary cortisol"), "Pupil": ("pupil", "pupill"), "PVT": (" pvt ", "psychomotor vigilance"), "NASA-TLX": ("nasa tlx", "task load index", "tlx "), "fNIRS": ("fnirs", "functional near infrared"), "EMG": (" emg ", "electromyography", "corrugator"), "Self-report": ("self report", "questionnaire", "survey", "rating scale", "stai", "panas")}


def instruments(text):
    """The instruments that a text names, in the table's order."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.filter(F.array(*(F.when(any_marker(low, marks), name) for name, marks in INSTRUMENTS.items())), lambda x: x.isNotNull())


#: The order in which the page lists give their reasons; methods pages give none.
REASON_ORDER = {"figure": 0, "sample": 1, "table": 2, "results": 3, "methods": 9}

#: The fields of a claim in which instruments are looked for.
HAYSTACK = ("statement", "iv", "dv", "abstract_clean_text", "structured_result_row.comparison", "structured_result_row.outcome")


def said_with(df: DataFrame, *names: str):
    """The fields that ``df`` has, joined by spaces; nulls count as empty."""
    has = set(df.columns) | {f"{f.name}.{g.name}" for f in df.schema if hasattr(f.dataType, "fields") for g in f.dataType.fields}
    return F.concat_ws(" ", *(F.coalesce(F.col(n), F.lit("")) for n in names if n in has))


def evidence_rows(claims: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A numbered evidence row for each claim with a paper: statement, bridge type, chain and credence discount.

    Claims without a paper id go (``dropped_claims`` counts them). Columns
    ``primary_type`` and ``likely_types``, where the claims have them, give the
    warrant policy of their article's type.
    """
    rows = claims.where(present(F.col("paper_id")).isNotNull())
    said = first_present(F.col("statement"), F.col("claim"), F.col("claim_text"), F.col("quote"))
    raw = first_present(F.col("evidence_profile.warrant_type"), F.col("warrant_type"))
    theory = F.concat_ws(" ", "theory_name", F.array_join(F.coalesce("theory_names", F.array().cast("array<string>")), " "))
    primary, likely = (F.col(c) if c in rows.columns else None for c in ("primary_type", "likely_types"))
    spoken = F.concat_ws(" ", "statement", "claim_text", "quote")
    kind = rules.bridge_type(raw, F.col("claim_role"), spoken, theory, primary, likely)
    statistic = F.col("structured_result_row.test_statistic").alias("statistic")
    named = instruments(said_with(rows, *HAYSTACK)).alias("instruments")
    rows = rows.select(ordinal, F.btrim("paper_id").alias("paper_id"), said.alias("statement"), kind.alias("bridge"), raw.alias("raw"), "claim_role", statistic, named)
    rows = rows.withColumns({"chain": rules.warrant_chain(F.col("bridge"), F.col("raw"), F.col("claim_role"), F.col("statistic")), "discount": rules.discount(F.col("bridge"))})
    return numbered(rows, "evidence_no", F.col(ordinal)).drop("raw", "statistic")


def dropped_claims(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count_if(present(F.col("paper_id")).isNull()).alias("n_dropped"))


def articles(claims: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row a paper: the first filled title, DOI and year in input order, claim count, and the three most frequent theories."""
    rows = claims.where(present(F.col("paper_id")).isNotNull())

    def first(c):
        return F.min_by(c, F.when(c.isNotNull(), F.col(ordinal)))

    base = rows.groupBy("paper_id").agg(first(first_present(F.col("paper_title"), F.col("title"))).alias("title"), first(present(F.col("doi"))).alias("doi"), first(F.col("year").try_cast("int")).alias("year"), F.count("*").alias("claim_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(instruments(said_with(rows, *HAYSTACK)))))).alias("instruments"))
    named = rows.select("paper_id", ordinal, F.explode(F.coalesce("theory_names", F.array().cast("array<string>"))).alias("theory")).where("theory <> ''")
    top = most_common(named, ["paper_id"], "theory", ordinal, 3).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "theory"))), lambda x: x["theory"]).alias("theories"))
    return base.join(top, "paper_id", "left")


def belief_scores(beliefs: DataFrame) -> DataFrame:
    """Mean credence and mean omega (from JSON) for each paper; blank papers go."""
    from lodestone.functions.collections import json_number

    return beliefs.where(present(F.col("paper_id")).isNotNull()).groupBy(F.btrim("paper_id").alias("paper_id")).agg(F.avg("credence_value").alias("mean_credence"), F.avg(json_number(F.col("omega_json"), "$.omega")).alias("mean_omega"), F.count("*").alias("n_beliefs"))


def article_details(articles_: DataFrame, beliefs: DataFrame, arguments: DataFrame, evidence: DataFrame, k: int = 8) -> DataFrame:
    """Articles with credence percentile, argument totals and their first k evidence rows."""
    scored = percentile_rank(belief_scores(beliefs), "mean_credence")
    shown = top_per_group(evidence, ["paper_id"], k, F.col("evidence_no")).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("evidence_no", "statement", "bridge"))).alias("evidence"))
    return articles_.join(scored, "paper_id", "left").join(arguments, "paper_id", "left").join(shown, "paper_id", "left")


def paper_pnus(artifacts: DataFrame) -> DataFrame:
    """Paper notes, rows that have a topic node first."""
    blank = F.coalesce(present(F.col("node_id")), F.lit("unspecified"))
    return artifacts.select("paper_id", blank.alias("node_id"), compact(F.col("summary"), 400).alias("summary")).orderBy(blank == "unspecified", "node_id", "paper_id")


def theory_index(articles_: DataFrame, topics: str = "topics", clusters: str = "clusters", k: int = 8) -> DataFrame:
    """(theory, other, weight, rank): theories that meet in papers' topics (1 each) and clusters (2 each).

    Papers that name several theories join by topic and by cluster keys.
    """
    def pairs(column: str, weight: float) -> DataFrame:
        rows = articles_.select("theories", F.explode(column).alias("key")).select("key", F.explode("theories").alias("theory")).distinct()
        return rows.alias("a").join(rows.alias("b"), "key").where("a.theory <> b.theory").select(F.col("a.theory").alias("theory"), F.col("b.theory").alias("other"), F.lit(weight).alias("w"))

    scores = pairs(topics, 1.0).union(pairs(clusters, 2.0)).groupBy("theory", "other").agg(F.sum("w").alias("weight"))
    return top_per_group(scores, ["theory"], k, F.desc("weight"), F.col("other"))


def theories(articles_: DataFrame, k: int = 8) -> DataFrame:
    """One row a theory: id, label, papers, and up to k representative papers, each once, latest first."""
    rows = articles_.select("paper_id", "year", F.explode("theories").alias("label")).withColumn("theory_id", slugify(F.col("label")))
    counts = rows.groupBy("theory_id").agg(F.min("label").alias("label"), F.count_distinct("paper_id").alias("paper_count"))
    best = top_per_group(rows.dropDuplicates(["theory_id", "paper_id"]), ["theory_id"], k, F.desc_nulls_last("year"), F.col("paper_id"))
    papers = best.groupBy("theory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"]).alias("representative_papers"))
    return counts.join(papers, "theory_id")


def mechanism_inventory(framework: DataFrame, cross: DataFrame) -> DataFrame:
    """Mechanisms of frameworks and across frameworks as one table, with readiness by words."""
    both = framework.withColumn("scope", F.lit("framework")).unionByName(cross.withColumn("scope", F.lit("cross_framework")), allowMissingColumns=True)
    return both.withColumn("readiness", rules.word_band(F.col("word_count")))


def fronts(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Front summaries: category, size, value, and means taken from the papers' scores where the front has none."""
    label = first_present(F.col("label"), F.col("title"), F.col("name"), F.col("front_id"))
    papers = F.filter(F.transform(F.coalesce("papers", "paper_ids", F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: x != "")
    rows = records.select("front_id", F.coalesce(label, F.lit("Unlabeled front")).alias("name"), papers.alias("paper_ids"), F.coalesce(F.nullif("size", F.lit(0)), F.size(papers)).cast("long").alias("n"), F.coalesce("mean_credence", F.lit(0.0)).alias("c"), F.coalesce(F.nullif("mean_omega", F.lit(0.0)), "mean_warrant", F.lit(0.0)).alias("o"), F.coalesce("shared_theories", "theories").alias("shared_theories"), F.coalesce("shared_constructs", "topic_ids").alias("shared_constructs"), F.coalesce("maturity", "maturity_label", F.lit("unknown")).alias("maturity"), F.coalesce("n_contradictions", "contradiction_count", F.lit(0)).alias("contradictions"), F.coalesce("n_replications", "replication_count", F.lit(0)).alias("replications"))
    means = rows.select("front_id", F.explode("paper_ids").alias("paper_id")).join(scores, "paper_id").groupBy("front_id").agg(F.avg(F.nullif("mean_credence", F.lit(0.0))).alias("pc"), F.avg(F.nullif("mean_omega", F.lit(0.0))).alias("po"))
    rows = rows.join(means, "front_id", "left").withColumns({"mean_credence": F.when(F.col("c") > 0, F.col("c")).otherwise(F.coalesce("pc", "c")), "mean_omega": F.when(F.col("o") > 0, F.col("o")).otherwise(F.coalesce("po", "o"))})
    voi = F.bround(F.coalesce(F.nullif("mean_omega", F.lit(0.0)), "mean_credence"), 3)
    return rows.select(F.coalesce("front_id", slugify(F.col("name"))).alias("id"), rules.front_category(F.col("name"), F.col("shared_theories"), F.col("shared_constructs")).alias("cat"), "n", voi.alias("voi"), "name", "maturity", F.bround("mean_credence", 3).alias("mean_credence"), F.bround("mean_omega", 3).alias("mean_omega"), "shared_theories", "shared_constructs", "contradictions", "replications", "paper_ids").orderBy(F.desc("voi"), F.desc("n"), "name")


def gaps(fronts_: DataFrame) -> DataFrame:
    """Fronts that are small, not established or contradicted, by value band and title."""
    band = rules.value_band(F.bround("voi", 2))
    rows = fronts_.where(rules.is_gap(F.col("n"), F.col("maturity"), F.col("contradictions"))).select("id", rules.gap_type(F.col("n"), F.col("contradictions")).alias("type"), F.col("name").alias("title"), band.alias("voi"))
    return rows.orderBy(F.when(F.col("voi") == "high", 0).when(F.col("voi") == "medium", 1).otherwise(2), "title")


def page_candidates(ranked: DataFrame, pictures: DataFrame, pages: DataFrame, k: int = 8) -> DataFrame:
    """The k best pictures and rendered pages of each paper: score, kind, reasons and rank.

    ``ranked`` (paper_id, list, page, place, reasons): pages by list (figure,
    sample, methods, results, table); of each list the first six (figure) or
    four count. ``pictures`` (paper_id, page, filename, width, height) under the
    least size go; ``pages`` (paper_id, page, filename) need a score. Both
    lists meet as one, ordered by score, page and file name; of rows with the
    same file the first stays.
    """
    most = F.when(F.col("list") == "figure", 6).otherwise(4)
    of = ranked.where(F.col("place") <= most).groupBy("paper_id", "page")
    has = {n: F.coalesce(F.bool_or(F.col("list") == n), F.lit(False)).alias(n) for n in ("figure", "sample", "methods", "results", "table")}
    why = F.array_sort(F.collect_list(F.struct(F.coalesce(*(F.when(F.col("list") == n, F.lit(o)) for n, o in REASON_ORDER.items())).alias("o"), "place", "reasons")))
    surface = of.agg(*has.values(), F.flatten(F.transform(F.filter(why, lambda x: x["o"] < 9), lambda x: x["reasons"])).alias("reasons"))
    kinds = lambda d: d.join(surface, ["paper_id", "page"], "left").na.fill(False, list(has))
    a = kinds(pictures.where((F.col("width") >= rules.PICTURE_WIDTH) & (F.col("height") >= rules.PICTURE_HEIGHT)))
    p = rules.picture_score(F.col("figure"), F.col("sample") | F.col("methods"), F.col("table") | F.col("results"))
    b = kinds(pages)
    q = rules.page_score(F.col("table"), F.col("results"), F.col("figure"), F.col("sample"))
    shape = lambda d, s, render: d.select("paper_id", "page", "filename", s["score"].alias("score"), s["kind"].alias("kind"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), F.lit(render).alias("render_type"))
    both = shape(a, p, "embedded").unionByName(shape(b, q, "full_page").where("score > 0"))
    order = [F.desc("score"), F.col("page"), F.coalesce("filename", F.lit(""))]
    return top_per_group(first_per_key(both, ["paper_id", "filename"], *order), ["paper_id"], k, *order)

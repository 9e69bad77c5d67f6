"""Argumentation, annotation and interpretation layers, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import compact, first_present, present
from lodestone.operators.joins import best_confidence, lookup, with_constant
from lodestone.operators.ordering import top_per_group


def _top_edges(edges: DataFrame, claims: DataFrame, relation: str, name: str, k: int, ordinal: str) -> DataFrame:
    """(belief_id, name): the first k edges of a relation that point at a belief, with their sources."""
    sources = claims.select(F.col("belief_id").alias("source"), F.col("paper_id").alias("source_paper_id"), compact(F.col("content_preview"), 160).alias("source_preview"))
    rows = edges.where(F.lower(F.btrim("relation")) == relation).withColumn("strength", F.bround(F.coalesce("strength", F.lit(0.0)), 3))
    first = lookup(top_per_group(rows, ["target"], k, F.col(ordinal)), sources, ["source"])
    item = F.struct("rank", "source", "source_paper_id", "source_preview", "scheme_hint", "strength")
    return first.groupBy(F.col("target").alias("belief_id")).agg(F.array_sort(F.collect_list(item)).alias(name))


def claim_nodes(claims: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 3, ordinal: str = "ordinal") -> DataFrame:
    """Claims with their last search target and first attacks and supports, most attacked first.

    ``belief_id`` is unique in ``claims``; rows without one stay and get no edges.
    """
    filled = targets.where(present(F.col("belief_id")).isNotNull() & present(F.col("paper_id")).isNotNull())
    last = best_confidence(filled.withColumn("__same", F.lit(0)), ["belief_id"], "__same", ordinal)
    asked = last.select("belief_id", compact(F.col("resolution_question"), 240).alias("resolution_question"), "review_urgency", "attack_scheme_hints")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = claims.select("belief_id", "paper_id", compact(F.col("content_preview"), 180).alias("content_preview"), n("incoming_support_count"), n("incoming_attack_count"), n("contradiction_count"), F.coalesce("warrant_status", F.lit("")).alias("warrant_status"))
    out = lookup(out, asked, ["belief_id"], {"resolution_question": "", "review_urgency": ""})
    for relation, name in (("attack", "top_attacks"), ("support", "top_supports")):
        out = lookup(out, _top_edges(edges, claims, relation, name, k, ordinal), ["belief_id"])
    return out.orderBy(F.desc("incoming_attack_count"), F.desc("incoming_support_count"), F.desc("contradiction_count"), F.coalesce("belief_id", F.lit("")))


def paper_nodes(papers: DataFrame, targets: DataFrame) -> DataFrame:
    """Papers with preview, at most eight theories and their search targets, most contradicted first."""
    filled = targets.where(present(F.col("belief_id")).isNotNull() & present(F.col("paper_id")).isNotNull())
    asked = filled.groupBy("paper_id").agg(F.count("*").alias("search_target_count"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    theories = F.slice(F.coalesce("theories", F.array().cast("array<string>")), 1, 8).alias("theories")
    out = papers.select(first_present(F.col("paper_id"), F.col("belief_id")).alias("paper_id"), compact(F.col("content_preview"), 180).alias("content_preview"), n("contradiction_count"), n("claim_count"), F.coalesce("dominant_stance", F.lit("")).alias("dominant_stance"), theories)
    out = lookup(out, asked, ["paper_id"], {"search_target_count": 0})
    return out.orderBy(F.desc("contradiction_count"), F.desc("claim_count"), F.coalesce("paper_id", F.lit("")))


def annotations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types by count, annotations with their content cut to 220 characters)."""
    types = rows.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")
    return types, rows.select("id", "type", "target_type", "target_id", compact(F.col("content"), 220).alias("content"), "confidence", F.coalesce("status", F.lit("")).alias("status"))


def frontier_questions(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k questions of highest value: framework, first three questions and how many papers match."""
    name = first_present(F.col("resolved_framework_name"), F.col("resolved_framework_id"), F.col("belief_id"))
    size = F.coalesce(F.size("matching_paper_ids"), F.lit(0))
    out = rows.select("frontier_id", "belief_id", name.alias("framework_name"), "voi_score", "voi_bucket", "zone", F.slice("questions", 1, 3).alias("question_set"), F.greatest(size, F.lit(0)).cast("long").alias("matching_paper_count"))
    return out.orderBy(F.desc(F.coalesce("voi_score", F.lit(0.0))), F.coalesce("framework_name", F.lit("")), "frontier_id").limit(k)


def validation_beliefs(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k beliefs with most challenging evidence, the least complete first among equals."""
    challenged, complete = F.coalesce("challenging_evidence_count", F.lit(0)), F.coalesce("validation_completeness", F.lit(0.0))
    shown = ("belief_id", "validation_completeness", "replication_status", "supporting_evidence_count", "challenging_evidence_count", "scope_specified")
    return rows.select(*shown).orderBy(F.desc(challenged), complete, F.coalesce("belief_id", F.lit(""))).limit(k)


def layers(edges: DataFrame, annotations_: DataFrame, frontier: DataFrame) -> DataFrame:
    """(id, primary_metric, primary_label) of the three layers: claim edges, annotations and questions of high value."""
    n = with_constant(with_constant(edges.agg(F.count("*").alias("e")), annotations_.agg(F.count("*").alias("a"))), frontier.agg(F.count_if(F.lower("voi_bucket") == "high").alias("q")))
    row = lambda i, c, label: F.struct(F.lit(i).alias("id"), F.col(c).alias("primary_metric"), F.lit(label).alias("primary_label"))
    each = (row("argumentation", "e", "claim-level support edges"), row("annotations", "a", "active annotations"), row("interpretation", "q", "high-VOI frontier questions"))
    return n.select(F.inline(F.array(*each)))


def dashboard(articles: DataFrame, evidence: DataFrame, shown: int = 6, target: int = 15) -> DataFrame:
    """One row: evidence rows, papers, and how many of the evaluations due are shown as done."""
    n = with_constant(articles.agg(F.count("*").alias("article_count")), evidence.agg(F.count("*").alias("evidence_count")))
    return n.withColumns({"evaluated": F.least(F.lit(shown).cast("long"), "evidence_count"), "target": F.lit(target).cast("long")})

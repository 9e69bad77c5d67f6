"""The argument graph: per-paper totals, attack examples, search targets and layer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import compact, present
from lodestone.operators.aggregates import most_common
from lodestone.operators.joins import endpoints
from lodestone.operators.ordering import top_per_group


def paper_totals(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming supports and attacks, contested and defeated claims, and direct edges by the target's paper."""
    known = claims.where(present(F.col("belief_id")).isNotNull() & present(F.col("paper_id")).isNotNull())
    attacks = F.coalesce("incoming_attack_count", F.lit(0))
    base = known.groupBy("paper_id").agg(F.sum(F.coalesce("incoming_support_count", F.lit(0))).alias("incoming_support_total"), F.sum(attacks).alias("incoming_attack_total"), F.count_if(attacks > 0).alias("contested_claim_count"), F.count_if(F.upper("warrant_status") == "DEFEATED").alias("defeated_claim_count"))
    relation = F.lower(F.btrim("relation"))
    direct = edges.join(known.select(F.col("belief_id").alias("target"), "paper_id"), "target").groupBy("paper_id").agg(F.count_if(relation == "attack").alias("direct_attack_edges"), F.count_if(relation == "support").alias("direct_support_edges"))
    return base.join(direct, "paper_id", "full_outer").na.fill(0)


def attack_examples(claims: DataFrame, edges: DataFrame, k: int | None = 36) -> DataFrame:
    """Attacks with both previews, strongest first."""
    nodes = claims.select("belief_id", "paper_id", compact(F.col("content_preview"), 160).alias("preview"))
    rows = endpoints(edges.where(F.lower(F.btrim("relation")) == "attack"), nodes, "belief_id", ["paper_id", "preview"])
    out = rows.withColumns({"strength": F.bround(F.coalesce("strength", F.lit(0.0)), 3), "scheme_hint": F.coalesce(present(F.col("scheme_hint")), F.lit("unspecified_attack"))}).orderBy(F.desc("strength"), "target", "source")
    return out.limit(k) if k else out


def scheme_counts(edges: DataFrame) -> DataFrame:
    return edges.where(F.lower(F.btrim("relation")) == "attack").groupBy(F.coalesce(present(F.col("scheme_hint")), F.lit("unspecified_attack")).alias("scheme")).agg(F.count("*").alias("n"))


def search_targets(targets: DataFrame, k: int = 3, ordinal: str = "ordinal") -> DataFrame:
    """Per paper: how many targets, the k of highest priority, and the three most frequent attack schemes."""
    rows = targets.where(present(F.col("belief_id")).isNotNull() & present(F.col("paper_id")).isNotNull())
    n = rows.groupBy("paper_id").agg(F.count("*").alias("search_target_count"))
    top = top_per_group(rows, ["paper_id"], k, F.desc(F.coalesce("priority_score", F.lit(0.0))), F.col("belief_id")).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "belief_id"))), lambda x: x["belief_id"]).alias("top_search_targets"))
    hints = most_common(rows.select("paper_id", ordinal, F.explode("attack_scheme_hints").alias("hint")), ["paper_id"], "hint", ordinal, 3)
    schemes = hints.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hint"))), lambda x: x["hint"]).alias("top_attack_schemes"))
    return n.join(top, "paper_id").join(schemes, "paper_id", "left")


def layer_summary(claims: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """One row of sizes: papers, claims, all claim edges, and those that attack."""
    return papers.agg(F.count("*").alias("n_papers")).crossJoin(F.broadcast(claims.agg(F.count("*").alias("n_claims")))).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_claim_edges"), F.count_if(F.lower("relation") == "attack").alias("n_attack_edges"))))


def debate_clusters(clusters: DataFrame, paper: str | None = None, k: int = 16) -> DataFrame:
    """Clusters with at most k papers each; a focus paper filters before the cut."""
    rows = clusters.where(F.array_contains("paper_ids", paper)) if paper else clusters
    return rows.withColumn("paper_ids", F.slice("paper_ids", 1, k))

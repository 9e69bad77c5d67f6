"""Backward sync: six passes that bring counts from belief, constraint, edge and question stores to the paper registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import present
from lodestone.operators.aggregates import edges_by_paper, participation, sorted_set
from lodestone.operators.filters import any_filled, filled
from lodestone.operators.joins import keyword_matches, paper_of, with_constant


def belief_pass(beliefs: DataFrame, warrants: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per paper: beliefs, sorted warrant states, and constraint ends at its beliefs."""
    ends = constraints.select(F.explode(F.array("source_id", "target_id")).alias("belief_id")).where(F.coalesce("belief_id", F.lit("")) != "").groupBy("belief_id").agg(F.count("*").alias("n_ends"))
    rows = beliefs.where(F.col("paper_id").isNotNull()).select("belief_id", "paper_id").join(warrants.select("belief_id", "warrant_status"), "belief_id", "left").join(ends, "belief_id", "left")
    return rows.groupBy("paper_id").agg(F.count_distinct("belief_id").alias("n_beliefs"), sorted_set("warrant_status").alias("warrant_types"), F.coalesce(F.sum("n_ends"), F.lit(0)).alias("n_en_constraints"))


def bn_pass(edges: DataFrame) -> DataFrame:
    return edges_by_paper(edges, "paper_ids").withColumnsRenamed({"n_edges": "n_bn_edges", "nodes": "bn_nodes"})


def constraint_pass(constraints: DataFrame) -> DataFrame:
    """Per paper the constraints that touch it by the ids of their beliefs, each once."""
    return participation(constraints, [paper_of(F.col("source_id")), paper_of(F.col("target_id"))]).withColumnsRenamed({"key": "paper_id", "n_edges": "n_constraints_from_paper"})


def interpretation_pass(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """Every paper with the number of all interpretation questions."""
    return with_constant(papers.select("paper_id"), questions.agg(F.count("*").alias("n_interpretation_questions")))


#: Words that a question's topic stands for.
TOPIC_WORDS = {"attention restoration theory": ("attention", "restoration", "natural", "fascination", "cog", "affect"), "stress recovery": ("stress", "affect", "negative", "recovery", "physio"), "wayfinding": ("spatial", "navigation", "wayfinding", "cog", "performance"), "biophilia": ("natural", "biophilic", "affect", "wellbeing"), "thermal comfort": ("thermal", "temperature", "comfort"), "acoustic": ("acoustic", "sound", "noise"), "lighting": ("luminous", "light", "lighting", "circadian"), "prospect-refuge": ("spatial", "prospect", "refuge", "affect"), "environmental preference": ("affect", "wellbeing", "preference")}


def question_words(topic):
    """The keywords of a question: of each topic that its text names or shares a word with, and its own words over three letters."""
    low = F.lower(F.coalesce(topic, F.lit("")))
    own = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3)
    sets = []
    for name, words in TOPIC_WORDS.items():
        hit = low.contains(name)
        for w in words:
            hit = hit | low.contains(w)
        sets.append(F.when(hit, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(own, *sets))


def question_pass(questions: DataFrame, paper_words: DataFrame) -> DataFrame:
    q = questions.select("question_id", question_words(F.col("topic")).alias("keywords"))
    return keyword_matches(q, paper_words, "question_id", "paper_id")


def synced(registry: DataFrame, *passes: DataFrame) -> DataFrame:
    """The registry with the passes' columns; papers that the registry lacks are not added."""
    out = registry
    for p in passes:
        new = [c for c in p.columns if c != "paper_id"]
        out = out.drop(*(c for c in new if c in out.columns)).join(p, "paper_id", "left")
    return out


def pass_summary(source: DataFrame, after: DataFrame, columns: list[str], least: float) -> DataFrame:
    """One row: source papers that the registry knows (eligible), those filled after the pass (synced), those it lacks, and the verdict.

    ``source`` names the papers that the pass has something for, ``after`` is
    the registry after the pass; a paper is synced if any of ``columns`` is
    filled there. The pass holds if synced reaches ``least`` of eligible.
    """
    known = after.groupBy("paper_id").agg(F.bool_or(any_filled(after, columns)).alias("__filled"))
    rows = source.select("paper_id").where(F.col("paper_id").isNotNull()).distinct().join(known, "paper_id", "left")
    filled_ = F.col("__filled")
    counts = rows.agg(F.count_if(filled_.isNotNull()).alias("eligible"), F.count_if(filled_).alias("synced"), F.count_if(filled_.isNull()).alias("skipped"))
    return counts.withColumn("passed", F.col("synced") >= least * F.col("eligible"))


def verified(registry: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_filled, n_papers), and for 'all_empty' the papers with none of the columns."""
    none = ~F.lit(False)
    for c in columns:
        none = none & ~filled(registry, c)
    row = registry.agg(F.count("*").alias("n"), F.count_if(none).alias("all_empty"), *(F.count_if(filled(registry, c)).alias(f"c_{c}") for c in columns))
    return row.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("n_filled")) for c in columns), F.struct(F.lit("all_empty").alias("column"), F.col("all_empty").alias("n_filled")))).alias("x")).select("x.column", "x.n_filled", F.col("n").alias("n_papers"))


def blank_papers(df: DataFrame) -> DataFrame:
    return df.where(present(F.col("paper_id")).isNull())

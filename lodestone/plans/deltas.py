"""Backward sync by changes: signed rows of beliefs, constraints and edges move the counts of the papers that they touch.

The state is a table of tallies with multiplicities, so that a retraction can
take back exactly what a row brought: a node of a paper goes when its last
edge goes. Sums of signed rows commute, so change sets may come in any order
and be split in any way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.joins import paper_of

KEY = ("kind", "paper_id", "item")


def signed(rows: DataFrame, retracted: DataFrame | None = None) -> DataFrame:
    """Rows with ``sign`` 1, and those of ``retracted`` with -1."""
    out = rows.withColumn("sign", F.lit(1).cast("long"))
    return out if retracted is None else out.unionByName(retracted.withColumn("sign", F.lit(-1).cast("long")))


def tallies(beliefs: DataFrame, constraints: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, paper_id, item, n) of signed rows; rows that cancel are left out.

    ``beliefs``: belief_id, paper_id, warrant_status; ``constraints``:
    source_id, target_id (beliefs); ``edges``: source, target, paper_ids (a JSON
    list; malformed ones drop out). All with ``sign``.
    """

    def part(df: DataFrame, kind: str, paper: Column, item: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), paper.cast("string").alias("paper_id"), item.cast("string").alias("item"), "sign")

    none = F.lit(None)
    owned = beliefs.where(F.col("paper_id").isNotNull())
    ends = constraints.select("sign", F.explode(F.array("source_id", "target_id")).alias("belief_id")).where(F.coalesce("belief_id", F.lit("")) != "")
    touched = F.filter(F.array_distinct(F.array(paper_of(F.col("source_id")), paper_of(F.col("target_id")))), lambda x: x.isNotNull())
    listed = edges.select("sign", "source", "target", F.explode(F.from_json("paper_ids", "array<string>")).alias("paper_id"))
    nodes = listed.select("sign", "paper_id", F.explode(F.array("source", "target")).alias("node")).where("node is not null")
    parts = [
        part(owned, "belief", F.col("paper_id"), F.col("belief_id")),
        part(owned.where("warrant_status is not null"), "warrant", F.col("paper_id"), F.col("warrant_status")),
        part(ends, "end", none, F.col("belief_id")),
        part(constraints.select("sign", F.explode(touched).alias("paper_id")), "constraint", F.col("paper_id"), none),
        part(listed, "edge", F.col("paper_id"), none),
        part(nodes, "node", F.col("paper_id"), F.col("node")),
    ]
    return reduce(DataFrame.union, parts).groupBy(*KEY).agg(F.sum("sign").alias("n")).where("n <> 0")


def _same(state: str, change: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{state}.{c}").eqNullSafe(F.col(f"{change}.{c}")) for c in KEY))


def moved(state: DataFrame, change: DataFrame) -> DataFrame:
    """The tallies after a change: rows with a changed key are summed, the others pass as they are. A tally below zero is owed."""
    s, c = state.alias("s"), change.alias("c")
    rest, hit = s.join(c, _same("s", "c"), "left_anti"), s.join(c, _same("s", "c"), "left_semi")
    return rest.unionByName(hit.unionByName(change).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0"))


def touched_papers(state: DataFrame, change: DataFrame) -> DataFrame:
    """(paper_id): papers that a change names, and those with a belief whose constraint ends it changes."""
    ends = change.where("kind = 'end'").select("item")
    holders = state.where("kind = 'belief'").join(ends, "item", "left_semi").select("paper_id")
    return change.where("kind <> 'end'").select("paper_id").union(holders).where("paper_id is not null").distinct()


def paper_counts(state: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Per paper what the belief, constraint and edge passes give, from tallies; for the given papers alone if there are any."""
    rows = state.where("n > 0 and kind <> 'end'")
    if papers is not None:
        rows = rows.join(papers, "paper_id", "left_semi")
    ends = state.where("n > 0 and kind = 'end'").select(F.lit("belief").alias("kind"), "item", F.col("n").alias("n_ends"))
    rows = rows.join(ends, ["kind", "item"], "left")
    of = lambda kind: F.col("kind") == kind
    return rows.groupBy("paper_id").agg(
        F.count_if(of("belief")).alias("n_beliefs"), F.array_sort(F.collect_set(F.when(of("warrant"), F.col("item")))).alias("warrant_types"),
        F.coalesce(F.sum(F.when(of("belief"), F.col("n") * F.col("n_ends"))), F.lit(0)).alias("n_en_constraints"),
        F.coalesce(F.sum(F.when(of("constraint"), F.col("n"))), F.lit(0)).alias("n_constraints_from_paper"),
        F.coalesce(F.sum(F.when(of("edge"), F.col("n"))), F.lit(0)).alias("n_bn_edges"), F.array_sort(F.collect_set(F.when(of("node"), F.col("item")))).alias("bn_nodes"),
    )


def resynced(counts: DataFrame, state: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, state) after a change: the touched papers' counts are made anew from the tallies, the others stay.

    Papers that lose their last row go. Write both (``sinks.published``) before
    the next change.
    """
    after = moved(state, change)
    papers = touched_papers(state.unionByName(change), change)
    return counts.join(papers, "paper_id", "left_anti").unionByName(paper_counts(after, papers)), after

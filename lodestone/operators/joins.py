"""Joins with the forms that evidence tables need: lookups, anti-joins, groupwise maxima, endpoints and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join on unique keys; misses take defaults. Spark broadcasts the table where its size allows."""
    out = df.join(table, on, "left")
    return out.fillna(defaults) if defaults else out


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order (state an input ordinal to make it total)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def best_confidence(df: DataFrame, keys: list[str], confidence: str, ordinal: str) -> DataFrame:
    """The row of the highest confidence per key; of equal ones the later."""
    return first_per_key(df, keys, F.desc_nulls_last(confidence), F.desc(ordinal))


def latest(df: DataFrame, keys: list[str], when: str, ties: bool = True) -> DataFrame:
    """Rows of the latest time per key: all of them, or with ``ties=False`` one (the least of the whole row)."""
    w = Window.partitionBy(*keys)
    if ties:
        return df.withColumn("__m", F.max(when).over(w)).where(F.col(when) == F.col("__m")).drop("__m")
    return first_per_key(df, keys, F.desc_nulls_last(when), *(F.col(c) for c in df.columns if c not in (*keys, when)))


def semi(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids, on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a match; unlike NOT IN, nulls in ``ids`` do not empty the result."""
    return df.join(ids, on, "left_anti")


def left_where(a: DataFrame, b: DataFrame, on: Column, also: Column) -> DataFrame:
    """A left join whose extra predicate stands in ON, so that unmatched rows stay."""
    return a.join(b, on & also, "left")


def with_constant(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row table: an aggregate without keys has one row by definition, so it may be broadcast."""
    return df.crossJoin(F.broadcast(totals.limit(1)))


def by_name(df: DataFrame, table: DataFrame, name: str, table_name: str) -> DataFrame:
    """Left join on names without regard to case; of the table's rows that share a name one stays, the greatest row."""
    known = table.withColumn("__k", F.lower(F.coalesce(F.col(table_name).cast("string"), F.lit(""))))
    last = known.groupBy("__k").agg(F.max(F.struct(*table.columns)).alias("__row")).select("__k", "__row.*")
    rest = [c for c in table.columns if c not in df.columns]
    return df.withColumn("__k", F.lower(F.coalesce(F.col(name), F.lit("")))).join(last.select("__k", *rest), "__k", "left").drop("__k")


def single_value(df: DataFrame, table: DataFrame, on: list[str], value: str) -> DataFrame:
    """A scalar lookup: the value of the key's row; null without one, an error if a key has several."""
    one = table.groupBy(*on).agg(F.count("*").alias("__n"), F.first(value).alias(value))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("a key has several rows"))).otherwise(F.col(value))
    return df.join(one.select(*on, checked.alias(value)), on, "left")


def missing_pairs(left: DataFrame, right: DataFrame, group: list[str], present: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of the sides that agree in ``group`` (a keyed join, such as an offering) and are not present."""
    return left.join(right, group).join(present.select(*keys).distinct(), keys, "left_anti")


def endpoints(edges: DataFrame, nodes: DataFrame, node_id: str, columns: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """Edges with the columns of both end nodes, prefixed; ends without a node stay null."""
    def side(end: str) -> DataFrame:
        return nodes.select(F.col(node_id).alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))

    return edges.join(side(source), source, "left").join(side(target), target, "left")


def paper_of(belief: Column) -> Column:
    """The paper that a belief id names: 'X_MPX_n' or 'bel_X_V5_n'; null otherwise."""
    parts = F.split(belief, "_V5_")
    v5 = F.when(belief.startswith("bel_") & (F.size(parts) == 2), F.replace(F.get(parts, 0), F.lit("bel_"), F.lit("")))
    return F.when(belief.contains("_MPX_"), F.substring_index(belief, "_MPX_", 1)).otherwise(v5)


def keyword_matches(questions: DataFrame, papers: DataFrame, question_id: str, paper_id: str, keywords: str = "keywords") -> DataFrame:
    """(paper, n, question ids): a question and a paper match if they share a keyword; joined by keyword, never all pairs."""
    q = questions.select(question_id, F.explode(F.array_distinct(keywords)).alias("k"))
    p = papers.select(paper_id, F.explode(F.array_distinct(keywords)).alias("k"))
    hits = q.join(p, "k").select(question_id, paper_id).distinct()
    return hits.groupBy(paper_id).agg(F.count("*").alias("n_references"), F.array_sort(F.collect_list(question_id)).alias("question_ids"))

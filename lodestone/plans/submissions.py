"""Article intake: validation, duplicate cascade, states, ids and an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rules import article_type
from lodestone.functions.text import sequential_id
from lodestone.operators.dedup import earlier_matches
from lodestone.operators.ordering import numbered
from lodestone.scratch import scratch, written

_FIELDS = ("pdf_hash", "doi", "title", "authors")


def staged(new: DataFrame, known: DataFrame, ordinal: str = "ordinal", prefix: str = "ART-") -> DataFrame:
    """New articles in their order, with ids, a type, and a state.

    'rejected' where a file is there but not valid, 'duplicate' where the
    cascade hits a known article or one of those before it in the batch (a
    known one first, by id; then the earliest), else 'staged'; ``match_id`` names the
    hit. Every earlier row counts, whatever its state, a rejected one by its
    hash alone. Ids go on from the greatest number that ends a known id.
    Columns of ``new``: ordinal, pdf_hash, pdf_valid (boolean, null without a
    file), doi, title, authors, abstract. ``known``: article_id, pdf_hash, doi,
    title, authors.
    """
    spark = new.sparkSession
    valid = F.coalesce("pdf_valid", F.lit(True))
    held = numbered(known.select("article_id", *_FIELDS), "place", F.col("article_id"))
    last = F.coalesce(F.max(F.regexp_extract("article_id", r"(\d{1,18})$", 1).try_cast("long")), F.lit(0))
    counts = known.agg(F.count("*").alias("held"), last.alias("last"))
    rows = numbered(new, "n", F.col(ordinal)).crossJoin(F.broadcast(counts)).withColumn("article_id", sequential_id(prefix, F.col("last"), F.col("n")))
    rows = written(rows.withColumn("place", F.col("held") + F.col("n")), scratch(spark, "intake"))
    fields = [F.when(valid, F.col(c)).alias(c) if c in ("doi", "title") else F.col(c) for c in _FIELDS]
    batch = rows.select("article_id", "place", *fields, valid.alias("asks"))
    both = written(held.withColumn("asks", F.lit(False)).unionByName(batch), scratch(spark, "intake-order"))
    hits = earlier_matches(both, "place", F.col("asks"))
    hits = hits.join(both.select(F.col("place").alias("match"), F.col("article_id").alias("match_id")), "match").drop("match")
    kind = article_type(F.concat_ws(" ", "title", "abstract"))
    out = rows.join(hits, "place", "left").withColumns({"article_type": kind["label"], "type_confidence": kind["confidence"]})
    state = F.when(~valid, "rejected").when(F.col("match_id").isNotNull(), "duplicate").otherwise("staged")
    return out.withColumn("status", state).drop("n", "held", "last", "place")


def decided(staged_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Staged rows take a decision (accepted or rejected); other rows and other decisions change nothing."""
    d = decisions.where(F.col("decision").isin("accepted", "rejected")).groupBy("article_id").agg(F.max_by("decision", "decided_at").alias("decision"))
    move = (F.col("status") == "staged") & F.col("decision").isNotNull()
    return staged_.join(d, "article_id", "left").withColumn("status", F.when(move, F.col("decision")).otherwise(F.col("status"))).drop("decision")


def log_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows for an append-only log: what changed its status."""
    a = before.select("article_id", F.col("status").alias("old"))
    return after.select("article_id", F.col("status").alias("new")).join(a, "article_id", "left").where(~F.col("old").eqNullSafe(F.col("new"))).select("article_id", F.concat_ws("->", F.coalesce("old", F.lit("received")), "new").alias("action"))


def my_submissions(articles: DataFrame, user: str, status: str | None = None) -> DataFrame:
    rows = articles.where(F.col("submitter_id") == user)
    return rows.where(F.col("status") == status) if status else rows

"""Duplicate detection for articles: exact hash, exact DOI, then titles within a word or within each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.matching import duplicate_kind, match_confidence, titles_match
from lodestone.functions.text import normalised, tokens
from lodestone.operators.lexicon import least_held, least_holder
from lodestone.scratch import scratch, written


def exact_groups(df: DataFrame, key: str, text: Column, kept: str = "keep_id") -> DataFrame:
    """(key, hash, keep_id, n): rows of equal content, of which the lowest key stays.

    Sums and minima meet by hash with map-side combination; the rows get them
    by a join, which adaptive execution splits where one content is hot.
    """
    rows = df.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"))
    groups = rows.groupBy("hash").agg(F.min(key).alias(kept), F.count("*").alias("n"))
    return rows.join(groups, "hash").select(key, "hash", kept, "n")


_BASE = 0x9E3779B97F4A7C15
_SEEDS = ("lodestone-first-", "lodestone-second")


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each list: a 128-bit hash of the whole (pos -1), and of the list without each of its words (pos from 0)."""
    for batch in batches:
        row, pos, sides = [], [], ([], [])
        for number, words in enumerate(batch["w"].to_pylist()):
            n = len(words)
            row.append(np.full(n + 1, number))
            pos.append(np.arange(-1, n))
            held = np.array(words, dtype=object)
            for seed, out in zip(_SEEDS, sides, strict=True):
                hashes = pd.util.hash_array(held, hash_key=seed, categorize=False)
                power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))), dtype=np.uint64)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)))
                without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(_BASE, -1, 2**64))
                out.append(np.concatenate((sums[-1:], without)))
        take = pa.array(np.concatenate(row) if row else [], pa.int64())
        longs = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in sides]
        at = np.concatenate(pos).astype(np.int32) if pos else np.zeros(0, np.int32)
        yield pa.record_batch({"lo": batch["lo"].take(take), "pos": pa.array(at), "a": pa.array(longs[0]), "b": pa.array(longs[1])})


def _gap_rows(lists: DataFrame) -> DataFrame:
    """(lo, pos, a, b) of lists (lo, w): two lists are one substitution apart if they share the hash without a word at one place, one insertion if one's whole hash is the other's without a word."""
    kind = lists.schema["lo"].dataType.simpleString()
    return lists.select("lo", "w").mapInArrow(_gaps, f"lo {kind}, pos int, a long, b long")


def _half_keys(w: Column) -> Column:
    """Four keys of a list such that lists one word apart share one: an edit leaves one half of the shorter list as it is.

    Halves of a list of the same length, and of a list one word shorter.
    """
    n = F.size(w)

    def halves(m: Column) -> list[Column]:
        first = F.floor(m / 2).cast("int")
        head, tail = F.slice(w, F.lit(1), first), F.slice(w, n - (m - first) + 1, m - first)
        return [F.struct(m.alias("m"), F.lit(i).alias("half"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g")) for i, x in enumerate((head, tail))]

    return F.array(*halves(n), *halves(n - 1))


def within_one_word(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, match): for each row the smallest other key whose word list is at most one word edit away.

    Lists of at least three words. Equal lists collapse to one first; then only
    lists that share half of their words with another go on, so a unique text
    costs six hashes. Matches are minima of groups of equal hashes (128 bits):
    no pairs are made, however many lists lie one word apart.
    """
    spark = df.sparkSession
    lists_of = lambda d: d.select(F.col(key).alias("id"), tokens(text).alias("w")).where(F.size("w") >= 3).withColumns({"h": F.xxhash64("w"), "g": F.xxhash64("w", F.lit(1))})
    # Word lists stay where they are read: hashes stand for them, written once, as several plans need them.
    rows = written(lists_of(df).select("id", "h", "g", _half_keys(F.col("w")).alias("keys")), scratch(spark, "word-lists"))
    lists = rows.groupBy("h", "g").agg(F.min("id").alias("lo"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    keyed = lists.select("lo", "h", "g", F.explode("keys").alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    asked = keyed.join(shared, "k").select(F.col("lo").alias("id"), "h", "g").distinct()
    texts = lists_of(df.join(asked.select(F.col("id").alias(key)).distinct(), key, "left_semi")).join(asked, ["id", "h", "g"], "left_semi")
    gaps = _gap_rows(texts.dropDuplicates(["id", "h", "g"]).select(F.col("id").alias("lo"), "w"))
    gone, whole = gaps.where("pos >= 0"), gaps.where("pos < 0")
    # Of a place's group the two smallest: a list takes the smallest that it is not itself.
    least = gone.groupBy("a", "b", "pos").agg(F.min("lo").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = gone.join(least, ["a", "b", "pos"])
    second = members.where("lo <> first").groupBy("a", "b", "pos").agg(F.min("lo").alias("second"))
    first_ones = least.join(second, ["a", "b", "pos"]).select(F.col("first").alias("lo"), F.col("second").alias("near"))
    others = members.where("lo <> first").select("lo", F.col("first").alias("near"))
    shorter = whole.select("a", "b", F.col("lo").alias("whole"))
    longer = gone.groupBy("a", "b").agg(F.min("lo").alias("near")).join(shorter, ["a", "b"]).select(F.col("whole").alias("lo"), "near")
    inner = gone.join(shorter, ["a", "b"]).select("lo", F.col("whole").alias("near"))
    near = first_ones.union(others).union(longer).union(inner).groupBy("lo").agg(F.min("near").alias("near"))
    out = rows.join(lists.select("h", "g", "lo", "n"), ["h", "g"]).join(near, "lo", "left")
    # Among equal lists the lowest key, or for that key itself the next row of its list.
    again = rows.join(lists.where("n > 1").select("h", "g", "lo"), ["h", "g"]).where("id <> lo").groupBy("lo").agg(F.min("id").alias("again"))
    equal = F.when(F.col("id") == F.col("lo"), F.col("again")).otherwise(F.col("lo"))
    out = out.join(again, "lo", "left").withColumn("match", F.least(equal, "near"))
    return out.where("match is not null").select(F.col("id").alias(key), F.col("match"))


def _one_edit(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(t, id): titles (t, lo) of ``held`` at most one word from those of ``asked``, both of three words at least: the least id of each kind."""
    lists = lambda d, lo: d.select(F.col(lo).alias("lo"), F.split("t", " ").alias("w")).where(F.size("w") >= 3)
    mine, theirs = _gap_rows(lists(asked, "t")), _gap_rows(lists(held, "lo"))
    place = theirs.where("pos >= 0").groupBy("a", "b", "pos").agg(F.min("lo").alias("id"))
    any_place = theirs.where("pos >= 0").groupBy("a", "b").agg(F.min("lo").alias("id"))
    same = mine.where("pos >= 0").join(place, ["a", "b", "pos"])
    longer = mine.where("pos < 0").join(any_place, ["a", "b"])
    shorter = mine.where("pos >= 0").join(theirs.where("pos < 0").select("a", "b", F.col("lo").alias("id")), ["a", "b"])
    return same.select("lo", "id").union(longer.select("lo", "id")).union(shorter.select("lo", "id")).withColumnRenamed("lo", "t")


def _title_matches(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(t, match): for each title of ``asked`` (t, distinct) the least ``lo`` of the titles of ``held`` (t distinct, lo) that match it.

    Equal, one word apart, or one inside the other. Every kind costs a title a
    row, however many others match it.
    """
    equal = asked.join(held, "t").select("t", F.col("lo").alias("id"))
    texts = held.select(F.col("t").alias("text"), F.col("lo").alias("id"))
    inside = least_holder(texts, asked.select(F.col("t").alias("pattern"))).select(F.col("pattern").alias("t"), "id")
    around = least_held(asked.select(F.col("t").alias("text")), texts.withColumnRenamed("text", "pattern")).select(F.col("text").alias("t"), "id")
    return equal.union(_one_edit(asked, held)).union(inside).union(around).groupBy("t").agg(F.min("id").alias("match"))


_FIELDS = ("pdf_hash", "doi", "title", "authors")


def _cascade(n: DataFrame, k: DataFrame) -> DataFrame:
    """(id, match_id, tier): by hash, DOI and title the least match_id of ``k`` (match_id, k_...) for rows of ``n`` (id, ...)."""
    tier = lambda d, number: d.select("id", "match_id", F.lit(number).alias("tier"))
    least = lambda d, c: d.groupBy(c.alias("value")).agg(F.min("match_id").alias("match_id"))
    hashes = least(k.where("k_pdf_hash is not null"), F.col("k_pdf_hash"))
    by_hash = n.join(hashes, F.col("pdf_hash") == F.col("value"))
    doi = F.nullif(F.lower(F.btrim("doi")), F.lit(""))
    by_doi = n.withColumn("d", doi).join(least(k.where("k_doi is not null"), F.lower("k_doi")), F.col("d") == F.col("value"))
    titled = n.where(F.length(F.btrim("title")) > 10).select("id", normalised(F.col("title")).alias("t")).where("t <> ''")
    held = k.select("match_id", normalised(F.col("k_title")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("match_id").alias("lo"))
    by_title = titled.join(_title_matches(titled.select("t").distinct(), held), "t").withColumnRenamed("match", "match_id")
    return tier(by_hash, 1).union(tier(by_doi, 2)).union(tier(by_title, 3))


def _described(found: DataFrame, n: DataFrame, k: DataFrame) -> DataFrame:
    """(id, match_id, match_type, confidence): the first tier of each id, and how strong the match is."""
    first = found.groupBy("id").agg(F.min(F.struct("tier", "match_id")).alias("x")).select("id", "x.tier", "x.match_id")
    found = first.join(n.select("id", "title", "authors"), "id").join(k, "match_id")
    by_words = duplicate_kind(titles_match(F.col("title"), F.col("k_title")), F.col("authors"), F.col("k_authors"))
    kind = F.when(F.col("tier") == 1, "exact_hash").when(F.col("tier") == 2, "exact_doi").otherwise(by_words)
    out = found.withColumn("match_type", kind)
    return out.select("id", "match_id", "match_type", match_confidence(F.col("match_type")).alias("confidence"))


def duplicate_cascade(new: DataFrame, known: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, match_id, match_type, confidence): the first tier that hits decides; in a tier the lowest known id.

    Columns of both: key (unique), pdf_hash, doi, title, authors. The title
    tier asks only rows whose trimmed title has over ten characters. Equal
    hashes, DOIs and titles meet as one row each; titles one word apart by
    hashes without a word; a title inside another by automata over the titles.
    """
    n = new.select(F.col(key).alias("id"), *_FIELDS)
    k = known.select(F.col(key).alias("match_id"), *(F.col(c).alias(f"k_{c}") for c in _FIELDS))
    return _described(_cascade(n, k), n, k).withColumnRenamed("id", key)


def earlier_matches(rows: DataFrame, order: str, asks: Column) -> DataFrame:
    """(order, match, match_type, confidence): for each row that asks its earliest match among the rows before it.

    ``order`` is a unique long; columns as for ``duplicate_cascade``. Tiers come
    first, as there: a row takes the earliest earlier row of equal hash, else of
    equal DOI, else of a matching title. No row meets another: the least place
    of each hash, DOI, title and title without a word tells whether there is an
    earlier one, and which is the earliest. Rows with null hash, DOI and title
    match nothing.
    """
    n = rows.where(asks).select(F.col(order).alias("id"), *_FIELDS)
    k = rows.select(F.col(order).alias("match_id"), *(F.col(c).alias(f"k_{c}") for c in _FIELDS))
    out = _described(_cascade(n, k).where("match_id < id"), n, k)
    return out.withColumnsRenamed({"id": order, "match_id": "match"})

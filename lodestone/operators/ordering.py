"""Ranks, top-k, percentiles, sampling, paging and validators of order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.collections import rounded
from lodestone.scratch import scratch, written


def _joined(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on key columns in which nulls are equal; the keys come from ``df``, the other columns from both."""
    other = table.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    return df.join(other, same, how).drop(*(f"__key_{k}" for k in keys))


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """The rows in ranges of the order, written once with ``__at``: the range in its upper bits, the place in it below.

    The numbers stand in files, so every later reader sees the same ones,
    whatever adaptive execution does to a plan and whatever runs again.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_.withColumn("__at", F.monotonically_increasing_id()), scratch(spark, "ranged"))


def _before(ranged: DataFrame, amount: Column) -> DataFrame:
    """(__p, __b): for each range the sum over the ranges before it. A row a range, so one window over them is small."""
    sums = ranged.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.sum(amount).alias("__s"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__p", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__b"))


def running_total(df: DataFrame, amount: str, name: str, *order: Column) -> DataFrame:
    """The sum of ``amount`` (a long) up to each row of a total order, without a task that sees all rows."""
    ranged = _ranged(df, *order)
    parts = ranged.withColumn("__p", F.shiftright("__at", 33))
    inner = Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parts.withColumn("__i", F.sum(amount).over(inner))
    return inside.join(_before(ranged, F.col(amount)), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b", "__at")


def counted_values(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, upto, total): each distinct value of a group, its rows, the rows up to it, and the group's rows.

    Null values are left out; null group keys are a group. Values are counted
    with map-side combination, and the counts summed over ranges of (by, value),
    so neither a hot group nor a table without groups lands in one task.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = running_total(counts, "n", "__upto", *(F.col(c) for c in (*by, value)))
    groups = upto.groupBy(*by).agg(F.min(F.col("__upto") - F.col("n")).alias("__start"), F.sum("n").alias("total"))
    joined = _joined(upto, groups, by) if by else upto.crossJoin(F.broadcast(groups))
    return joined.select(*by, value, "n", (F.col("__upto") - F.col("__start")).alias("upto"), "total")


def percentile_rank(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """100 times the share of rows at or below, to one decimal as SQL rounds it; null for a null value.

    Values are counted first (``counted_values``) and the rows get their
    value's rank by a join.
    """
    by = by or []
    ranked = counted_values(df, value, by).withColumn("percentile", rounded(100.0 * (F.col("upto") / F.col("total")), 1)).drop("n", "upto", "total")
    return _joined(df, ranked, [*by, value], "left")


def top_per_group(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_top(df: DataFrame, by: list[str], score: str, share: float, floor: float | None = None, k: int | None = None, tie: list[str] = ()) -> DataFrame:
    """Rows of at least ``share`` of their group's best score (and ``floor``), at most k."""
    best = F.max(score).over(Window.partitionBy(*by))
    bar = F.greatest(F.lit(floor), share * best) if floor is not None else share * best
    out = df.where(F.col(score).isNotNull()).withColumn("__bar", bar).where(F.col(score) >= F.col("__bar")).drop("__bar")
    return top_per_group(out, by, k, F.desc(score), *map(F.col, tie)) if k else out


def share_of_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value over its group's greatest; 0 where that is 0."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn("share", F.when(top > 0, F.col(value) / top).otherwise(0.0))


def by_rank(c: Column, names: list[str]) -> Column:
    """A sort key: the place in a list, unknown values last."""
    return F.coalesce(*(F.when(c == n, F.lit(i)) for i, n in enumerate(names)), F.lit(len(names)))


def last_if(condition: Column) -> Column:
    """A sort key that puts rows of a condition last."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def page(df: DataFrame, size: int, offset: int, *order: Column) -> tuple[DataFrame, int]:
    """A page under a total order, and the number of all rows."""
    return df.orderBy(*order).offset(offset).limit(size), df.count()


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A number from 1 in the order, which must be total to be repeatable.

    Rows are written once in ranges of the order with their place in the
    range; the ranges' counts (not the rows) are summed up and join the rows.
    """
    ranged = _ranged(df, *order)
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    parts = ranged.withColumns({"__p": F.shiftright("__at", 33), "__i": place})
    before = _before(ranged, F.lit(1))
    return parts.join(before, "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b", "__at")


def seeded(seed: int, *key: str) -> Column:
    """A number of a row that is as good as random and the same for a seed everywhere: a hash of its key, as hexadecimal text."""
    return F.md5(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key), F.lit(str(seed))))


def sampled(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows at random, the same for a seed whatever the partitioning: those of the smallest seeded hashes."""
    return df.orderBy(seeded(seed, *key), *key).limit(n)


def audit_sample(df: DataFrame, by: list[str], rate: float, seed: int, key: str) -> DataFrame:
    """From each stratum max(1, floor(n * rate)) rows: those of the smallest seeded hashes.

    The hash up to which a stratum's rows belong to its sample comes from
    counts over ranges of hashes, so no task sees a stratum; rows then pass or
    not on their own. Only rows of the very hash at which a sample ends (one
    key's) are ranked, by key. Null strata are a stratum.
    """
    rows = df.withColumn("__h", seeded(seed, key))
    counts = counted_values(rows.select(*by, "__h"), "__h", by)
    wanted = F.greatest(F.lit(1), F.floor(F.col("total") * rate)).cast("long")
    last = counts.withColumn("__want", wanted).where(F.col("upto") >= F.col("__want")).groupBy(*by).agg(F.min(F.struct("__h", (F.col("__want") - F.col("upto") + F.col("n")).alias("room"))).alias("__last"))
    met = _joined(rows, last, by) if by else rows.crossJoin(F.broadcast(last))
    inside = met.where(F.col("__h") < F.col("__last.__h"))
    edge = met.where(F.col("__h") == F.col("__last.__h")).withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__h").orderBy(key)))
    edge = edge.where(F.col("__r") <= F.col("__last.room")).drop("__r")
    return inside.unionByName(edge).drop("__h", "__last")


def longest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc(F.length(key)), key)


def descending(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(group, ok): whether the values never rise along the order."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__b", before).groupBy(*by).agg(F.coalesce(F.bool_and(F.coalesce(F.col("__b") >= F.col(value), F.lit(True))), F.lit(True)).alias("ok"))


def unique(df: DataFrame, columns: list[str]) -> Column:
    """Whether the columns identify rows; an aggregate."""
    return F.count_distinct(F.struct(*columns)) == F.count("*")


def within(c: Column, least: float, most: float) -> Column:
    """Whether the mean is in a range; an aggregate."""
    return F.avg(c).between(least, most)


def matching(c: Column, pattern: str) -> Column:
    """How many values match; an aggregate."""
    return F.count_if(c.rlike(pattern))

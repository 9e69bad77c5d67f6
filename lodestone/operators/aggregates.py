"""Aggregates: tallies, pivots, coverage, histograms, degrees, statistics and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.collections import half_open_bin
from lodestone.operators.filters import filled
from lodestone.operators.graphs import components
from lodestone.operators.ordering import counted_values


def summary(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, mean, median, upper median, min and max; without values they are 0.

    Medians are read off counted values (``counted_values``), so no task holds
    a group's values. The upper median is the one at n // 2 from 0.
    """
    by, v = list(by), F.col(value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = df.groupBy(*by).agg(F.count(v).alias("n"), zero(F.avg(v)).alias("mean"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(value)))
    low, high = at(F.floor((F.col("total") + 1) / 2)), at(F.floor(F.col("total") / 2) + 1)
    middle = counted_values(df, value, by).groupBy(*by).agg(((low + high) / 2).alias("median"), high.alias("upper_median"))
    middle = middle.withColumnsRenamed({c: f"__{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))
    both = base.join(middle, same, "left") if by else base.crossJoin(F.broadcast(middle))
    return both.select(*by, "n", "mean", zero("median").alias("median"), zero("upper_median").alias("upper_median"), "min", "max")


def in_row_order(df: DataFrame, by: list[str], **of_group: Column) -> DataFrame:
    """The rows of a Parquet table with sums or means of their group's doubles, added up in the order of the table's rows.

    A sum of doubles changes with the order of its terms, and in an aggregate
    that order is the one in which partitions meet. Here a group's rows are
    sorted by file and place in the file, and a window (which spills) adds them.
    """
    w = Window.partitionBy(*by).orderBy("__file", "__row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = df.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    return placed.withColumns({name: c.over(w) for name, c in of_group.items()}).drop("__file", "__row")


def status_totals(df: DataFrame, by: list[str], status: Column, values: list[str], amount: Column) -> DataFrame:
    """A sum per status as columns, and the total; groups without rows in a status have 0."""
    return df.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(status == v, amount)), F.lit(0.0)).alias(f"{v}_total") for v in values), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))


def tally(df: DataFrame, statuses: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: a counter for each value of each status column, and the number of rows."""
    counters = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, vs in statuses.items() for v in vs]
    return df.agg(F.count("*").alias("total"), *counters)


def most_common(df: DataFrame, by: list[str], value: str, ordinal: str, k: int) -> DataFrame:
    """The k most frequent values per group; ties go to the value seen first."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__first")


def nested(df: DataFrame, by: list[str], columns: list[str], name: str = "items") -> DataFrame:
    """Group to a sorted array of structs."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def sorted_set(c: str | Column) -> Column:
    return F.array_sort(F.collect_set(c))


def heat_map(df: DataFrame, row: str, column: str, amount: Column) -> DataFrame:
    """(row, column, value, intensity): intensity is log1p(value) over the table's greatest log1p.

    The greatest value is a one-row aggregate, so no window gathers the table in one task.
    """
    cells = df.groupBy(row, column).agg(F.sum(amount).alias("value"))
    top = cells.agg(F.max("value").alias("__top"))
    return cells.crossJoin(F.broadcast(top)).select(row, column, "value", F.when(F.col("__top") > 0, F.log1p("value") / F.log1p("__top")).otherwise(0.0).alias("intensity"))


def pivoted(df: DataFrame, row: str, column: str, values: list, amount: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.sum(amount))


def both_ways(df: DataFrame, a: str, b: str, amount: Column) -> DataFrame:
    """Sums and sorted members of a by b and of b by a, largest first in each direction."""
    def one(x: str, y: str) -> DataFrame:
        return df.groupBy(F.col(x).cast("string").alias("key")).agg(F.sum(amount).alias("total"), sorted_set(F.col(y).cast("string")).alias("members")).select(F.lit(f"{x} by {y}").alias("direction"), "key", "total", "members")

    return one(a, b).union(one(b, a)).orderBy("direction", F.desc("total"), "key")


def prefix_totals(df: DataFrame, key: str, groups: dict[str, str], amount: Column) -> DataFrame:
    """Sums by the group whose prefix the key has, else 'other'."""
    group = F.coalesce(*(F.when(F.col(key).startswith(p), g) for p, g in groups.items()), F.lit("other"))
    return df.groupBy(group.alias("group")).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def two_level_rollup(df: DataFrame, outer: str, inner: str, member: str) -> DataFrame:
    """(level, key, n_additive, n_distinct): members summed over the inner groups, and counted once."""
    pairs = df.groupBy(outer, inner).agg(F.count_distinct(member).alias("n"))
    additive = pairs.groupBy(outer).agg(F.sum("n").alias("n_additive"))
    distinct = df.groupBy(outer).agg(F.count_distinct(member).alias("n_distinct"))
    return additive.join(distinct, outer)


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    return df.select(half_open_bin(F.col(value), edges).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def numeric_profile(df: DataFrame, column: str, least: float, most: float) -> DataFrame:
    """One row: values that are numbers in range, out of range, not numbers, and missing, with mean, min and max of the good."""
    text = F.col(column).cast("string")
    v = text.try_cast("double")
    good = v.between(least, most)
    shown = F.when(good, v)
    return df.agg(
        F.count_if(good).alias("n_good"), F.count_if(v.isNotNull() & ~good).alias("n_out_of_range"), F.count_if(v.isNull() & (F.coalesce(text, F.lit("")) != "")).alias("n_not_numeric"),
        F.count_if(F.coalesce(text, F.lit("")) == "").alias("n_missing"), F.avg(shown).alias("mean"), F.min(shown).alias("min"), F.max(shown).alias("max"),
    )


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, pct): rows with a filled value, one pass, a row a column."""
    counts = df.agg(F.count("*").alias("__all"), *(F.count_if(filled(df, c)).alias(c) for c in columns))
    long = counts.select("__all", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("x"))
    return long.select("x.column", "x.n", F.when(F.col("__all") > 0, F.bround(100.0 * F.col("x.n") / F.col("__all"), 1)).otherwise(0.0).alias("pct"))


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """How many edge ends touch each node; null ends do not count."""
    return edges.select(F.explode(F.array(source, target)).alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def participation(edges: DataFrame, ends: list[Column]) -> DataFrame:
    """How many edges touch each key; an edge that touches a key twice counts once."""
    keys = F.filter(F.array_distinct(F.array(*ends)), lambda x: x.isNotNull())
    return edges.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n_edges"))


def edges_by_paper(edges: DataFrame, papers: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges whose JSON list of papers is exploded: count and sorted nodes for each paper. Malformed lists drop out."""
    rows = edges.select(F.explode(F.from_json(papers, "array<string>")).alias("paper_id"), source, target)
    return rows.groupBy("paper_id").agg(F.count("*").alias("n_edges"), F.array_sort(F.array_union(F.collect_set(source), F.collect_set(target))).alias("nodes"))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(F.from_json(tags, "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def cooccurrence(df: DataFrame, unit: str, item: str, weights: dict[str, float] | None = None, kind: str | None = None) -> DataFrame:
    """(a, b, weight) over pairs of distinct items of a unit; with ``kind`` a pair weighs its unit row's kind.

    Units hold few distinct items (a catalogue's worth), which bounds the pairs.
    """
    rows = df.select(unit, item, *([kind] if kind else [])).where(F.col(item).isNotNull()).distinct()
    weight = F.coalesce(*(F.when(F.col("l." + kind) == k, F.lit(w)) for k, w in (weights or {}).items()), F.lit(1.0)) if kind else F.lit(1.0)
    pairs = rows.alias("l").join(rows.alias("r"), unit).where(F.col(f"l.{item}") < F.col(f"r.{item}"))
    return pairs.groupBy(F.col(f"l.{item}").alias("a"), F.col(f"r.{item}").alias("b")).agg(F.sum(weight).alias("weight"))


def weighted_score(df: DataFrame, weight: str, passed: Column, most: int = 15) -> Column:
    """``most`` times the share of weight that passed, half to even; an aggregate."""
    return F.bround(most * F.sum(F.when(passed, F.col(weight)).otherwise(0)) / F.sum(weight), 0)


def gate(status: Column, gating: Column) -> Column:
    """Whether no gating check failed; an aggregate."""
    return F.coalesce(F.bool_and(F.when(gating, status != "FAIL")), F.lit(True))


def points(status: Column, worth: Column) -> Column:
    """PASS earns all, WARN half; an aggregate."""
    return F.sum(F.when(status == "PASS", worth).when(status == "WARN", worth / 2).otherwise(0))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of rows with every column filled, and its band."""
    whole = reduce(lambda a, b: a & b, (filled(df, c) for c in columns), F.lit(True))
    share = df.agg(F.coalesce(F.avg(whole.cast("int")), F.lit(0.0)).alias("share"))
    return share.withColumn("band", F.when(F.col("share") >= 0.95, "complete").when(F.col("share") >= 0.8, "mostly").when(F.col("share") >= 0.5, "partial").otherwise("sparse"))


def best_of(score: Column, good: Column, cap: float = 20.0, bonus: float = 4.0) -> Column:
    """The best score and a capped bonus for the number of good ones; an aggregate."""
    return F.least(F.lit(cap), F.max(score) + F.least(F.lit(bonus), F.count_if(good)))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: one row of n, observed and expected agreement and kappa (null where it is undefined)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("x")), cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("chance"))
    out = total.crossJoin(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("chance") / (F.col("n") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def concentration(df: DataFrame, by: list[str], member: str, amount: Column) -> DataFrame:
    """Herfindahl index of the members' shares in each group."""
    sums = df.groupBy(*by, member).agg(F.sum(amount).alias("s"))
    return sums.groupBy(*by).agg((F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("hhi"), F.count("*").alias("n_members"))


def heterogeneity(df: DataFrame, by: list[str], effect: str, se: str) -> DataFrame:
    """Fixed-effect mean, Cochran's Q, I squared (percent) and Egger's intercept of each group."""
    w = 1 / (F.col(se) * F.col(se))
    sums = df.where(F.col(se) > 0).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * F.col(effect)).alias("wx"), F.sum(w * F.col(effect) * F.col(effect)).alias("wxx"),
        F.regr_intercept(F.col(effect) / F.col(se), 1 / F.col(se)).alias("egger_intercept"),
    )
    q = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    return sums.select(*by, "k", (F.col("wx") / F.col("w")).alias("mean"), q.alias("q"), F.when((q > 0) & (F.col("k") > 1), F.greatest(F.lit(0.0), 100 * (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i_squared"), "egger_intercept")


def unique_samples(df: DataFrame, edges: DataFrame, claim: str, paper: str, n: str) -> DataFrame:
    """(claim, papers, n_total, n_unique, overlap): sample sizes of a claim's papers, shared samples counted once.

    ``edges`` (a, b): papers that share a sample. Papers of one claim that are
    joined by edges between papers of that claim count with the largest of
    their sizes. ``overlap`` tells whether there are any. A paper that stands in
    a claim several times counts once, with its largest size; null sizes count
    0. Edges of papers to themselves, or out of the claim, change nothing.
    """
    rows = df.where(F.col(claim).isNotNull() & F.col(paper).isNotNull()).groupBy(F.col(claim).alias("c"), F.col(paper).alias("p")).agg(F.max(F.coalesce(F.col(n), F.lit(0))).cast("long").alias("n"))
    known = edges.select("a", "b").where("a <> b").distinct()
    first = known.join(rows.select("c", F.col("p").alias("a")), "a")
    both = first.join(rows.select("c", F.col("p").alias("b")), ["c", "b"])
    linked = components(both.select(F.struct("c", F.col("a").alias("p")).alias("a"), F.struct("c", F.col("b").alias("p")).alias("b")))
    grouped = rows.join(linked.select("node.c", "node.p", F.col("root.p").alias("root")), ["c", "p"], "left").withColumn("sample", F.coalesce("root", "p"))
    once = grouped.groupBy("c", "sample").agg(F.max("n").alias("once"), F.sum("n").alias("n"), F.count("*").alias("papers"))
    out = once.groupBy("c").agg(F.sum("papers").alias("papers"), F.sum("n").alias("n_total"), F.sum("once").alias("n_unique"), (F.max("papers") > 1).alias("overlap"))
    return out.withColumnRenamed("c", claim)


def passes(df: DataFrame, by: list[str], name: str, state: str, names: list[str]) -> DataFrame:
    """The latest-sorted state of each pass as columns."""
    return df.groupBy(*by).agg(*(F.max(F.when(F.col(name) == n, F.col(state))).alias(n) for n in names))


def page_briefing(df: DataFrame, key: str, amounts: tuple[str, str], k: int = 5) -> DataFrame:
    """The k largest sums of the first measure, or of the second where the first is null or 0."""
    value = F.coalesce(F.nullif(F.col(amounts[0]), F.lit(0)), F.col(amounts[1]))
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def exploded_counts(df: DataFrame, array: str, k: int = 5) -> DataFrame:
    return df.select(F.explode(array).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def set_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def well_formed(c: Column) -> dict[str, Column]:
    """Aggregates over query texts: long questions, and queries with an operator and a quote."""
    return {"n_questions": F.count_if((F.length(c) > 50) & F.rtrim(c).endswith("?")), "n_boolean": F.count_if(c.rlike(r"\b(AND|OR)\b") & c.contains('"'))}


def vocabulary_covered(c: Column, expected: list[str]) -> Column:
    """How many of the expected values occur; an aggregate."""
    return F.size(F.array_intersect(F.collect_set(c), F.array(*map(F.lit, expected))))


def mean_by_key(df: DataFrame, tags: str) -> DataFrame:
    """The mean of a map's values for each of its keys."""
    return df.select(F.explode(tags).alias("key", "value")).groupBy("key").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def verdict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, ok) for named aggregate booleans, with 'all' last."""
    row = df.agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    every = reduce(lambda a, b: a & b, map(F.col, checks), F.lit(True))
    pairs = [F.struct(F.lit(n).alias("check"), F.col(n).alias("ok")) for n in checks] + [F.struct(F.lit("all").alias("check"), every.alias("ok"))]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def compared_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, state) of two sets of (path, content): same, differs, only_left, only_right."""
    x, y = (d.select("path", F.sha2("content", 256).alias(h)) for d, h in ((a, "l"), (b, "r")))
    state = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.col("l") == F.col("r"), "same").otherwise("differs")
    return x.join(y, "path", "full_outer").select("path", state.alias("state"))

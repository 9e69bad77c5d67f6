"""Scored relatedness without all pairs: candidates by shared keys, then scores, then the best few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import scratch, written


def _shared(df: DataFrame, id_col: str, array: str) -> DataFrame:
    """(a, b, n): how many values of an array column two rows share."""
    rows = df.select(id_col, F.explode(F.array_distinct(array)).alias("v")).where("v is not null")
    return rows.alias("a").join(rows.alias("b"), "v").where(F.col(f"a.{id_col}") != F.col(f"b.{id_col}")).groupBy(F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b")).agg(F.count("*").alias("n"))


#: A value that more rows hold is answered by the best rows of its sets of values, not by pairs.
HOT_ROWS = 1000


def _sets_of(values: Column, caps: dict[str, float]) -> Column:
    """The non-empty sets of a row's values (f, v), with at most ``caps`` values of a feature, each in the order of ``values``."""
    ranked = F.transform(values, lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v"), F.coalesce(*(F.when(x["f"] == c, F.lit(int(n))) for c, n in caps.items()), F.lit(1 << 30)).alias("cap")))

    def more(sets: Column, x: Column) -> Column:
        room = F.filter(sets, lambda s: F.size(F.filter(s, lambda y: y["f"] == x["f"])) < x["cap"])
        return F.concat(sets, F.transform(room, lambda s: F.array_append(s, F.struct(x["f"].alias("f"), x["v"].alias("v")))))

    none = F.array(F.array().cast("array<struct<f:string,v:string>>"))
    return F.filter(F.aggregate(ranked, none, more), lambda s: F.size(s) > 0)


def related(df: DataFrame, id_col: str, features: dict[str, tuple[float, float | None]], flag: str | None = None, k: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, other, score, rank): the k best others by shared values, ties to the lower id; exact at any frequency of values.

    ``features`` gives each array column points a shared value and a most (a
    whole number, or none) of values that count. A row of ``flag`` adds a point
    where both rows have it. Ids must be unique; null arrays and values share
    nothing.

    Rows that share a value of at most ``hot_rows`` rows are scored as pairs. Of
    the values that more rows hold, every row makes the sets it could share
    with another one (sets of at most ``most`` values of a feature), and each
    set keeps the k + 1 lowest ids that hold it. A row whose shared values are
    all hot is among those of the set it shares, or else k rows of at least its
    score and lower ids stand before it: so nothing is lost, and no two rows
    meet for a hot value alone. A row with h hot values of a feature without a
    most makes 2^h sets.
    """
    spark = df.sparkSession
    columns = list(features) + ([flag] if flag else [])
    points = {c: p for c, (p, _) in features.items()} | ({flag: 1.0} if flag else {})
    most = {c: m for c, (_, m) in features.items() if m is not None} | ({flag: 1} if flag else {})
    arrays = [F.array_distinct(F.filter(F.col(c).cast("array<string>"), lambda x: x.isNotNull())).alias(c) for c in features]
    arrays += [F.when(F.col(flag), F.array(F.lit("1"))).alias(flag)] if flag else []
    rows = written(df.select(F.col(id_col).alias("id"), *(F.coalesce(x, F.array().cast("array<string>")).alias(c) for c, x in zip(columns, arrays, strict=True))), scratch(spark, "shared-values"))

    def tagged(c: str) -> Column:
        return F.transform(F.col(c), lambda x: F.struct(F.lit(c).alias("f"), x.alias("v")))

    def held(c: str) -> Column:
        return F.size(F.filter("t", lambda x: x["f"] == c))

    pairs_of = F.flatten(F.array(*map(tagged, columns)))
    values = rows.select("id", F.explode(pairs_of).alias("x")).select("id", "x.f", "x.v")
    counts = written(values.groupBy("f", "v").agg(F.count("*").alias("n")).where("n > 1"), scratch(spark, "value-counts"))

    def total(shared: dict[str, Column]) -> Column:
        parts = [(F.least(n, F.lit(most[c])) if c in most else n) * F.lit(float(points[c])) for c, n in shared.items()]
        return sum(parts[1:], parts[0])

    rare = values.join(counts.where(F.col("n") <= hot_rows), ["f", "v"]).select("id", "f", "v")
    met = rare.alias("a").join(rare.alias("b"), ["f", "v"]).where("a.id <> b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    mine, other = rows.toDF("a", *(f"a_{c}" for c in columns)), rows.toDF("b", *(f"b_{c}" for c in columns))
    exact = met.join(mine, "a").join(other, "b").select("a", "b", total({c: F.size(F.array_intersect(f"a_{c}", f"b_{c}")) for c in columns}).alias("s"))

    hot = values.join(counts.where(F.col("n") > hot_rows), ["f", "v"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("held"))
    sets = hot.select("id", F.explode(_sets_of(F.col("held"), most)).alias("t"))
    keyed = written(sets.select("id", F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(1)).alias("g"), total({c: held(c) for c in columns}).alias("s")), scratch(spark, "value-sets"))
    lowest = Window.partitionBy("h", "g").orderBy("id")
    best = keyed.withColumn("nth", F.row_number().over(lowest)).where(F.col("nth") <= k + 1).select("h", "g", F.col("id").alias("b"))
    near = keyed.withColumnRenamed("id", "a").join(best, ["h", "g"]).where("a <> b").select("a", "b", "s")

    scores = exact.union(near).groupBy("a", "b").agg(F.max("s").alias("s"))
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    out = scores.where("s > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("a").alias(id_col), F.col("b").alias("other"), F.col("s").alias("score"), "rank")


def related_topics(topics: DataFrame, k: int = 8) -> DataFrame:
    """(id, target_id, target_label, kind, score, paper_count, rank) over topics.

    4 points for an equal outcome focus with another environment node, 2 for an
    equal environment root with another node, 1 each for shared theories and
    sensors. Columns: id, label, iv_root, iv_node, dv_focus, paper_count,
    theories, sensors.
    """
    a, b = topics.alias("a"), topics.alias("b")

    def pairs(on: Column, points: float) -> DataFrame:
        return a.join(b, on & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.lit(points).alias("s"))

    other_node = F.col("a.iv_node") != F.col("b.iv_node")
    scores = pairs((F.col("a.dv_focus") == F.col("b.dv_focus")) & other_node, 4.0).union(pairs((F.col("a.iv_root") == F.col("b.iv_root")) & other_node, 2.0))
    for c in ("theories", "sensors"):
        scores = scores.union(_shared(topics, "id", c).select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("s")))
    total = scores.groupBy("x", "y").agg(F.sum("s").alias("score"))
    info = topics.select(F.col("id").alias("y"), F.col("label").alias("target_label"), F.col("dv_focus").alias("y_focus"), "paper_count")
    mine = topics.select(F.col("id").alias("x"), F.col("dv_focus").alias("x_focus"))
    out = total.join(info, "y").join(mine, "x").withColumn("kind", F.when(F.col("x_focus") == F.col("y_focus"), "same_dv_focus").otherwise("same_iv_root"))
    w = Window.partitionBy("x").orderBy(F.desc("score"), F.desc("paper_count"), "target_label", "y")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("x").alias("id"), F.col("y").alias("target_id"), "target_label", "kind", "score", "paper_count", "rank")

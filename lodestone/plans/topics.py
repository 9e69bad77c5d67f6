"""Topics: membership flattening, patch reconciliation, topic choice, hierarchy and crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import taxonomy as tx
from lodestone.functions.collections import move_to_front
from lodestone.functions.text import collapsed, compact, present, slugify
from lodestone.operators.joins import best_confidence
from lodestone.operators.lexicon import held_values
from lodestone.operators.ordering import near_top

NONE = "array<string>"


def _list(c: str):
    return F.coalesce(F.col(c), F.array().cast(NONE))


def flat_memberships(memberships: DataFrame, defended_only: bool = False) -> DataFrame:
    """(paper_id, topic_id, role, confidence): visible topics, the primary one marked; hidden rows go.

    A primary topic that is missing from the list counts as listed. With
    ``defended_only`` rows below confidence 0.75 go too.
    """
    rows = memberships.where(F.lower(F.coalesce("visibility", F.lit("visible"))) == "visible")
    if defended_only:
        rows = rows.where(F.coalesce("confidence", F.lit(0.0)) >= 0.75)
    primary = F.nullif(F.btrim("primary_topic_id"), F.lit(""))
    listed = F.array_distinct(F.filter(F.transform(F.concat(F.array(primary), _list("topic_ids")), lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != "")))
    rows = rows.where(present(F.col("paper_id")).isNotNull()).select("paper_id", primary.alias("p"), "confidence", F.explode(listed).alias("topic_id"))
    return rows.select("paper_id", "topic_id", F.when(F.col("topic_id") == F.col("p"), "primary").otherwise("secondary").alias("role"), "confidence")


def topic_id(root, focus):
    return slugify(F.concat(F.coalesce(present(root), F.lit("unspecified")), F.lit("__"), F.coalesce(present(focus), F.lit(tx.NO_OUTCOME))))


def usable_patches(patches: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The patch of the highest confidence per paper (of equal ones the later), with ten words of evidence at least."""
    rows = patches.withColumn("evidence", collapsed(F.col("evidence"))).where((F.size(F.split("evidence", " ")) >= 10))
    for c in ("paper_id", "iv_root", "dv_focus"):
        rows = rows.where(present(F.col(c)).isNotNull()).withColumn(c, F.btrim(c))
    rows = rows.withColumns({"confidence": F.bround(F.coalesce("confidence", F.lit(0.0)), 3), "extraction_method": F.coalesce(present(F.col("extraction_method")), F.lit("construct_patch")), "evidence": compact(F.col("evidence"), 260)})
    return best_confidence(rows, ["paper_id"], "confidence", ordinal).withColumn("topic_id", topic_id(F.col("iv_root"), F.col("dv_focus")))


def reconciled(memberships: DataFrame, patches: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memberships with the patches applied, topics with provisional nodes added, and a one-row summary.

    A patched paper's topic moves to the front of its lists and becomes its
    primary topic. Topic pairs that have no node get a provisional one.
    """
    best = usable_patches(patches)
    p = best.select("paper_id", F.col("topic_id").alias("t"), F.col("iv_root").alias("r"), F.col("dv_focus").alias("f"), F.col("confidence").alias("c"), F.col("extraction_method").alias("m"))
    joined = memberships.join(p, "paper_id", "left")
    hit = F.col("t").isNotNull()

    def when(value, name: str):
        return F.when(hit, value).otherwise(F.col(name))

    lists = move_to_front(F.filter(_list("topic_ids"), lambda x: F.btrim(x) != ""), F.col("t"))
    visibility = F.coalesce(present(F.col("visibility")), F.lit("visible"))
    out = joined.withColumns({
        "topic_ids": when(lists, "topic_ids"),
        "secondary_topic_ids": when(F.array_remove(lists, F.col("t")), "secondary_topic_ids"),
        "iv_roots": when(move_to_front(_list("iv_roots"), F.col("r")), "iv_roots"),
        "dv_focuses": when(move_to_front(_list("dv_focuses"), F.col("f")), "dv_focuses"),
        "conflict": hit & (F.coalesce(F.btrim("primary_topic_id"), F.lit("")) != "") & (F.btrim("primary_topic_id") != F.col("t")),
        "confidence": when(F.bround(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("c", F.lit(0.0))), 3), "confidence"),
        "visibility": when(visibility, "visibility"),
        "hide_reason": F.when(hit & (visibility == "visible"), "").otherwise(F.col("hide_reason")),
        "assignment_method": F.when(hit & (F.coalesce("primary_topic_id", F.lit("")) != F.col("t")), F.concat(F.lit("construct_patch:"), F.col("m"))),
    }).withColumn("primary_topic_id", when(F.col("t"), "primary_topic_id"))
    members = memberships.select("paper_id").distinct()
    asked = best.join(members, "paper_id", "left_semi").select("topic_id", "iv_root", "dv_focus").dropDuplicates(["topic_id"])
    fresh = asked.join(topics, "topic_id", "left_anti").select(
        "topic_id", "iv_root", "dv_focus", F.concat(tx.environment_root_label(F.col("iv_root")), F.lit(" × "), tx.outcome_label(F.col("dv_focus"))).alias("label"), F.lit(True).alias("provisional")
    )
    summary = out.agg(F.count_if("conflict").alias("conflict_count")).crossJoin(F.broadcast(best.agg(F.count("*").alias("patch_row_count")))).crossJoin(F.broadcast(fresh.agg(F.count("*").alias("provisional_node_count"))))
    return out.drop("t", "r", "f", "c", "m", "conflict"), topics.unionByName(fresh, allowMissingColumns=True), summary


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, weight: str = "weight") -> DataFrame:
    """(id, node, score): a text's weight for every hint it holds, over (node, hint) rows of any number.

    Texts are lower-cased, hints taken as they are; a repeated (node, hint)
    counts once, and an empty one is no hint.
    """
    hints = lexicon.where("node is not null and hint <> ''").select("node", "hint").distinct()
    patterns = hints.groupBy(F.col("hint").alias("pattern")).agg(F.collect_list("node").alias("values"))
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.col(weight).alias("weight"))
    found = held_values(rows.select(F.struct("id", "weight").alias("of"), "text"), patterns, "of", "text").select("of", "value", "n")
    return found.groupBy(F.col("of.id").alias(id_col), F.col("value").alias("node")).agg(F.sum(F.col("of.weight") * F.col("n")).alias("score"))


def article_scores(articles: DataFrame, lexicon: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(id, node, score) from title (1.0), abstract (0.6) and main conclusion (0.5)."""
    parts = [articles.select(id_col, F.col(c).alias("text"), F.lit(w).alias("weight")) for c, w in (("title", 1.0), ("abstract", 0.6), ("main_conclusion", 0.5))]
    scores = parts[0].union(parts[1]).union(parts[2])
    return lexicon_hits(scores, lexicon, id_col, "text")


def chosen_pairs(pairs: DataFrame, iv: DataFrame, dv: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(id, iv_node, dv_node, quality, rank): at most three pairs of quality at least max(0.9, 0.55 of the best).

    ``pairs`` are (id, iv_node, dv_node, score) of a paper's rows; where a paper
    has none, its two best environments and two best outcomes (of three) pair
    up. Quality adds 0.15 of each side's score. Ties go by node names.
    """
    iv = iv.where(F.col("node") != tx.NO_ENVIRONMENT)
    dv = dv.where(~F.col("node").isin(*tx.LOW_INFO))
    top = lambda d, k: d.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "node"))).where(F.col("n") <= k).drop("n")
    a = top(iv, 2).select(id_col, F.col("node").alias("iv_node"), F.col("score").alias("iv_score"))
    b = top(dv, 2).select(id_col, F.col("node").alias("dv_node"), F.col("score").alias("dv_score"))
    made = a.join(b, id_col).select(id_col, "iv_node", "dv_node", (0.75 + 0.1 * F.col("iv_score") + 0.1 * F.col("dv_score")).alias("score"))
    made = made.join(pairs.select(id_col).distinct(), id_col, "left_anti")
    every = pairs.select(id_col, "iv_node", "dv_node", "score").union(made).groupBy(id_col, "iv_node", "dv_node").agg(F.sum("score").alias("score"))
    every = every.where((F.col("iv_node") != tx.NO_ENVIRONMENT) & ~F.col("dv_node").isin(*tx.LOW_INFO))
    every = every.join(iv.select(id_col, F.col("node").alias("iv_node"), F.col("score").alias("i")), [id_col, "iv_node"], "left").join(dv.select(id_col, F.col("node").alias("dv_node"), F.col("score").alias("d")), [id_col, "dv_node"], "left")
    every = every.select(id_col, "iv_node", "dv_node", (F.col("score") + 0.15 * F.coalesce("i", F.lit(0.0)) + 0.15 * F.coalesce("d", F.lit(0.0))).alias("quality"))
    return near_top(every, [id_col], "quality", 0.55, 0.9, 3, ["iv_node", "dv_node"])


def hierarchy(assigned: DataFrame) -> DataFrame:
    """One row a topic: labels, distinct papers, theories and sensors, over (paper_id, iv_node, dv_focus, theories, sensors)."""
    # Ids are few and rows are many: each distinct id is normalised once, and the rows look it up.
    iv_names = assigned.select("iv_node").distinct().withColumn("__iv", tx.environment_focus(F.col("iv_node")))
    dv_names = assigned.select("dv_focus").distinct().withColumn("__dv", tx.outcome_focus(F.col("dv_focus")))
    rows = assigned.join(iv_names, assigned.iv_node.eqNullSafe(iv_names.iv_node)).drop("iv_node").join(dv_names, assigned.dv_focus.eqNullSafe(dv_names.dv_focus)).drop("dv_focus")
    rows = rows.withColumnsRenamed({"__iv": "iv_node", "__dv": "dv_focus"})
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast(NONE))))))
    out = rows.groupBy("iv_node", "dv_focus").agg(F.array_sort(F.collect_set("paper_id")).alias("paper_ids"), flat("theories").alias("theories"), flat("sensors").alias("sensors"))
    iv, dv = F.col("iv_node"), F.col("dv_focus")
    return out.withColumns({"id": slugify(F.concat(iv, F.lit("__"), dv)), "label": tx.topic_label(iv, dv), "iv_root": tx.root(iv), "dv_root": tx.root(dv), "paper_count": F.size("paper_ids").cast("long")})


def level_counts(assigned: DataFrame) -> DataFrame:
    """(level, key, paper_count): distinct papers by environment root, environment node and outcome focus."""
    rows = assigned.select("paper_id", F.explode(F.array(F.struct(F.lit("iv_root").alias("level"), tx.root(F.col("iv_node")).alias("key")), F.struct(F.lit("iv_node").alias("level"), F.col("iv_node").alias("key")), F.struct(F.lit("dv_focus").alias("level"), F.col("dv_focus").alias("key")))).alias("x"))
    return rows.groupBy("x.level", "x.key").agg(F.count_distinct("paper_id").alias("paper_count"))


def crosswalk(defended: DataFrame, working: DataFrame) -> DataFrame:
    """One row a defended topic with its defended and working counts, largest first."""
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast(NONE)), lambda x: F.btrim(x)), lambda x: x != "")))
    w = working.select(F.col("id").alias("topic_id"), F.col("paper_count").alias("w_count"), F.size(ids("paper_ids")).alias("w_size"))
    rows = defended.where(present(F.col("id")).isNotNull()).select(
        F.btrim("id").alias("topic_id"), F.coalesce(present(F.col("label")), F.btrim("id")).alias("topic_label"),
        F.coalesce(present(F.col("dv_focus")), F.lit(tx.NO_OUTCOME)).alias("outcome_term_id"), F.col("dv_focus_label").alias("ol"),
        F.coalesce(present(F.col("iv_root")), F.lit("unspecified")).alias("iv_root"), F.col("iv_root_label").alias("rl"), "iv_node", "iv_label",
        ids("paper_ids").alias("paper_ids"), F.col("paper_count").alias("n"), *(F.slice(F.coalesce(F.col(c), F.array().cast(NONE)), 1, 8).alias(a) for c, a in (("theories", "theories"), ("sensors", "common_sensors"), ("fronts", "fronts"))),
    )
    count = F.coalesce(F.nullif("n", F.lit(0)), F.size("paper_ids")).cast("long")
    label = F.coalesce(present(F.col("rl")), tx.environment_root_label(F.col("iv_root")))
    rows = rows.join(w, "topic_id", "left").withColumns({"defended_paper_count": count, "outcome_label": F.coalesce(present(F.col("ol")), F.col("outcome_term_id")), "iv_root_label": label})
    working_count = F.coalesce(F.nullif("w_count", F.lit(0)), F.nullif("w_size", F.lit(0)), F.size("paper_ids")).cast("long")
    return rows.select(
        "topic_id", "topic_label", "outcome_term_id", "outcome_label", "iv_root", "iv_root_label", F.coalesce("iv_node", "iv_root").alias("iv_node"), F.coalesce("iv_label", "iv_root_label").alias("iv_label"),
        "paper_ids", F.col("defended_paper_count").alias("paper_count"), "defended_paper_count", F.greatest("defended_paper_count", working_count).alias("working_paper_count"), "theories", "common_sensors", "fronts", F.lit("defended").alias("evidence_status"),
    ).orderBy(F.desc("paper_count"), "topic_label")


def crosswalk_index(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Additive totals of a crosswalk: a paper of several topics counts in each (see ``two_level_rollup`` for distinct counts)."""
    out = rows.groupBy(key).agg(F.min(label).alias(label), F.sum("paper_count").alias("paper_count"), F.array_sort(F.collect_set("topic_id")).alias("topic_ids"))
    return out.withColumn("topic_count", F.size("topic_ids").cast("long")).orderBy(F.desc("paper_count"), label)


def exclusion_queue(articles: DataFrame, missing: DataFrame, pattern: str) -> DataFrame:
    """Papers without a topic: excluded by the rule, or to be reviewed."""
    from lodestone.functions.rules import excluded_from_topics

    out = articles.join(missing, "paper_id").where("missing_iv or missing_dv")
    rule = excluded_from_topics(F.col("missing_iv"), F.col("missing_dv"), F.col("title"), F.col("article_type"), F.col("claim_count"), pattern)
    return out.select("paper_id", "title", "missing_iv", "missing_dv", F.when(rule, "excluded").otherwise("review").alias("state"))

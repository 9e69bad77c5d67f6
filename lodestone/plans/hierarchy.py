"""Topic hierarchies as wholes: papers to topics, by given memberships or by their rows and texts, and the tables of the view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import taxonomy as tx
from lodestone.functions.rules import excluded_from_topics
from lodestone.functions.text import any_marker, slugify, topic_candidate
from lodestone.operators.aggregates import most_common
from lodestone.operators.joins import first_per_key, lookup, with_constant
from lodestone.operators.ordering import top_per_group
from lodestone.operators.related import related_topics
from lodestone.plans.topics import article_scores, chosen_pairs, lexicon_hits
from lodestone.sources.documents import json_rows, write_document
from lodestone.scratch import scratch, written

#: Papers shown, theories, sensors and fronts named for a topic.
SHOWN, NAMED = 14, {"theories": 6, "sensors": 6, "fronts": 4}
#: Raw outcomes that give no outcome, and words of papers that are about a mechanism where no outcome is found.
WEAK_OUTCOMES = ("study validity or manipulation check", "self-report rating", "condition or group comparison", "between groups", "qualitative perception or theme")
OVERLAY = ("overview", "review", "theory", "framework", "conceptual", "approach", "introduction", "seeking common ground", "way of knowing", "design")
#: Outcomes that a paper's sensors speak for.
SENSED = (("neural", 0.8, ("eeg", "fmri")), ("affect.negative.stress", 0.6, ("heart rate", "hrv", "electrodermal", "eda", "cortisol")))
NODE = ("id", "label", "iv_root", "iv_root_label", "iv_node", "iv_label", "dv_root", "dv_root_label", "dv_focus", "dv_focus_label")


@dataclass
class Hierarchy:
    """The tables of a topic view.

    ``members``: a row a topic and paper (topic_id, paper_id, role, confidence).
    ``topics``: a row a topic with papers: the node's columns, paper_count, the
    most frequent theories, sensors and fronts, and a preview of its papers.
    ``children`` and ``roots``: environment nodes and their roots, with papers
    counted once. ``related``: the best eight others of each topic. ``repair``
    and ``excluded``: papers that the view leaves out, with the reason.
    ``summary``: one row of counts.
    """

    members: DataFrame
    topics: DataFrame
    children: DataFrame
    roots: DataFrame
    related: DataFrame
    repair: DataFrame
    excluded: DataFrame
    summary: DataFrame


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """A table that several others are made of, written once to the shared folder."""
    return written(df, scratch(df.sparkSession, tag))


def _frequent(members: DataFrame, nodes: DataFrame, articles: DataFrame, column: str, ordinal: str) -> DataFrame:
    """(id, column): a topic's most frequent names, counted over its own list and those of its papers; ties to the earlier."""
    at = lambda a, b: F.struct(a.cast("long").alias("a"), b.alias("b")).alias("at")
    said = articles.select("paper_id", ordinal, F.posexplode(column).alias("b", "name"))
    said = members.select("topic_id", "paper_id").join(said, "paper_id").select("topic_id", "name", at(F.col(ordinal), F.col("b")))
    if column in nodes.columns:
        own = nodes.select(F.col("id").alias("topic_id"), F.posexplode(column).alias("b", "name"))
        said = said.union(own.select("topic_id", "name", at(F.lit(-1), F.col("b"))))
    clean = topic_candidate(F.col("name")) if column == "theories" else F.btrim("name")
    top = most_common(said.withColumn("name", clean).where("name <> ''"), ["topic_id"], "name", "at", NAMED[column])
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return top.groupBy(F.col("topic_id").alias("id")).agg(names.alias(column))


def _topics(members: DataFrame, nodes: DataFrame, articles: DataFrame, ordinal: str) -> DataFrame:
    counts = members.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("paper_count"))
    rows = members.join(articles.select("paper_id", "title", "year", F.coalesce("claim_count", F.lit(0)).alias("claim_count")), "paper_id")
    first = top_per_group(rows, ["topic_id"], SHOWN, F.coalesce(F.col("role"), F.lit("primary")) != "primary", F.desc("claim_count"), F.col("paper_id"))
    shown = F.array_sort(F.collect_list(F.struct("rank", "paper_id", "title", "year", "claim_count", "role", "confidence")))
    preview = first.groupBy(F.col("topic_id").alias("id")).agg(shown.alias("paper_preview"))
    out = nodes.select(*NODE).join(counts, "id")
    none = F.array().cast("array<string>")
    for column in NAMED:
        names = _frequent(members, nodes, articles, column, ordinal)
        out = out.join(names, "id", "left").withColumn(column, F.coalesce(column, none))
    return out.join(preview, "id")


def _assembled(articles: DataFrame, members: DataFrame, nodes: DataFrame, repair: DataFrame, excluded: DataFrame, missing: DataFrame, ordinal: str) -> Hierarchy:
    topics = _kept(_topics(members, nodes, articles, ordinal), "topics")
    placed = members.join(nodes.select(F.col("id").alias("topic_id"), "iv_root", "iv_root_label", "iv_node", "iv_label"), "topic_id")
    distinct = lambda c, name: F.count_distinct(c).alias(name)
    children = placed.groupBy("iv_root", "iv_node").agg(F.min("iv_label").alias("label"), distinct("paper_id", "paper_count"), distinct("topic_id", "topic_count"))
    roots = placed.groupBy("iv_root").agg(F.min("iv_root_label").alias("label"), distinct("paper_id", "paper_count"), distinct("iv_node", "child_count"))
    related = related_topics(topics)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    summary = n(articles, "article_count")
    for df, name in ((repair, "hidden_article_count"), (excluded, "excluded_article_count"), (roots, "root_count"), (topics, "topic_count"), (related, "cross_relation_count")):
        summary = with_constant(summary, n(df, name))
    gaps = missing.agg(F.count_if("missing_iv").alias("fallback_iv_paper_count"), F.count_if("missing_dv").alias("fallback_dv_paper_count"))
    visible = F.col("article_count") - F.col("hidden_article_count") - F.col("excluded_article_count")
    summary = with_constant(summary, gaps).withColumn("visible_article_count", visible)
    last = lambda c, value: F.col(c) == value
    return Hierarchy(
        members,
        topics.orderBy(last("iv_root", "unspecified"), last("dv_focus", tx.NO_OUTCOME), F.desc("paper_count"), "label"),
        children.orderBy(last("iv_node", tx.NO_ENVIRONMENT), F.desc("paper_count"), "label"),
        roots.orderBy(last("iv_root", "unspecified"), F.desc("paper_count"), "label"),
        related, repair, excluded, summary,
    )


def _left_out(papers: DataFrame, pattern: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Papers without a topic, with ``missing_iv`` and ``missing_dv``: those to repair, and those that the rule excludes."""
    rule = excluded_from_topics(F.col("missing_iv"), F.col("missing_dv"), F.col("title"), F.col("article_type"), F.col("claim_count"), pattern)
    rows = papers.select("paper_id", "title", "year", F.coalesce("claim_count", F.lit(0)).alias("claim_count"), "missing_iv", "missing_dv", reason.alias("reason"), F.coalesce(rule, F.lit(False)).alias("out"))
    return rows.where("not out").drop("out"), rows.where("out").drop("out")


def canonical(articles: DataFrame, memberships: DataFrame, hidden: DataFrame, nodes: DataFrame, pattern: str, ordinal: str = "ordinal") -> Hierarchy:
    """The hierarchy of given nodes and memberships.

    ``articles`` (one row a paper_id): title, year, claim_count, article_type,
    theories, sensors, fronts (arrays) and the input ordinal. ``memberships``
    as ``flat_memberships`` gives them; of equal (paper, topic) rows the primary
    one of the highest confidence stays. ``hidden`` (one row a paper): reason,
    missing_iv, missing_dv. A membership whose node does not exist is listed
    for repair; a paper without any is listed for repair or excluded.
    """
    order = [F.coalesce(F.col("role"), F.lit("")) != "primary", F.desc_nulls_last("confidence")]
    rows = first_per_key(memberships.join(articles.select("paper_id"), "paper_id", "left_semi"), ["topic_id", "paper_id"], *order)
    ids = nodes.select(F.col("id").alias("topic_id"))
    members = _kept(rows.join(ids, "topic_id", "left_semi").select("topic_id", "paper_id", "role", F.bround(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence")), "topic-members")
    without = articles.join(memberships.select("paper_id").distinct(), "paper_id", "left_anti")
    without = lookup(without, hidden.select("paper_id", "reason", "missing_iv", "missing_dv"), ["paper_id"], {"missing_iv": False, "missing_dv": False})
    repair, excluded = _left_out(without, pattern, F.coalesce("reason", F.lit("no visible canonical topic membership")))
    lost = rows.join(ids, "topic_id", "left_anti").join(articles, "paper_id").withColumns({"missing_iv": F.lit(False), "missing_dv": F.lit(False)})
    lost = _left_out(lost, pattern, F.concat(F.lit("membership references missing topic node "), "topic_id"))[0]
    return _assembled(articles, members, nodes, repair.union(lost), excluded, without, ordinal)


def _row_scores(rows: DataFrame, hints: DataFrame, raw: str, node: Column, base: float, usable: Column) -> DataFrame:
    """(key, node, score, place): what a row's node and raw text speak for, or where they say nothing its article's title."""
    dots = F.length(node) - F.length(F.replace(node, F.lit("."), F.lit("")))
    named = rows.where(usable).select("key", node.alias("node"), (base + 0.1 * dots).alias("score"))
    said = lexicon_hits(rows.select("key", F.col(raw).alias("text"), F.lit(1.6).alias("weight")), hints, "key", "text")
    bare = rows.join(named.select("key").union(said.select("key")).distinct(), "key", "left_anti")
    titled = lexicon_hits(bare.select("key", F.col("title").alias("text"), F.lit(0.9).alias("weight")), hints, "key", "text")
    places = hints.groupBy("node").agg(F.min("ordinal").alias("place"))
    hit = lookup(said.union(titled), places, ["node"]).select("key", "node", "score", F.col("place").cast("long").alias("place"))
    every = named.withColumn("place", F.lit(-1).cast("long")).union(hit)
    return every.groupBy("key", "node").agg(F.sum("score").alias("score"), F.min("place").alias("place"))


def paper_scores(articles: DataFrame, rows: DataFrame, iv_hints: DataFrame, dv_hints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, iv, dv) of papers: pairs of the best environment and outcome of each row, and scores by node.

    ``rows``: paper_id, row_no (unique in its paper), iv_node_id, iv_raw,
    dv_node_id, dv_raw. Hints: (ordinal, node, hint). Equal scores in a row go
    to its own node, then to the earlier hint.
    """
    rows = rows.join(articles.select("paper_id", "title"), "paper_id").withColumn("key", F.struct("paper_id", "row_no"))
    iv_node, dv_node = tx.environment_focus(F.col("iv_node_id")), tx.outcome_focus(F.col("dv_node_id"))
    weak = any_marker(F.lower(F.coalesce("dv_raw", F.lit(""))), WEAK_OUTCOMES)
    iv_rows = _kept(_row_scores(rows, iv_hints, "iv_raw", iv_node, 1.25, iv_node != tx.NO_ENVIRONMENT), "environment-rows")
    dv_rows = _kept(_row_scores(rows, dv_hints, "dv_raw", dv_node, 1.2, ~dv_node.isin(*tx.LOW_INFO) & ~weak), "outcome-rows")
    best = lambda d, name: first_per_key(d, ["key"], F.desc("score"), F.col("place"), F.col("node")).select("key", F.col("node").alias(name), F.col("score").alias(f"{name}_score"))
    pairs = best(iv_rows, "iv_node").join(best(dv_rows, "dv_node"), "key").where((F.col("iv_node") != tx.NO_ENVIRONMENT) & ~F.col("dv_node").isin(*tx.LOW_INFO))
    pairs = pairs.groupBy("key.paper_id", "iv_node", "dv_node").agg(F.sum(F.least("iv_node_score", "dv_node_score")).alias("score"))
    by_paper = lambda d: d.select("key.paper_id", "node", "score")
    iv_articles = article_scores(articles, iv_hints).withColumn("node", tx.environment_focus(F.col("node"))).where(F.col("node") != tx.NO_ENVIRONMENT)
    sensors = F.lower(F.array_join("sensors", ","))
    sensed = [articles.where(any_marker(sensors, marks)).select("paper_id", F.lit(node).alias("node"), F.lit(w).alias("score")) for node, w, marks in SENSED]
    dv_articles = article_scores(articles, dv_hints).union(sensed[0]).union(sensed[1]).where(~F.col("node").isin(*tx.LOW_INFO))
    total = lambda d: d.groupBy("paper_id", "node").agg(F.sum("score").alias("score"))
    iv, dv = total(by_paper(iv_rows).union(iv_articles)), total(by_paper(dv_rows).union(dv_articles))
    blob = F.lower(F.concat_ws(" ", *(F.array_join(c, " ") if t.startswith("array") else F.col(c) for c, t in articles.dtypes if c in ("title", "abstract", "main_conclusion", "primary_topic", "theories", "constructs", "instruments", "sensors"))))
    known = dv.where(~F.col("node").isin(*tx.LOW_INFO)).select("paper_id").distinct()
    overlay = articles.where(any_marker(blob, OVERLAY)).join(known, "paper_id", "left_anti")
    return pairs, iv, dv.union(overlay.select("paper_id", F.lit("mechanism_or_pathway").alias("node"), F.lit(1.1).alias("score")))


def heuristic(articles: DataFrame, rows: DataFrame, iv_hints: DataFrame, dv_hints: DataFrame, pattern: str, ordinal: str = "ordinal") -> Hierarchy:
    """The hierarchy that papers' rows and texts speak for: at most three topics a paper, as ``chosen_pairs`` takes them.

    Articles as for ``canonical``, with abstract and main_conclusion; rows and
    hints as for ``paper_scores``.
    """
    pairs, iv, dv = (_kept(x, tag) for x, tag in zip(paper_scores(articles, rows, iv_hints, dv_hints), ("pairs", "environments", "outcomes"), strict=True))
    chosen = _kept(chosen_pairs(pairs, iv, dv), "chosen-pairs")
    topic = slugify(F.concat("iv_node", F.lit("__"), "dv_node"))
    members = chosen.select(topic.alias("topic_id"), "paper_id", F.lit(None).cast("string").alias("role"), F.bround("quality", 3).alias("confidence"))
    i, o = F.col("iv_node"), F.col("dv_node")
    made = chosen.select("iv_node", "dv_node").distinct()
    nodes = made.select(
        topic.alias("id"), tx.topic_label(i, o).alias("label"), tx.root(i).alias("iv_root"), tx.environment_root_label(i).alias("iv_root_label"), "iv_node", tx.environment_label(i).alias("iv_label"),
        tx.root(o).alias("dv_root"), tx.outcome_root_label(o).alias("dv_root_label"), o.alias("dv_focus"), tx.outcome_label(o).alias("dv_focus_label"),
    )
    has = lambda d, c: d.select("paper_id").distinct().withColumn(c, F.lit(False))
    missing = lookup(lookup(articles, has(iv.where(F.col("node") != tx.NO_ENVIRONMENT), "missing_iv"), ["paper_id"], {"missing_iv": True}), has(dv.where(~F.col("node").isin(*tx.LOW_INFO)), "missing_dv"), ["paper_id"], {"missing_dv": True})
    both = F.col("missing_iv") & F.col("missing_dv")
    reason = F.when(both, "missing dominant IV and DV").when(F.col("missing_iv"), "missing dominant IV").otherwise("missing dominant DV")
    repair, excluded = _left_out(missing.join(members.select("paper_id").distinct(), "paper_id", "left_anti"), pattern, reason)
    return _assembled(articles, members, nodes, repair, excluded, missing, ordinal)


def _branches(h: Hierarchy) -> tuple[DataFrame, Column, list[Column]]:
    """The nested list of roots, environment nodes and their topics: a row a topic, which opens and closes what it is the first and last of."""
    last = lambda c, value: F.col(c) == value
    topic = F.struct("id", "label", "paper_count", "dv_focus", "dv_focus_label")
    rows = h.topics.select("iv_root", "iv_node", "label", "paper_count", "dv_focus", F.to_json(topic).alias("topic"), "id")
    child = h.children.select("iv_root", "iv_node", F.col("label").alias("child_label"), F.col("paper_count").alias("child_papers"))
    root = h.roots.select("iv_root", F.col("label").alias("root_label"), F.col("paper_count").alias("root_papers"), "child_count")
    rows = rows.join(child, ["iv_root", "iv_node"]).join(root, "iv_root")
    in_root = [last("iv_node", tx.NO_ENVIRONMENT), F.desc("child_papers"), F.col("child_label"), F.col("iv_node")]
    in_child = [last("dv_focus", tx.NO_OUTCOME), F.desc("paper_count"), F.col("label"), F.col("id")]
    # A catalogue's topics below one root, without their papers.
    child_rows, root_rows = Window.partitionBy("iv_root", "iv_node"), Window.partitionBy("iv_root")
    places = {
        "c_first": F.row_number().over(child_rows.orderBy(*in_child)) == 1,
        "c_last": F.row_number().over(child_rows.orderBy(*in_child)) == F.count("*").over(child_rows),
        "r_first": F.row_number().over(root_rows.orderBy(*in_root, *in_child)) == 1,
        "r_last": F.row_number().over(root_rows.orderBy(*in_root, *in_child)) == F.count("*").over(root_rows),
    }
    rows = rows.withColumns(places)
    opened = lambda fields, name: F.concat(F.expr(f"rtrim('}}', to_json(struct({fields})))"), F.lit(f',"{name}":['))
    root_open = opened("iv_root AS id, root_label AS label, root_papers AS paper_count, child_count", "children")
    child_open = opened("iv_node AS id, child_label AS label, child_papers AS paper_count", "topics")
    text = F.concat(F.when(F.col("r_first"), root_open).otherwise(""), F.when(F.col("c_first"), child_open).otherwise(""), F.col("topic"), F.when(F.col("c_last"), "]}").otherwise(""), F.when(F.col("r_last"), "]}").otherwise(""))
    return rows, text, [last("iv_root", "unspecified"), F.desc("root_papers"), F.col("root_label"), F.col("iv_root"), *in_root, *in_child]


def write_hierarchy(h: Hierarchy, path: str, tasks: int = 16) -> None:
    """The nested document of a topic view as one JSON file: summary, topics, roots with children with topics, repair and exclusion queues.

    Topics carry their cross relations; their papers stand in the topic's
    preview. Tasks write the rows of each list in order; the largest row is a
    topic.
    """
    relations = h.related.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id", "target_label", "kind", "score", "paper_count"))).alias("cross_relations"))
    topics = h.topics.join(relations, "id", "left")
    last = lambda c, value: F.col(c) == value
    order = [last("iv_root", "unspecified"), last("dv_focus", tx.NO_OUTCOME), F.desc("paper_count"), F.col("label"), F.col("id")]
    queue = [F.desc("claim_count"), F.col("paper_id"), F.col("reason")]
    write_document(
        path,
        ['{"summary":', ',"topics":[', '],"roots":[', '],"repair_queue":[', '],"exclusion_queue":[', "]}"],
        [(h.summary, json_rows(h.summary), []), (topics, json_rows(topics), order), _branches(h), (h.repair, json_rows(h.repair), queue), (h.excluded, json_rows(h.excluded), queue)],
        tasks,
    )

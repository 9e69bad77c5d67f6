"""Topic hierarchies and layers on small tables."""

from pyspark.sql import functions as F

from lodestone.plans import hierarchy, layers

ARTICLES = "paper_id string, title string, year int, claim_count long, article_type string, theories array<string>, sensors array<string>, fronts array<string>, abstract string, main_conclusion string, ordinal long"
ROWS = "paper_id string, row_no int, iv_node_id string, iv_raw string, dv_node_id string, dv_raw string"


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hints(spark, *rows):
    return frame(spark, "ordinal int, node string, hint string", *((i, *r) for i, r in enumerate(rows)))


def articles(spark):
    return frame(
        spark, ARTICLES,
        ("P1", "Daylight at work", 2020, 3, "x", ["T"], ["EEG"], ["F"], None, None, 1),
        ("P2", "Noise and stress", 2021, 5, "x", ["T", "U"], [], None, None, None, 2),
        ("P3", "Medical images", None, 0, "x", None, None, None, None, None, 3),
        ("P4", "A theory of rooms", None, None, None, [], [], [], None, None, 4),
        ("P5", None, None, None, "not_applicable", [], [], [], None, None, 5),
    )


def test_heuristic_hierarchy(spark):
    rows = frame(
        spark, ROWS,
        ("P1", 1, "luminous.daylight.x", "daylight", "affect.stress.eda", "stress"),
        ("P1", 2, None, None, "affect.stress", "self-report rating"),
        ("P9", 1, "luminous.daylight", "", "affect.stress", ""),
    )
    iv = hints(spark, ("luminous.daylight", "daylight"), ("acoustic.noise", "noise"))
    dv = hints(spark, ("affect.stress", "stress"), ("cog.performance", "work"))
    pairs, ivs, dvs = hierarchy.paper_scores(articles(spark), rows, iv, dv)
    # Row 1: luminous.daylight 1.25 + 0.1 + 1.6, affect.stress 1.2 + 0.1 + 1.6. Row 2 falls back on the title on both sides: 0.9 each.
    assert [(*r[:3], round(r[3], 6)) for r in got(pairs)] == [("P1", "luminous.daylight", "affect.stress", 2.9), ("P1", "luminous.daylight", "cog.performance", 0.9)]
    assert [(*r[:2], round(r[2], 6)) for r in got(ivs)] == [("P1", "luminous.daylight", 4.85), ("P2", "acoustic.noise", 1.0)]
    assert [(*r[:2], round(r[2], 6)) for r in got(dvs)] == [("P1", "affect.stress", 2.9), ("P1", "cog.performance", 1.9), ("P1", "neural", 0.8), ("P2", "affect.stress", 1.0), ("P4", "mechanism_or_pathway", 1.1)]
    h = hierarchy.heuristic(articles(spark), rows, iv, dv, "medical images")
    # P1: 2.9 + 0.15 * (4.85 + 2.9); its second pair is below 0.55 of that. P2 has no rows: 0.75 + 0.1 + 0.1 + 0.15 + 0.15.
    assert got(h.members) == [("acoustic_noise__affect_stress", "P2", None, 1.25), ("luminous_daylight__affect_stress", "P1", None, 4.062)]
    assert [(r["label"], r["paper_count"], r["theories"], r["sensors"], r["fronts"]) for r in h.topics.collect()] == [("Daylight -> Stress", 1, ["T"], ["EEG"], ["F"]), ("Noise -> Stress", 1, ["T", "U"], [], [])]
    assert got(h.repair.select("paper_id", "reason")) == [("P4", "missing dominant IV")]
    assert got(h.excluded.select("paper_id")) == [("P3",), ("P5",)]
    assert got(h.related.select("id", "score")) == [("acoustic_noise__affect_stress", 5.0), ("luminous_daylight__affect_stress", 5.0)]
    s = h.summary.first()
    assert (s["article_count"], s["visible_article_count"], s["hidden_article_count"], s["excluded_article_count"], s["fallback_iv_paper_count"], s["fallback_dv_paper_count"], s["topic_count"], s["cross_relation_count"]) == (5, 2, 1, 2, 3, 2, 2, 2)


NODES = "id string, label string, iv_root string, iv_root_label string, iv_node string, iv_label string, dv_root string, dv_root_label string, dv_focus string, dv_focus_label string, theories array<string>"


def test_canonical_hierarchy(spark):
    node = lambda i, n, theories: (i, i.upper(), "l", "L", n, n, "a", "A", "a.s", "S", theories)
    nodes = frame(spark, NODES, node("t1", "l.d", ["U", "V"]), node("t2", "l.e", None), node("t3", "l.f", []))
    m = frame(spark, "paper_id string, topic_id string, role string, confidence double", ("P1", "t1", "secondary", 0.4), ("P1", "t1", "primary", 0.2), ("P2", "t1", "secondary", None), ("P2", "t2", "primary", 0.9), ("P2", "t8", "secondary", 0.9), ("P7", "t1", "primary", 1.0))
    hidden = frame(spark, "paper_id string, reason string, missing_iv boolean, missing_dv boolean", ("P3", "old", True, True))
    h = hierarchy.canonical(articles(spark), m, hidden, nodes, "MEDICAL")
    assert got(h.members) == [("t1", "P1", "primary", 0.2), ("t1", "P2", "secondary", 0.0), ("t2", "P2", "primary", 0.9)]
    top = [(r["id"], r["paper_count"], r["theories"], [x["paper_id"] for x in r["paper_preview"]]) for r in h.topics.collect()]
    assert top == [("t1", 2, ["U", "T", "V"], ["P1", "P2"]), ("t2", 1, ["T", "U"], ["P2"])]
    assert [(r["iv_node"], r["paper_count"]) for r in h.children.collect()] == [("l.d", 2), ("l.e", 1)]
    assert [(r["iv_root"], r["paper_count"], r["child_count"]) for r in h.roots.collect()] == [("l", 2, 2)]
    assert got(h.repair.select("paper_id", "reason")) == [("P2", "membership references missing topic node t8"), ("P4", "no visible canonical topic membership"), ("P5", "no visible canonical topic membership")]
    assert got(h.excluded.select("paper_id", "reason")) == [("P3", "old")]
    none = hierarchy.canonical(articles(spark).limit(0), m, hidden, nodes, "x")
    assert none.topics.count() == 0 and none.summary.first()["article_count"] == 0


def test_layers(spark):
    claims = frame(spark, "belief_id string, paper_id string, content_preview string, incoming_support_count int, incoming_attack_count int, contradiction_count int, warrant_status string", ("b1", "P1", "x", None, 2, 0, None), ("b2", "P1", "y", 1, 2, 0, "IN"), (None, "P2", None, 0, 0, 0, None))
    edges = frame(spark, "ordinal int, source string, target string, relation string, scheme_hint string, strength double", *((i, "b2", "b1", " Attack", f"h{i}", None) for i in range(5)), (9, "gone", "b1", "support", None, 0.12345))
    targets = frame(spark, "ordinal int, belief_id string, paper_id string, resolution_question string, review_urgency string, attack_scheme_hints array<string>", (1, "b1", "P1", "first", "a", []), (2, "b1", "P1", "last", "b", ["h"]), (3, "b2", None, "no", None, None))
    rows = layers.claim_nodes(claims, edges, targets).collect()
    assert [r["belief_id"] for r in rows] == ["b2", "b1", None]
    b1 = rows[1]
    assert (b1["resolution_question"], [x["scheme_hint"] for x in b1["top_attacks"]], b1["top_attacks"][0]["source_preview"]) == ("last", ["h0", "h1", "h2"], "y")
    assert [(x["source"], x["source_paper_id"], x["strength"]) for x in b1["top_supports"]] == [("gone", None, 0.123)] and rows[0]["top_attacks"] is None
    papers = frame(spark, "paper_id string, belief_id string, content_preview string, contradiction_count int, claim_count int, dominant_stance string, theories array<string>", ("P1", None, "z", None, 2, None, list("abcdefghij")), (None, "B", None, 1, None, "pro", None))
    assert [(r["paper_id"], len(r["theories"]), r["search_target_count"]) for r in layers.paper_nodes(papers, targets).collect()] == [("B", 0, 0), ("P1", 8, 2)]
    none = layers.claim_nodes(claims.limit(0), edges.limit(0), targets.limit(0))
    assert none.count() == 0 and layers.dashboard(claims, edges.where(F.lit(False))).first().asDict() == {"article_count": 3, "evidence_count": 0, "evaluated": 0, "target": 15}

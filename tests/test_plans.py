"""Composite dataflows on small evidence tables."""

from pyspark.sql import functions as F

from lodestone.plans import arguments, classes, evidence, submissions, sync, topics


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TOPICS = "id string, label string, iv_root string, iv_root_label string, iv_node string, iv_label string, dv_focus string, dv_focus_label string, paper_ids array<string>, paper_count long, theories array<string>, sensors array<string>, fronts array<string>"


def test_crosswalk_is_additive(spark):
    defended = frame(spark, TOPICS, ("l__s", "Light -> Stress", "luminous", "Lighting", "luminous.day", "Day", "affect.stress", "Stress", ["P1", "P2"], 2, ["T"], [], []), ("a__s", "Sound -> Stress", "acoustic", "Sound", "acoustic.n", "Noise", "affect.stress", "Stress", ["P1"], 1, [], [], []))
    working = defended.where("id = 'l__s'").withColumns({"paper_ids": F.array(*map(F.lit, ["P1", "P2", "P3"])), "paper_count": F.lit(3).cast("long")})
    rows = topics.crosswalk(defended, working)
    assert [(r["topic_id"], r["defended_paper_count"], r["working_paper_count"]) for r in rows.collect()] == [("l__s", 2, 3), ("a__s", 1, 1)]
    assert [tuple(r) for r in topics.crosswalk_index(rows, "outcome_term_id", "outcome_label").collect()] == [("affect.stress", "Stress", 3, ["a__s", "l__s"], 2)]
    assert topics.crosswalk_index(rows, "iv_root", "iv_root_label").count() == 2


MEMBERS = "paper_id string, topic_ids array<string>, primary_topic_id string, secondary_topic_ids array<string>, iv_roots array<string>, dv_focuses array<string>, confidence double, visibility string, hide_reason string"


def test_memberships_and_patches(spark):
    m = frame(spark, MEMBERS, ("P1", ["t1", "t2"], "t1", ["t2"], ["acoustic"], ["mood"], 0.8, "visible", ""), ("P2", [], None, [], [], [], 0.4, "visible", "x"), ("P3", ["t1"], "t1", [], [], [], 0.9, "hidden", "old"))
    assert got(topics.flat_memberships(m)) == [("P1", "t1", "primary", 0.8), ("P1", "t2", "secondary", 0.8)]
    words = "one two three four five six seven eight nine ten"
    p = frame(spark, "paper_id string, iv_root string, dv_focus string, confidence double, extraction_method string, evidence string, ordinal int", ("P1", "luminous", "stress", 0.9, "m", words, 1), ("P1", "thermal", "stress", 0.9, "m", words, 2), ("P2", "acoustic", "mood", 0.5, None, "too short", 3), ("P9", "a", "b", 1.0, None, words, 4))
    out, nodes, summary = topics.reconciled(m, p, frame(spark, "topic_id string, label string", ("t1", "one")))
    row = out.where("paper_id = 'P1'").first()
    assert row["primary_topic_id"] == "thermal__stress" and row["topic_ids"] == ["thermal__stress", "t1", "t2"] and row["iv_roots"] == ["thermal", "acoustic"] and row["confidence"] == 0.9 and row["assignment_method"] == "construct_patch:m"
    assert out.where("paper_id = 'P2'").first()["topic_ids"] == [] and out.count() == 3
    assert sorted(r["topic_id"] for r in nodes.collect()) == ["t1", "thermal__stress"]
    assert summary.first().asDict() == {"conflict_count": 1, "patch_row_count": 2, "provisional_node_count": 1}


def test_topic_choice(spark):
    pairs = frame(spark, "paper_id string, iv_node string, dv_node string, score double", ("P1", "a", "x", 2.0), ("P1", "b", "y", 0.8), ("P1", "c", "x", 1.5))
    iv = frame(spark, "paper_id string, node string, score double", ("P1", "a", 2.0), ("P2", "q", 1.0), ("P2", "r", 0.5))
    dv = frame(spark, "paper_id string, node string, score double", ("P1", "x", 1.0), ("P2", "z", 1.0))
    out = [(r["paper_id"], r["iv_node"], r["dv_node"], round(r["quality"], 3)) for r in topics.chosen_pairs(pairs, iv, dv).orderBy("paper_id", "rank").collect()]
    assert out == [("P1", "a", "x", 2.45), ("P1", "c", "x", 1.65), ("P2", "q", "z", 1.25), ("P2", "r", "z", 1.125)]
    lex = frame(spark, "node string, hint string", ("lum", "daylight"), ("lum", "light"), ("ac", "noise"))
    arts = frame(spark, "paper_id string, title string, abstract string, main_conclusion string", ("P", "Daylight and noise", "noise", None))
    assert [(a, b, round(c, 3)) for a, b, c in got(topics.article_scores(arts, lex))] == [("P", "ac", 1.6), ("P", "lum", 2.0)]


def test_hierarchy(spark):
    rows = frame(spark, "paper_id string, iv_node string, dv_focus string, theories array<string>, sensors array<string>", ("P1", "luminous.day.x", "affect.stress.eda", ["T"], ["EDA"]), ("P2", "luminous.day", "affect.stress", None, ["EEG", "EDA"]), ("P2", "luminous.day", "affect.stress", [], []))
    r = topics.hierarchy(rows).first()
    assert (r["id"], r["label"], r["paper_count"], r["theories"], r["sensors"]) == ("luminous_day__affect_stress", "Day -> Stress", 2, ["T"], ["EDA", "EEG"])
    assert ("iv_root", "luminous", 2) in got(topics.level_counts(rows))


def test_evidence(spark):
    claims = frame(
        spark,
        "ordinal int, paper_id string, statement string, claim string, claim_text string, quote string, claim_role string, warrant_type string, evidence_profile struct<warrant_type:string>, theory_name string, theory_names array<string>, structured_result_row struct<test_statistic:string>, paper_title string, title string, doi string, year string",
        (1, "P1", "EEG rose with daylight", None, None, None, "mechanism_claim", None, None, None, ["A", "B"], ("t=2",), None, "A title", "10.1/x", "2020"),
        (2, "P1", None, "Survey says so", None, None, None, None, None, None, ["B"], None, "Other", None, None, "x"),
        (3, None, "lost", None, None, None, None, None, None, None, None, None, None, None, None, None),
    )
    rows = evidence.evidence_rows(claims).orderBy("evidence_no").collect()
    assert [(r["evidence_no"], r["paper_id"], r["bridge"], r["discount"], r["instruments"]) for r in rows] == [(1, "P1", "mechanism", 0.8, ["EEG"]), (2, "P1", "empirical_association", 0.8, [])]
    assert rows[0]["chain"] == "Mechanism bridge (d=0.80) · claim role: Mechanism Claim · statistic: t=2" and evidence.dropped_claims(claims).first()[0] == 1
    a = evidence.articles(claims).first()
    assert (a["title"], a["doi"], a["year"], a["claim_count"], a["theories"]) == ("A title", "10.1/x", 2020, 2, ["B", "A"])
    beliefs = frame(spark, "paper_id string, credence_value double, omega_json string", ("P1", 0.5, '{"omega": 0.4}'), ("P1", 0.7, "bad"), (" ", 1.0, None), ("P2", 0.9, None))
    assert [(p, round(c, 3), o, n) for p, c, o, n in got(evidence.belief_scores(beliefs))] == [("P1", 0.6, 0.4, 2), ("P2", 0.9, None, 1)]
    t = frame(spark, "paper_id string, year int, theories array<string>, topics array<string>, clusters array<string>", ("P1", 2020, ["A", "B"], ["t"], ["c"]), ("P2", 2021, ["A"], ["t"], []))
    assert got(evidence.theory_index(t)) == [("A", "B", 3.0, 1), ("B", "A", 3.0, 1)]
    assert got(evidence.theories(t)) == [("a", "A", 2, ["P2", "P1"]), ("b", "B", 1, ["P1"])]


def test_instruments_and_policies(spark):
    schema = "ordinal int, paper_id string, statement string, claim string, claim_text string, quote string, claim_role string, warrant_type string, evidence_profile struct<warrant_type:string>, theory_name string, theory_names array<string>, structured_result_row struct<test_statistic:string,comparison:string,outcome:string>, iv string, dv string, abstract_clean_text string, primary_type string, likely_types array<string>"
    none = (None,) * 3
    claims = frame(
        spark, schema,
        (1, "P1", "x", *none, None, None, None, "Prospect theory", None, (None, "skin conductance rose", "cortisol"), "light", "PVT ", "eeg  eeg used", "theory_derived", None),
        (2, "P2", "x", *none, None, "multi_result_integration_to_synthesis_field", None, None, None, None, None, None, None, None, ["FUNCTIONAL", "Theory_Derived"]),
        (3, "P3", "x", *none, None, "multi_result_integration_to_synthesis_field", None, None, None, None, None, None, None, None, []),
    )
    rows = {r["paper_id"]: r for r in evidence.evidence_rows(claims).collect()}
    assert rows["P1"]["instruments"] == ["EEG", "EDA", "Cortisol", "PVT"] and rows["P1"]["bridge"] == "theory_derived"
    assert rows["P2"]["bridge"] == "functional" and rows["P3"]["bridge"] == "functional"
    assert {r["bridge"] for r in evidence.evidence_rows(claims.drop("likely_types")).where("paper_id <> 'P1'").collect()} == {"empirical_association"}


def test_page_candidates(spark):
    ranked = frame(spark, "paper_id string, list string, page int, place int, reasons array<string>", ("P", "figure", 3, 1, ["big"]), ("P", "table", 3, 2, ["tab"]), ("P", "sample", 4, 1, ["who"]), ("P", "table", 5, 5, ["late"]), ("P", "results", 6, 4, []))
    pictures = frame(spark, "paper_id string, page int, filename string, width int, height int", ("P", 3, "a", 220, 160), ("P", 4, "b", 500, 500), ("P", 5, "c", 500, 500), ("P", 3, "d", 219, 900))
    pages = frame(spark, "paper_id string, page int, filename string", ("P", 3, "p3"), ("P", 5, "p5"), ("P", 6, "p6"), ("P", 4, "p4"))
    out = [(r["filename"], r["score"], r["kind"], r["reasons"]) for r in evidence.page_candidates(ranked, pictures, pages).orderBy("rank").collect()]
    assert out == [
        ("p3", 12, "results_surface", ["big", "tab"]), ("a", 10, "stimulus_or_result_figure", ["big", "tab"]), ("b", 6, "experimental_context", ["who"]),
        ("p6", 6, "results_surface", []), ("p4", 2, "experimental_context", ["who"]), ("c", 1, "supplemental_visual", []),
    ]


def test_fronts_and_gaps(spark):
    schema = "front_id string, label string, title string, name string, size long, papers array<string>, paper_ids array<string>, mean_credence double, mean_omega double, mean_warrant double, shared_theories array<string>, theories array<string>, shared_constructs array<string>, topic_ids array<string>, maturity string, maturity_label string, n_contradictions long, contradiction_count long, n_replications long, replication_count long"
    none = (None,) * 4
    rows = frame(spark, schema, ("f1", "Stress front", None, None, 0, ["P1", "P2"], None, None, None, None, *none, "established", None, None, None, None, None), ("f2", None, "Brain", None, 20, [], None, 0.5, 0.8, None, *none, "established", None, None, 2, None, None))
    f = evidence.fronts(rows, frame(spark, "paper_id string, mean_credence double, mean_omega double", ("P1", 0.4, 0.6), ("P2", 0.6, None)))
    assert [(r["id"], r["cat"], r["n"], r["voi"]) for r in f.collect()] == [("f2", "Neuroscience", 20, 0.8), ("f1", "Physiological", 2, 0.6)]
    assert [tuple(r) for r in evidence.gaps(f).collect()] == [("f2", "conflict", "Brain", "high"), ("f1", "untested", "Stress front", "medium")]


def test_arguments(spark):
    claims = frame(spark, "belief_id string, paper_id string, content_preview string, incoming_support_count int, incoming_attack_count int, warrant_status string", ("b1", "P1", "x", 2, 1, "DEFEATED"), ("b2", "P1", "y", None, 0, "in"), ("b3", "P2", "z", 1, 1, None), ("", "P3", "q", 1, 1, None))
    edges = frame(spark, "source string, target string, relation string, scheme_hint string, strength double", ("b3", "b1", "attack", "", 0.5), ("b2", "b3", " Support ", "s", 0.1), ("b1", "b9", "attack", "h", 0.9))
    assert got(arguments.paper_totals(claims, edges)) == [("P1", 2, 1, 1, 1, 1, 0), ("P2", 1, 1, 1, 0, 0, 1)]
    assert [r["target"] for r in arguments.attack_examples(claims, edges).collect()] == ["b9", "b1"]
    assert got(arguments.scheme_counts(edges)) == [("h", 1), ("unspecified_attack", 1)]
    targets = frame(spark, "ordinal int, belief_id string, paper_id string, priority_score double, attack_scheme_hints array<string>", (1, "b1", "P1", 0.1, ["u", "v"]), (2, "b2", "P1", 0.9, ["v"]))
    assert got(arguments.search_targets(targets, 1)) == [("P1", 2, ["b2"], ["v", "u"])]


def test_sync(spark):
    c = frame(spark, "source_id string, target_id string", ("P1_MPX_1", "P1_MPX_2"), ("bel_P2_V5_1", "P1_MPX_1"), (None, "junk"))
    assert got(sync.constraint_pass(c)) == [("P1", 2), ("P2", 1)]
    b = sync.belief_pass(frame(spark, "belief_id string, paper_id string", ("P1_MPX_1", "P1"), ("z", None)), frame(spark, "belief_id string, warrant_status string", ("P1_MPX_1", "IN")), c)
    assert got(b) == [("P1", 1, ["IN"], 2)]
    q = frame(spark, "question_id string, topic string", ("q1", "Wayfinding in malls"), ("q2", "Other"))
    assert got(sync.question_pass(q, frame(spark, "paper_id string, keywords array<string>", ("P1", ["navigation"]), ("P2", ["mold"])))) == [("P1", 1, ["q1"])]
    reg = frame(spark, "paper_id string, n_constraints_from_paper long", ("P1", 0), ("P3", 0))
    out = sync.synced(reg, sync.constraint_pass(c), sync.interpretation_pass(reg, q))
    assert got(out) == [("P1", 2, 2), ("P3", None, 2)]
    assert tuple(sync.pass_summary(sync.constraint_pass(c), out, ["n_constraints_from_paper"], 0.95).first()) == (1, 1, 1, True)
    unfilled = sync.synced(reg.drop("n_constraints_from_paper"), frame(spark, "paper_id string, n_constraints_from_paper long", ("P9", 1)))
    source = frame(spark, "paper_id string", ("P1",), ("P3",), ("P9",), (None,))
    assert tuple(sync.pass_summary(source, unfilled, ["n_constraints_from_paper"], 0.95).first()) == (2, 0, 1, False)
    assert got(sync.verified(out, ["n_constraints_from_paper"])) == [("all_empty", 1, 2), ("n_constraints_from_paper", 1, 2)]


def test_class_totals(spark):
    e = frame(spark, "offering_id string, user_id string, role string, track string, f160_track string, status string", ("o", "u1", "student", "t1", None, "active"), ("o", "u2", "student", "t2", None, "dropped"), ("o", "u3", "student", "t1", None, "active"))
    u = frame(spark, "user_id string, first_name string, last_name string, email string", *((x, "A", "B", "e") for x in ("u1", "u2", "u3")))
    d = frame(spark, "dossier_id string, user_id string, offering_id string, deliverable_id string, points_awarded double, graded_at string, is_final int", ("d1", "u1", "o", "A0", 5.0, "1", 1), ("d2", "u1", "o", "A0", 7.0, "2", 1), ("d3", "u1", "o", "A0", 9.0, "2", 1), ("d4", "u1", "o", "T1", 3.0, "1", 1), ("d5", "u1", "o", "T2", 2.0, "1", 1), ("d6", "u1", "o", "A1", 8.0, "9", 0))
    dl = frame(spark, "offering_id string, deliverable_id string, track string", ("o", "A0", None), ("o", "A1", None), ("o", "T1", "t1"), ("o", "T2", "t2"))
    rows = {r["user_id"]: r for r in classes.student_totals(e, u, d, dl).collect()}
    assert set(rows) == {"u1", "u3"}
    assert (rows["u1"]["a0_pts"], rows["u1"]["a1_pts"], rows["u1"]["track_pts"], rows["u1"]["total_pts"], rows["u1"]["last_graded_at"]) == (9.0, 0.0, 3.0, 14.0, "2")
    assert rows["u3"]["total_pts"] == 0.0 and rows["u3"]["last_graded_at"] is None
    assert classes.one_final(d).first()["deliverable_id"] == "A0"
    assert got(classes.grading_queue(e, dl, d).select("offering_id", "user_id", "deliverable_id")) == [("o", "u3", "A0"), ("o", "u3", "A1"), ("o", "u3", "T1")]


def test_assignment(spark):
    q = frame(spark, "question_id string", ("Q1",), ("Q2",))
    schema = "question_id string, user_id string, round int, released_at string, task1_count int, task2_count int"
    c = frame(spark, schema, ("Q1", "u", 1, None, 3, 1), ("Q2", "v", 1, "x", 9, 9))
    assert classes.current_round(q, c).first()[0] == 2
    assert [tuple(r) for r in classes.question_need(q, c).collect()] == [("Q2", 0, 0, 0, 0, "high"), ("Q1", 1, 3, 1, 4, "high")]
    assert tuple(classes.assigned(q, c).first()) == ("Q2", 2)
    assert got(classes.repairable(q, c, "v", 1)) == [("Q2",)]


def test_submissions(spark):
    known = frame(spark, "article_id string, pdf_hash string, doi string, title string, authors string", ("ART-0001", "h", None, "A known title of a paper", None))
    new = frame(spark, "ordinal int, pdf_hash string, pdf_valid boolean, doi string, title string, authors string, abstract string", (1, "x", False, None, "Bad file here for sure", None, None), (2, "h", True, None, "z", None, None), (3, None, None, None, "Fresh words about methods and results", None, "participants"))
    out = submissions.staged(new, known)
    assert got(out.select("article_id", "status")) == [("ART-0002", "rejected"), ("ART-0003", "duplicate"), ("ART-0004", "staged")]
    done = submissions.decided(out, frame(spark, "article_id string, decision string, decided_at string", ("ART-0004", "accepted", "1"), ("ART-0002", "accepted", "1")))
    assert got(done.select("article_id", "status")) == [("ART-0002", "rejected"), ("ART-0003", "duplicate"), ("ART-0004", "accepted")]
    assert got(submissions.log_rows(out, done)) == [("ART-0004", "staged->accepted")]

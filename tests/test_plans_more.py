"""Plans that no query runs: hand-worked tables."""

from pyspark.sql import functions as F

from lodestone.plans import arguments, classes, evidence, submissions, sync, topics


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, schema, *rows):
    return spark.createDataFrame(rows, schema)


def test_article_details(spark):
    articles = frame(spark, "paper_id string, title string", ("p1", "A"), ("p2", "B"), ("p3", "C"))
    beliefs = frame(spark, "paper_id string, credence_value double, omega_json string", ("p1", 0.2, '{"omega": 0.5}'), (" p1 ", 0.4, "bad"), ("p2", 0.9, None), ("", 1.0, None), (None, 1.0, None))
    totals = frame(spark, "paper_id string, n_arguments int", ("p2", 4))
    rows = frame(spark, "paper_id string, evidence_no int, statement string, bridge string", *((p, n, f"{p}-{n}", "b") for p in ("p1", "p2") for n in range(5, 0, -1)))
    out = {r["paper_id"]: r for r in evidence.article_details(articles, beliefs, totals, rows, k=2).collect()}
    assert out["p1"]["mean_omega"] == 0.5 and abs(out["p1"]["mean_credence"] - 0.3) < 1e-9 and out["p1"]["percentile"] == 50.0 and out["p2"]["percentile"] == 100.0
    assert [e["statement"] for e in out["p1"]["evidence"]] == ["p1-1", "p1-2"] and out["p2"]["n_arguments"] == 4 and out["p3"]["evidence"] is None and out["p3"]["percentile"] is None


def test_paper_notes_and_mechanisms(spark):
    notes = frame(spark, "paper_id string, node_id string, summary string", ("p2", None, "x  y"), ("p1", "n1", "z" * 500), ("p3", " ", None))
    out = evidence.paper_pnus(notes).collect()
    assert [(r["paper_id"], r["node_id"]) for r in out] == [("p1", "n1"), ("p2", "unspecified"), ("p3", "unspecified")]
    assert len(out[0]["summary"]) == 400 and out[0]["summary"].endswith("…") and out[1]["summary"] == "x y"
    own, cross = frame(spark, "name string, word_count int", ("m1", 0), ("m2", 299)), frame(spark, "name string, word_count int, pair string", ("m3", 300, "a-b"), ("m4", 600, "c-d"), ("m5", None, None))
    assert got(evidence.mechanism_inventory(own, cross).select("name", "scope", "readiness")) == [("m1", "framework", "missing"), ("m2", "framework", "stub"), ("m3", "cross_framework", "brief"), ("m4", "cross_framework", "full"), ("m5", "cross_framework", "missing")]


def test_edges_of_papers(spark):
    edges = frame(spark, "source string, target string, paper_ids string", ("a", "b", '["p1", "p2"]'), ("b", "c", '["p1"]'), ("a", "b", '["p1"]'), ("x", "y", "bad"), ("x", "y", None))
    assert got(sync.bn_pass(edges)) == [("p1", 3, ["a", "b", "c"]), ("p2", 1, ["a", "b"])]


def test_class_counts(spark):
    runs = frame(spark, "offering_id string, deliverable_id string, run_at string, score double", ("o", "A0", "1", 0.1), ("o", "A0", "3", 0.2), ("o", "A0", "3", 0.3), ("o", "A1", "2", 0.4), ("o", "lost", "2", 0.5))
    listed = frame(spark, "offering_id string, deliverable_id string, title string", ("o", "A0", "First"), ("o", "A1", "Second"))
    assert got(classes.calibration(runs, listed).select("deliverable_id", "score", "title")) == [("A0", 0.2, "First"), ("A0", 0.3, "First"), ("A1", 0.4, "Second")]
    s, d, a = frame(spark, "offering_id string", ("o",), ("o",), ("p",)), frame(spark, "offering_id string, is_final int", ("o", 1), ("o", 0)), frame(spark, "offering_id string, status string", ("o", "open"), ("o", "closed"), ("p", "open"))
    assert got(classes.grading_counts(s, d, a, "o")) == [(2, 1, 1)]


def test_clusters_queue_and_own_submissions(spark):
    clusters = frame(spark, "cluster_id string, paper_ids array<string>", ("c1", [f"p{i}" for i in range(20)]), ("c2", ["q"]))
    assert [(r["cluster_id"], len(r["paper_ids"])) for r in arguments.debate_clusters(clusters, "p18").collect()] == [("c1", 16)] and arguments.debate_clusters(clusters).count() == 2
    articles = frame(spark, "paper_id string, title string, article_type string, claim_count int", ("p1", "Retracted: x", "review", 5), ("p2", "Thin", " Not_applicable ", 1), ("p3", "Kept", "review", 5), ("p4", "Whole", "review", 5))
    missing = frame(spark, "paper_id string, missing_iv boolean, missing_dv boolean", ("p1", True, True), ("p2", True, True), ("p3", True, False), ("p4", False, False))
    assert got(topics.exclusion_queue(articles, missing, "retracted").select("paper_id", "state")) == [("p1", "excluded"), ("p2", "excluded"), ("p3", "review")]
    mine = frame(spark, "submitter_id string, status string, n int", ("u", "staged", 1), ("u", "rejected", 2), ("v", "staged", 3))
    assert got(submissions.my_submissions(mine, "u").select("n")) == [(1,), (2,)] and got(submissions.my_submissions(mine, "u", "staged").select("n")) == [(1,)]
    assert got(evidence.mechanism_inventory(mine.select(F.col("n").alias("word_count")), mine.select(F.col("n").alias("word_count")).limit(0)).select("scope").distinct()) == [("framework",)]

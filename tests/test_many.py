"""Operators over hot groups and many users, against sequential loops."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from lodestone.operators import aggregates, graphs, ordering
from lodestone.plans import classes


def test_samples_of_strata(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 50 + ["a", "b", None])) for i in range(4000)] + [(7, "hot"), (7, "hot"), (None, "a"), (5000, "one")]
    df = spark.createDataFrame(rows, "key long, stratum string").repartition(5)
    digest = lambda k, seed: hashlib.md5(f"{'' if k is None else k}:{seed}".encode()).hexdigest()
    for rate, seed in ((0.1, 7), (0.0, 3), (1.0, 1)):
        want = []
        for s in {s for _, s in rows}:
            own = sorted((digest(k, seed), -1 if k is None else k) for k, x in rows if x == s)
            want += [(k, s) for _, k in own[: max(1, int(len(own) * rate))]]
        got = [(-1 if r["key"] is None else r["key"], r["stratum"]) for r in ordering.audit_sample(df, ["stratum"], rate, seed, "key").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert ordering.audit_sample(df, [], 0.5, 2, "key").count() == len(rows) // 2
    assert ordering.audit_sample(df.limit(0), ["stratum"], 0.5, 2, "key").collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(3000, 3000), (None, 5), (6, None)]
    edges += [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(250)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    got = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shared_samples_count_once(spark):
    papers = [("c1", "p1", 100), ("c1", "p2", 80), ("c1", "p3", 50), ("c1", "p1", 90), ("c2", "p1", 100), ("c2", "p3", 50), ("c3", "p9", None), (None, "p1", 1), ("c1", None, 1)]
    edges = [("p1", "p2"), ("p2", "p3"), ("p3", "p3"), ("p9", "p10")]
    got = aggregates.unique_samples(spark.createDataFrame(papers, "claim string, paper string, n int"), spark.createDataFrame(edges, "a string, b string"), "claim", "paper", "n")
    # In c2 the paper that joins p1 and p3 is missing, so they are apart.
    assert sorted(map(tuple, got.collect())) == [("c1", 3, 230, 100, True), ("c2", 2, 150, 150, False), ("c3", 1, 0, 0, False)]


def test_many_users_are_assigned_as_one_after_the_other(spark):
    rng = random.Random(2)
    questions = [f"Q{i:02d}" for i in range(37)]
    claims, seen = [], set()
    for _ in range(300):
        key = (rng.choice(questions), rng.randrange(1, 12))
        if key not in seen:
            seen.add(key)
            claims.append((key[0], f"u{rng.randrange(50)}", key[1], rng.choice([None, "x"]), rng.randrange(9), rng.randrange(4)))
    for users in (5, 2000, 10_000):
        total = {q: sum(c[4] + c[5] for c in claims if c[0] == q and c[3] is None) for q in questions}
        need, taken, want, first = sorted(questions, key=lambda q: (total[q], q)), set(seen), [], 1
        for _ in range(users):
            while first <= 99 and len([1 for q in questions if (q, first) in taken]) == len(questions):
                first += 1
            free = [q for q in need if (q, first) not in taken] if first <= 99 else []
            want.append((free[0], first) if free else (need[0], 2))
            taken.add(want[-1])
        q = spark.createDataFrame([(x,) for x in questions], "question_id string")
        c = spark.createDataFrame(claims, "question_id string, user_id string, round int, released_at string, task1_count int, task2_count int")
        u = spark.createDataFrame([(f"v{i:05d}", i) for i in range(users)], "user_id string, came int").repartition(4)
        got = classes.assigned_all(q, c, u, "came").orderBy("user_id").collect()
        assert [(r["question_id"], r["round"]) for r in got] == want
    assert classes.assigned_all(q.limit(0), c, u, "came").collect() == []
    assert tuple(classes.assigned_all(q, c, u.limit(1), "came").first())[1:] == tuple(classes.assigned(q, c).first())


def test_hierarchy_document(spark, tmp_path):
    from lodestone.plans.hierarchy import write_hierarchy
    from lodestone.queries_layers import _hierarchy

    h = _hierarchy(spark, "/root/testdata/sf0.001")
    write_hierarchy(h, f"{tmp_path}/h.json")
    doc = json.loads((tmp_path / "h.json").read_text())
    assert list(doc) == ["summary", "topics", "roots", "repair_queue", "exclusion_queue"]
    assert [t["id"] for t in doc["topics"]] == [r["id"] for r in h.topics.collect()]
    roots, children = {r["iv_root"]: r for r in h.roots.collect()}, {(r["iv_root"], r["iv_node"]): r for r in h.children.collect()}
    assert [r["id"] for r in doc["roots"]] == list(roots) and len({t["id"] for r in doc["roots"] for c in r["children"] for t in c["topics"]}) == len(doc["topics"])
    for r in doc["roots"]:
        assert (r["label"], r["paper_count"], r["child_count"]) == (roots[r["id"]]["label"], roots[r["id"]]["paper_count"], len(r["children"]))
        for c in r["children"]:
            assert (c["label"], c["paper_count"]) == (children[r["id"], c["id"]]["label"], children[r["id"], c["id"]]["paper_count"])
            assert c["topics"] == sorted(c["topics"], key=lambda t: (-t["paper_count"], t["label"]))
    assert len(doc["repair_queue"]) == h.repair.count() and doc["summary"]["topic_count"] == len(doc["topics"])
    assert sum(len(t["cross_relations"] or []) for t in doc["topics"]) == h.related.count()

"""Operators on small tables with known answers."""

import random

from pyspark.sql import functions as F

from lodestone.functions.matching import CONFIDENCE
from lodestone.operators import aggregates as agg
from lodestone.operators import dedup, filters, joins, ordering, related, sets


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filters(spark):
    df = frame(spark, "id int, s string, a array<string>, v double", (1, "x", ["a"], None), (2, "", [], 1.0), (3, None, None, None))
    assert [r[0] for r in df.where(filters.any_filled(df, ["s", "a"])).collect()] == [1]
    assert [r[0] for r in df.where(filters.all_empty(df, ["s", "a", "v"])).collect()] == [3]
    assert filters.optional(df, id=2, s=None).count() == 1
    m = frame(spark, "p string, confidence double, visibility string, hide_reason string", ("a", 0.8, "visible", ""), ("b", 0.5, "visible", ""), ("c", None, "hidden", "old"))
    assert got(filters.hidden_unless(m, filters.defended(F.col("confidence")), "weak").select("p", "visibility", "hide_reason")) == [("a", "visible", ""), ("b", "hidden", "weak"), ("c", "hidden", "old")]
    assert got(filters.focused(df.select("id"), F.col("id") == 2)) == [(2,)] and filters.focused(df.select("id"), F.col("id") == 9).count() == 3


def test_joins(spark):
    t = frame(spark, "k string, at int, v int", ("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", None, 4))
    assert got(joins.latest(t, ["k"], "at")) == [("a", 2, 2), ("a", 2, 3)]
    assert got(joins.latest(t, ["k"], "at", ties=False)) == [("a", 2, 2), ("b", None, 4)]
    c = frame(spark, "k string, confidence double, ordinal int", ("a", 0.5, 1), ("a", 0.5, 2), ("a", 0.4, 3))
    assert got(joins.best_confidence(c, ["k"], "confidence", "ordinal")) == [("a", 0.5, 2)]
    ids = frame(spark, "k string", ("a",), (None,))
    assert got(joins.anti(t.select("k"), ids, ["k"])) == [("b",)]
    b = frame(spark, "b string", ("P1_MPX_001",), ("bel_P2_V5_3",), ("other",), (None,))
    assert [r[0] for r in b.select(joins.paper_of(F.col("b"))).collect()] == ["P1", "P2", None, None]
    q, p = frame(spark, "q int, keywords array<string>", (1, ["a", "b"]), (2, ["z"])), frame(spark, "p string, keywords array<string>", ("x", ["a", "b"]), ("y", ["b", "z"]))
    assert got(joins.keyword_matches(q, p, "q", "p")) == [("x", 1, [1]), ("y", 2, [1, 2])]
    edges, nodes = frame(spark, "source string, target string", ("a", "b"), ("a", "?")), frame(spark, "n string, w int", ("a", 1), ("b", 2))
    assert got(joins.endpoints(edges, nodes, "n", ["w"]).select("source_w", "target_w")) == [(1, 2), (1, None)]
    s, d = frame(spark, "o int, u string", (1, "u"), (1, "w")), frame(spark, "o int, d string", (1, "A"), (1, "B"))
    assert joins.missing_pairs(s, d, ["o"], frame(spark, "u string, d string", ("u", "A")), ["u", "d"]).count() == 3


def test_aggregates(spark):
    e = frame(spark, "source string, target string, papers string", ("a", "b", '["p","q"]'), ("a", "a", '["p"]'), ("c", None, "bad"))
    assert got(agg.degrees(e, "source", "target")) == [("a", 3), ("b", 1), ("c", 1)]
    assert got(agg.participation(e, [F.col("source"), F.col("target")])) == [("a", 2), ("b", 1), ("c", 1)]
    assert got(agg.edges_by_paper(e, "papers")) == [("p", 2, ["a", "b"]), ("q", 1, ["a", "b"])]
    empty = frame(spark, "v double")
    assert got(agg.summary(empty, "v")) == [(0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    r = frame(spark, "a int, b int", *([(1, 1)] * 20 + [(0, 0)] * 15 + [(1, 0)] * 5 + [(0, 1)] * 10))
    assert abs(agg.kappa(r, "a", "b").first()["kappa"] - 0.4) < 1e-9
    x = frame(spark, "g string, m string, v double", ("x", "a", 3.0), ("x", "b", 1.0))
    assert got(agg.concentration(x, ["g"], "m", F.col("v"))) == [("x", 10 / 16, 2)]
    h = agg.heterogeneity(frame(spark, "g string, y double, se double", ("x", 1.0, 1.0), ("x", 3.0, 1.0), ("x", 5.0, 1.0)), ["g"], "y", "se").first()
    assert (h["mean"], h["q"], round(h["i_squared"], 6)) == (3.0, 8.0, 75.0)
    c = frame(spark, "k string, v string, n int", ("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("a", "x", 4), ("a", "z", 5))
    assert got(agg.most_common(c, ["k"], "v", "n", 2).select("v", "n", "rank")) == [("x", 2, 1), ("y", 2, 2)]
    s = frame(spark, "status string, gating boolean, worth double", ("PASS", True, 4.0), ("WARN", False, 4.0), ("FAIL", False, 4.0))
    assert s.agg(agg.points(F.col("status"), F.col("worth")), agg.gate(F.col("status"), F.col("gating"))).first() == (6.0, True)
    t = frame(spark, "u string, i string, kind string", ("1", "a", "t"), ("1", "b", "t"), ("2", "a", "c"), ("2", "b", "c"))
    assert got(agg.cooccurrence(t, "u", "i", {"t": 1.0, "c": 2.0}, "kind")) == [("a", "b", 3.0)]
    f = lambda *rows: frame(spark, "path string, content binary", *rows)
    assert got(agg.compared_files(f(("a", b"1"), ("b", b"2")), f(("a", b"1"), ("b", b"3"), ("c", b"")))) == [("a", "same"), ("b", "differs"), ("c", "only_right")]
    m = frame(spark, "tags map<string,double>", ({"x": 1.0, "y": 3.0},), ({"x": 2.0},))
    assert got(agg.mean_by_key(m, "tags")) == [("x", 1.5, 2), ("y", 3.0, 1)]
    assert agg.tally(frame(spark, "s string", ("good",), ("bad",), ("good",)), {"s": ("good", "missing")}).first() == (3, 2, 0)
    assert got(agg.completeness(frame(spark, "a string, b string", ("x", "y"), ("x", "")), ["a", "b"])) == [(0.5, "partial")]


def test_ordering(spark):
    rng = random.Random(2)
    vs = [rng.randrange(20) for _ in range(60)]
    df = frame(spark, "i int, v int", *enumerate(vs))
    want = sorted((i, round(100 * sum(x <= v for x in vs) / 60, 1)) for i, v in enumerate(vs))
    assert got(ordering.percentile_rank(df, "v").select("i", "percentile")) == sorted(want, key=repr)
    order = sorted(range(60), key=lambda i: (vs[i], i))
    assert got(ordering.numbered(df, "n", F.col("v"), F.col("i")).select("n", "i")) == sorted(((n + 1, i) for n, i in enumerate(order)), key=repr)
    assert got(ordering.sampled(df, 5, 7, "i")) == got(ordering.sampled(df.repartition(7), 5, 7, "i"))
    assert ordering.audit_sample(df.withColumn("g", F.col("i") % 4), ["g"], 0.2, 1, "i").groupBy("g").count().where("count = 3").count() == 4
    s = frame(spark, "g string, n string, s double", ("x", "a", 2.0), ("x", "b", 1.2), ("x", "c", 1.0), ("y", "d", 0.8))
    assert got(ordering.near_top(s, ["g"], "s", 0.55, 0.9, 3, ["n"]).select("n", "rank")) == [("a", 1), ("b", 2)]
    page, total = ordering.page(df, 3, 2, F.col("i"))
    assert ([r["i"] for r in page.collect()], total) == ([2, 3, 4], 60)
    assert [r[0] for r in frame(spark, "v string", ("low",), ("high",), ("?",)).orderBy(ordering.by_rank(F.col("v"), ["high", "low"])).collect()] == ["high", "low", "?"]


def test_sets(spark):
    a, b = frame(spark, "k int, x string, y string", (1, "a", "b"), (2, "c", "d")), frame(spark, "k int, y string, z int", (1, "", 5), (3, "n", 6))
    assert got(sets.merged(a, b, "k")) == [(1, "a", "b", 5), (2, "c", "d", None), (3, None, "n", 6)]
    assert got(sets.id_union(a, b, "k")) == [(1,), (2,), (3,)] and got(sets.id_difference(a, b, "k")) == [(2,)]


def test_duplicate_cascade(spark):
    schema = "article_id string, pdf_hash string, doi string, title string, authors string"
    known = frame(spark, schema, ("K1", "h1", "10.1/A", "Effects of daylight on sleep quality", "Smith, J."), ("K2", "h2", None, "Noise and attention in open offices", "Doe, A."), ("K3", None, "10.1/c", "Short one", None))
    new = frame(spark, schema, ("N1", "h2", "10.1/a", "x", None), ("N2", None, " 10.1/a ", "Noise and attention in open offices", None), ("N3", None, None, "Effects of the daylight on sleep quality", "Smith, J."), ("N4", None, None, "Noise and attention in open offices: a survey", "Other, Z. Q. R."), ("N5", None, None, "Noise and attention", None), ("N6", None, None, "Short one", None), ("N7", None, None, "Completely different matter here", None))
    assert got(dedup.duplicate_cascade(new, known)) == [("N1", "K2", "exact_hash", "definitive"), ("N2", "K1", "exact_doi", "definitive"), ("N3", "K1", "title_and_authors_fuzzy", "very_high"), ("N4", "K2", "title_fuzzy_authors_differ", "medium"), ("N5", "K2", "title_fuzzy_1word", "high")]
    assert set(CONFIDENCE.values()) == {"definitive", "very_high", "high", "medium"}


def test_within_one_word(spark):
    from test_functions import python_distance

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(3, 5)))) for i in range(80)]
    want = []
    for i, t in rows:
        near = [j for j, u in rows if j != i and python_distance(t.split(), u.split()) <= 1]
        if near:
            want.append(i)
    found = got(dedup.within_one_word(frame(spark, "i int, t string", *rows), "i", F.col("t")))
    texts = dict(rows)
    assert sorted(i for i, _ in found) == sorted(want)
    assert all(i != j and python_distance(texts[i].split(), texts[j].split()) <= 1 for i, j in found)


def test_related(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcde") for _ in range(2)], [rng.choice("xyz")], rng.random() < 0.3) for i in range(40)]
    want = []
    for i, f, t, s in rows:
        scored = []
        for j, g, u, r in rows:
            score = min(2, len(set(f) & set(g))) + 2 * len(set(t) & set(u)) + (1 if s and r else 0)
            if i != j and score > 0:
                scored.append((-score, j))
        want += [(i, j, float(-s_), n) for n, (s_, j) in enumerate(sorted(scored)[:4], 1)]
    df = frame(spark, "id int, f array<string>, t array<string>, s boolean", *rows)
    assert got(related.related(df, "id", {"f": (1.0, 2.0), "t": (2.0, None)}, "s")) == sorted(want, key=repr)


def test_numbering_of_millions_of_rows_in_small_partitions(spark):
    """Adaptive execution with a small advisory size gives every row once, numbered 1 to n in order."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        n = 2_000_000
        df = spark.range(n).select(F.xxhash64("id").alias("h"), "id")
        out = ordering.numbered(df, "n", F.col("h")).withColumn("by_h", F.col("n"))
        seen = out.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()
        assert tuple(seen) == (n, n, 1, n, n)
        # In order: the greatest hash of each thousand lies below the least of the next.
        blocks = out.groupBy(F.floor(F.col("n") / 1000).alias("b")).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).orderBy("b").collect()
        assert all(a["hi"] < b["lo"] for a, b in zip(blocks, blocks[1:], strict=False))
        total = ordering.running_total(spark.range(50_000).select("id", (F.col("id") % 7).alias("w")), "w", "t", F.col("id"))
        assert total.where(F.col("id") == 49_999).first()["t"] == sum(i % 7 for i in range(50_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_summary_and_percentiles_with_nulls(spark):
    rows = [("a", 5.0), ("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", None), (None, 4.0), (None, 4.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert got(agg.summary(df, "v", ["g"])) == sorted([("a", 4, 2.75, 2.5, 3.0, 1.0, 5.0), ("b", 0, 0.0, 0.0, 0.0, 0.0, 0.0), (None, 3, 3.0, 4.0, 4.0, 1.0, 4.0)], key=repr)
    assert got(agg.summary(df.where("v < 0"), "v")) == [(0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert got(ordering.percentile_rank(df, "v", ["g"]).select("g", "v", "percentile")) == sorted([("a", 5.0, 100.0), ("a", 1.0, 25.0), ("a", 3.0, 75.0), ("a", 2.0, 50.0), ("b", None, None), (None, 4.0, 100.0), (None, 4.0, 100.0), (None, 1.0, 33.3)], key=repr)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lists_one_word_apart_by_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))) for i in range(300)] + [(1000 + i, f"annual report {i}") for i in range(50)] + [(2000, "same title here"), (2001, "same title here")]
    words = {i: t.split() for i, t in rows if len(t.split()) >= 3}
    want = {i: min((j for j, y in words.items() if j != i and _edits(x, y) <= 1), default=None) for i, x in words.items()}
    found = dict(map(tuple, dedup.within_one_word(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()))
    assert found == {i: j for i, j in want.items() if j is not None}


def test_cascade_by_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["light", "day", "daylight", "in", "offices", "circadian", "lighting", "x"])
    titles = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(160)] + ["Circadian lighting", "The Circadian Lighting, in Offices", "lighting", "arcadian lightings", None, "", "!!!"]
    schema = "article_id string, pdf_hash string, doi string, title string, authors string"
    new = [(f"n{i:03}", None, None, t, rng.choice([None, "A B", "C"])) for i, t in enumerate(titles)]
    known = [(f"k{i:03}", None, None, t, rng.choice([None, "A B"])) for i, t in enumerate(rng.sample(titles, 60))]
    norm = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = {}
    for i, _, _, t, _ in new:
        x = norm(t)
        if len((t or "").strip()) <= 10 or not x:
            continue
        for j, _, _, u, _ in known:
            y = norm(u)
            if not y:
                continue
            a, b = " ".join(x), " ".join(y)
            if a in b or b in a or (min(len(x), len(y)) >= 3 and _edits(x, y) <= 1):
                want[i] = min(want.get(i, j), j)
    out = dedup.duplicate_cascade(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)).collect()
    assert {r["article_id"]: r["match_id"] for r in out} == want and all(r["match_type"] and r["confidence"] for r in out)


def test_percentiles_halfway_between_tenths_round_as_in_sql(spark):
    import duckdb

    n = 2000  # every second share of 2,000 rows ends in five hundredths
    want = duckdb.sql(f"SELECT i, round(100.0 * cume_dist() OVER (ORDER BY i), 1) FROM range({n}) t(i)").fetchall()
    assert want[0] == (0, 0.1) and want[2] == (2, 0.2)
    assert got(ordering.percentile_rank(spark.range(n).withColumnRenamed("id", "i"), "i").select("i", "percentile")) == sorted(want, key=repr)


def test_ladders_add_in_row_order_whatever_the_files(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng, n = random.Random(6), 400
    frame(spark, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", *((i, i, "OFP"[i % 3], "5-LOW") for i in range(n))).write.parquet(f"{tmp_path}/orders.parquet")
    for part in range(3):
        lines = [(i, part * 3 + j + 2, rng.randrange(9) / 100, rng.randrange(11) / 100, float(rng.randrange(1, 51)), "NR"[i % 2]) for j in range(3) for i in range(n)]
        df = frame(spark, "l_orderkey long, l_linenumber int, l_tax double, l_discount double, l_quantity double, l_returnflag string", *lines)
        df.coalesce(1).write.parquet(f"{tmp_path}/{part}")
        found = next((tmp_path / str(part)).glob("*.parquet"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        found.rename(tmp_path / "lineitem.parquet" / f"part-{part}.parquet")
    c = duckdb.connect(config={"threads": 1})  # on more threads DuckDB adds in other orders
    c.execute(f"CREATE VIEW orders AS FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    c.execute(f"CREATE VIEW lineitem AS FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got(entry.queries()["q144_ladders"](spark, str(tmp_path))) == sorted(c.execute(entry.oracle_sql()["q144_ladders"]).fetchall(), key=repr)


def test_halves_of_the_last_decimal_round_as_in_sql(spark):
    import duckdb

    from lodestone.functions.collections import rounded

    want = [r[0] for r in duckdb.sql("SELECT round((2 * i + 1) / CAST(2000000 AS DOUBLE), 6) FROM range(5000) t(i) ORDER BY i").fetchall()]
    df = spark.range(5000).select(((2 * F.col("id") + 1) / F.lit(2000000.0)).alias("v")).orderBy("v")
    assert [r[0] for r in df.select(rounded(F.col("v"), 6)).collect()] == want
    assert [r[0] for r in df.select(rounded(-F.col("v"), 6)).collect()] == [-x for x in want]
    assert [r[0] for r in df.select(F.round("v", 6)).collect()] != want

import random

from lodestone.operators import lexicon
from lodestone.plans import submissions, topics

SCHEMA = "ordinal int, pdf_hash string, pdf_valid boolean, doi string, title string, authors string, abstract string"
KNOWN = "article_id string, pdf_hash string, doi string, title string, authors string"


def norm(t):
    return "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    pre = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[pre:] == b[pre + 1 :] or (len(a) == len(b) and a[pre + 1 :] == b[pre + 1 :])


def matches(x, y):
    a, b = norm(x), norm(y)
    return bool(a and b) and (" ".join(a) in " ".join(b) or " ".join(b) in " ".join(a) or (min(len(a), len(b)) >= 3 and within_one(a, b)))


def sequential(new, known):
    """One submission after the other: (article_id, status, match_id)."""
    table = sorted(known)
    number, out = max((int(k[0].split("-")[1]) for k in known), default=0), []
    for n, (_, h, valid, doi, title, authors, _) in enumerate(new, 1):
        name = f"ART-{number + n:04d}"
        hit = None
        if valid is not False:
            by_hash = (k for k in table if h is not None and k[1] == h)
            d = (doi or "").strip().lower()
            by_doi = (k for k in table if d and k[2] is not None and k[2].lower() == d)
            by_title = (k for k in table if len((title or "").strip(" ")) > 10 and matches(title, k[3]))
            hit = next(by_hash, None) or next(by_doi, None) or next(by_title, None)
        out.append((name, "rejected" if valid is False else "duplicate" if hit else "staged", hit and hit[0]))
        table.append((name, h, doi, title, authors) if valid is not False else (name, h, None, None, authors))
    return out


def test_intake_equals_a_sequential_loop(spark):
    rng = random.Random(11)
    words = ["light", "day", "daylight", "in", "offices", "circadian", "lighting", "noise", "x1", "sleep", "learning", "green", "views", "and", "stress"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
    titles = [title() for _ in range(900)] + [None, "", "!!!", "Circadian lighting"]
    new = [(i, rng.choice([None, None, f"h{rng.randrange(900)}"]), rng.choice([None, None, True, True, False]), rng.choice([None, None, None, "", " ", f" 10.1/A{rng.randrange(900)}", f"10.1/a{rng.randrange(900)} "]), rng.choice(titles), rng.choice([None, "A B"]), None) for i in range(1500)]
    known = [(f"ART-{i:04d}", rng.choice([None, f"h{rng.randrange(900)}"]), rng.choice([None, f"10.1/a{rng.randrange(900)}"]), rng.choice(titles[:60]), None) for i in range(1, 60, 2)]
    got = submissions.staged(spark.createDataFrame(rng.sample(new, len(new)), SCHEMA), spark.createDataFrame(known, KNOWN))
    rows = got.select("article_id", "status", "match_id").orderBy("ordinal").collect()
    want = sequential(new, known)
    assert list(map(tuple, rows)) == want
    assert {x[1] for x in want} == {"staged", "duplicate", "rejected"}


def test_ids_stay_whole_and_chains_of_a_batch(spark):
    new = [(i, None, None, None, f"paper number {i}" if i < 19_990 else "the same title again", None, None) for i in range(20_000)]
    got = submissions.staged(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([("ART-0007", None, None, None, None)], KNOWN)).select("ordinal", "article_id", "status", "match_id").collect()
    ids = {r["ordinal"]: r["article_id"] for r in got}
    assert len(set(ids.values())) == 20_000 and ids[0] == "ART-0008" and ids[9_991] == "ART-9999" and ids[9_992] == "ART-10000"
    last = sorted((r for r in got if r["ordinal"] >= 19_990), key=lambda r: r["ordinal"])
    assert [r["status"] for r in last] == ["staged"] + ["duplicate"] * 9 and {r["match_id"] for r in last[1:]} == {ids[19_990]}
    assert submissions.staged(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], KNOWN)).collect() == []


def test_lexicon_of_many_hints_in_shards(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    hints = [(f"n{rng.randrange(50)}", word(rng.randrange(1, 7))) for _ in range(3000)] + [("n1", ""), (None, "a"), ("n2", None)]
    texts = [(i, word(rng.randrange(0, 60)).upper() if i % 3 else word(40), 0.5 * (i % 4)) for i in range(200)] + [(None, "abc", 1.0), (7, None, 1.0), (7, "abc", 2.0)]
    want = {}
    for i, t, w in texts:
        for node, hint in {h for h in hints if h[0] and h[1]}:
            if hint in (t or "").lower():
                want[i, node] = want.get((i, node), 0.0) + w
    t = spark.createDataFrame(texts, "id long, text string, weight double").repartition(3)
    h = spark.createDataFrame(hints, "node string, hint string")
    got = topics.lexicon_hits(t, h, "id", "text").collect()
    assert {(r["id"], r["node"]): round(r["score"], 6) for r in got} == {k: round(v, 6) for k, v in want.items()}
    patterns = h.where("node is not null and hint <> ''").groupBy("hint").count().selectExpr("hint AS pattern", "array('a') AS values")
    small = lexicon.held_values(t, patterns, "id", "text", shard_chars=500).groupBy("id").sum("n").collect()
    whole = lexicon.held_values(t, patterns, "id", "text").groupBy("id").sum("n").collect()
    assert sorted(map(str, small)) == sorted(map(str, whole))


def test_least_holders_send_a_row_a_pattern(spark):
    texts = spark.createDataFrame([(f"{i} a title that all share {i % 7}", i) for i in range(3000)], "text string, id long")
    patterns = spark.createDataFrame([("title that",), ("share 6",), ("absent",)], "pattern string")
    assert sorted(map(tuple, lexicon.least_holder(texts, patterns).collect())) == [("share 6", 6), ("title that", 0)]
    held = lexicon.least_held(texts.select("text"), patterns.withColumn("id", patterns.pattern), shard_chars=5)
    assert {r["id"] for r in held.collect()} == {"share 6", "title that"} and held.count() == 3000

import random

from pyspark.sql import functions as F

from lodestone.plans import deltas, sync
from lodestone.scratch import scratch, written

BELIEFS, CONSTRAINTS, EDGES = "belief_id string, paper_id string, warrant_status string", "source_id string, target_id string", "source string, target string, paper_ids string"


def shown(df):
    zero = lambda r: all(not x for x in r[1:])
    return {r[0]: tuple(tuple(x) if isinstance(x, list) else x for x in r[1:]) for r in df.collect() if not zero(r)}


def whole(spark, b, c, e):
    """The passes over all rows."""
    beliefs, constraints, edges = spark.createDataFrame(b, BELIEFS), spark.createDataFrame(c, CONSTRAINTS), spark.createDataFrame(e, EDGES)
    own = sync.belief_pass(beliefs, beliefs.select("belief_id", "warrant_status"), constraints)
    out = own.join(sync.constraint_pass(constraints), "paper_id", "full").join(sync.bn_pass(edges), "paper_id", "full")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    a = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return shown(out.select("paper_id", n("n_beliefs"), a("warrant_types"), n("n_en_constraints"), n("n_constraints_from_paper"), n("n_bn_edges"), a("bn_nodes")))


def test_random_changes_equal_a_full_sync(spark):
    rng = random.Random(12)
    paper = lambda: f"p{rng.randrange(12)}"
    belief = lambda k: (f"{paper()}:b{k}", rng.choice([paper(), None]), rng.choice([None, "weak", "strong"]))
    held = [[belief(k) for k in range(60)], [], []]
    ids = [b[0] for b in held[0]]
    constraint = lambda: (rng.choice([*ids, "", None]), rng.choice(ids))
    edge = lambda: (rng.choice("abcdef"), rng.choice(["x", "y", None]), rng.choice(['["%s"]' % paper(), '["%s", "%s"]' % (paper(), paper()), "bad", None]))
    held[1], held[2] = [constraint() for _ in range(80)], [edge() for _ in range(80)]
    schemas = (BELIEFS, CONSTRAINTS, EDGES)
    frames = lambda parts: [spark.createDataFrame(x, s) for x, s in zip(parts, schemas)]
    state = written(deltas.tallies(*map(deltas.signed, frames(held))), scratch(spark, "tallies"))
    counts = written(deltas.paper_counts(state), scratch(spark, "counts"))
    assert shown(counts) == whole(spark, *held)
    for turn in range(3):
        gone = [rng.sample(x, min(len(x), 12)) for x in held]
        new = [[belief(1000 + 50 * turn + k) for k in range(5)], [constraint() for _ in range(9)], [edge() for _ in range(9)]]
        change = deltas.tallies(*(deltas.signed(a, b) for a, b in zip(frames(new), frames(gone))))
        for x, g, n in zip(held, gone, new):
            for row in g:
                x.remove(row)
            x += n
        counts, state = deltas.resynced(counts, state, change)
        counts, state = written(counts, scratch(spark, "counts")), written(state, scratch(spark, "tallies"))
        assert shown(counts) == whole(spark, *held)
    some = deltas.tallies(*(deltas.signed(f) for f in frames([[("p3:new", "p3", "weak")], [], []])))
    assert [r[0] for r in deltas.touched_papers(state, some).collect()] == ["p3"]


def test_what_cancels_leaves_nothing(spark):
    rows = [spark.createDataFrame(x, s) for x, s in (([("p1:a", "p1", "weak")], BELIEFS), ([("p1:a", "p2:b")], CONSTRAINTS), ([("a", "b", '["p1"]')], EDGES))]
    assert deltas.tallies(*(deltas.signed(f, f) for f in rows)).collect() == []
    state = deltas.tallies(*map(deltas.signed, rows))
    back = deltas.tallies(*(deltas.signed(f.limit(0), f) for f in rows))
    counts, after = deltas.resynced(deltas.paper_counts(state), state, back)
    assert counts.collect() == [] and after.collect() == []

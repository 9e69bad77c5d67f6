import random

import pytest

from lodestone.operators.related import related


def brute(rows, features, flag, k):
    out = []
    for i, x, f in rows:
        scored = []
        for j, y, g in rows:
            if i == j:
                continue
            s = 1.0 * bool(flag and f and g)
            for c, (p, m) in enumerate(features):
                n = len((set(x[c] or ()) & set(y[c] or ())) - {None})
                s += p * (min(n, m) if m is not None else n)
            if s > 0:
                scored.append((-s, j))
        out += [(i, j, -s, n + 1) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [0, 8, 1000])
def test_best_others_at_any_frequency(spark, hot_rows):
    rng = random.Random(6)
    pick = lambda name, n, most: [f"{name}{int(rng.paretovariate(0.8)) % n}" for _ in range(rng.randrange(most))]
    rows = [(i, (pick("f", 9, 4), pick("t", 12, 6), [None, *pick("c", 60, 3)] if i % 5 else None), rng.random() < 0.3 if i % 7 else None) for i in range(150)]
    features = {"fronts": (2.0, None), "theories": (1.0, 2), "constructs": (1.5, 1)}
    df = spark.createDataFrame([(i, *x, f, "x") for i, x, f in rows], "id long, fronts array<string>, theories array<string>, constructs array<string>, sensors boolean, other string")
    for flag in ("sensors", None):
        got = related(df, "id", features, flag, k=4, hot_rows=hot_rows)
        assert sorted((r["id"], r["other"], r["score"], r["rank"]) for r in got.collect()) == brute(rows, list(features.values()), flag, 4)


def test_hot_value_of_many_rows(spark):
    """One value in 100,000 rows makes no pairs: 10^10 would not end. Rows that share a rare value too still find each other."""
    df = spark.range(100_000).selectExpr("id", "array('everywhere', concat('r', id % 40000)) AS values")
    got = related(df, "id", {"values": (1.0, None)}, k=2).where("id IN (5, 99999)").collect()
    assert sorted(tuple(r) for r in got) == [(5, 40005, 2.0, 1), (5, 80005, 2.0, 2), (99999, 19999, 2.0, 1), (99999, 59999, 2.0, 2)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, values array<string>")
    assert related(df, "id", {"values": (1.0, None)}).collect() == []

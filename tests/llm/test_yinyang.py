import hashlib
import math
import random

import numpy as np
import pytest
from helpers import SF, table

from lodestone.llm.queries import op12_yinyang
from lodestone.llm.yinyang import Round, cluster, grouped, squared_distances


def brute(rows, k=40, rounds=5, seed=2, dims=64):
    """Plain Lloyd rounds over (id, vector)."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = sorted(good, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), -1 if r[0] is None else r[0], r[1]))[:k]
    places = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(places))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in good]
        for j in range(len(places)):
            own = [v for (_, v), o in zip(good, of) if o == j]
            if own:
                places[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in good]
    return sorted(((i, j, d, sum(x[1] for x in found if x[2] == j), sum(x[1] for x in found), sha(",".join(map(str, places[j])))) for i, d, j in found), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_given_embeddings(spark):
    assert got(op12_yinyang(spark, SF)) == brute([(r["vec_id"], r["embedding"]) for r in table("embeddings")])


def test_odd_rows_ties_and_fewer_distances(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(4 * (i % 12), 0.3) for _ in range(3)]) for i in range(400)]
    rows += [(500 + i, [float(rng.randrange(3)) for _ in range(3)]) for i in range(150)]  # many ties
    rows += [(700 + i, [1.0, 2.0, 3.0]) for i in range(200)]  # one very common vector
    rows += [(1000, None), (1001, []), (1002, [1.0, 2.0]), (1003, [1.0, float("nan"), 0.0]), (1004, [1.0, None, 0.0]), (1005, [float("-inf"), 0.0, 0.0]), (1006, [1.0] * 4)]
    rows += [(None, [0.0, 0.0, 0.0]), (None, [5.0, 5.0, 5.0]), (3, rows[3][1]), (3, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(5)
    report = {}
    assert got(cluster(df, k=24, dims=3, group_size=5, report=report)) == brute(rows, k=24, dims=3)
    assert report["worked"] < 0.6 * report["full"]


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert got(cluster(spark.createDataFrame([], schema))) == []
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [3.0, 1.0])]
    assert got(cluster(spark.createDataFrame(rows, schema), dims=2)) == brute(rows, dims=2)
    with pytest.raises(ValueError, match="2\\^26"):
        cluster(spark.createDataFrame([(1, [1e9, 0.0])], schema), dims=2)


def test_bounds_never_change_an_assignment():
    """The filters against a full scan over many random rounds, with large moves and large components too."""
    rng = np.random.default_rng(1)
    for size in (4, 300, 2**25):
        x = rng.integers(-size, size, (300, 5))
        c = rng.integers(-size, size, (23, 5))
        groups, moves = grouped(c, 6), np.zeros(23)
        state = np.full(300, -1), np.zeros(300), np.zeros((300, groups.max() + 1))
        for turn in range(30):
            *state, known, _ = Round(c, groups, moves).assign(x, *state)
            full = squared_distances(x, c)
            assert (state[0] == full.argmin(axis=1)).all()
            assert ((known < 0) | (known == full.min(axis=1))).all()
            new = c + rng.integers(-size, size, c.shape) // (1 + turn % 7 * 4) * (rng.random((23, 1)) < 0.7)
            moves, c = np.sqrt(((new - c).astype(float) ** 2).sum(axis=1)) * (1 + 1e-12), new

import math
import random

import pytest
from helpers import SF, table
from pyspark.sql import functions as F

from lodestone.llm.exact_topk import top_k
from lodestone.llm.queries import op4_exact_topk


def brute(rows, every, k, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            best = {}
            for j, v in good:
                if j != i:
                    best[j] = max(best.get(j, -(2**62)), sum(a * b for a, b in zip(q, v)))
            if i in (x[0] for x in out):
                continue
            for rank, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((i, rank, j, s))
    return sorted(out)


def test_given_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings")]
    assert sorted(map(tuple, op4_exact_topk(spark, SF).collect())) == brute(rows, 50, 5)


@pytest.mark.parametrize(("block", "group"), [(1000, 1000), (40, 3)])
def test_odd_vectors_ties_and_extra_columns(spark, block, group):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, -0.25, 0.0, 1.0, 0.0, 0.0]) for i in range(90)]  # one very common vector
    rows += [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 6), (904, [float("inf"), 1.0]), (905, [1.0, None]), (None, [1.0] * 6), (907, [0.0] * 6), (910, [0.1] * 9), (300, [0.5, -0.25, 0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, block long")
    got = top_k(df, F.col("vec_id") % 10 == 0, 5, block_rows=block, group_rows=group)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = top_k(df, F.col("vec_id") == 0, 5)
    assert list(map(tuple, got.orderBy("rank").collect())) == [(0, 1, 1, 256 * 128 + 512 * 128), (0, 2, 2, -256 * 256)]
    assert top_k(df.limit(0), F.col("vec_id") == 0, 5).collect() == []


def test_fewer_postings_than_a_full_scan(spark):
    """Vectors with few large components: the proof comes before the low levels are read, and results stay exact."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.0, 0.004, -0.01, 4.0, -3.0]) + rng.gauss(0, 0.01) for _ in range(12)]) for i in range(1200)]
    report = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 100 == 0, 5, block_rows=300, group_rows=7, report=report)
    assert sorted(map(tuple, got.collect())) == brute(rows, 100, 5)
    assert 0 < report["read"] < 0.8 * report["held"]


def test_an_id_with_several_vectors_asks_with_all(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [i / 10, (20 - i) / 10]) for i in range(1, 20)]
    want, scored = [], {}
    for _, q in rows[:2]:
        for j, v in rows[2:]:
            scored[j] = max(scored.get(j, -(10**9)), sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v)))
    want = [(0, n + 1, j, x) for n, (j, x) in enumerate(sorted(scored.items(), key=lambda t: (-t[1], t[0]))[:5])]
    for size in (3, 1000):
        got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5, block_rows=size)
        assert sorted(map(tuple, got.collect())) == want

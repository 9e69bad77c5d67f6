import math
import random

import pytest
from helpers import SF, table
from pyspark.sql import functions as F

from lodestone.llm.hard_negatives import mine_negatives
from lodestone.llm.queries import op11_hard_negatives


def brute(rows, every, positives=5, negatives=3):
    """In plain loops; rows: (id, label, vector)."""
    good = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, l, q in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j, m) for j, m, v in good if j != i]
        for p, j, m in sorted(x for x in scored if x[2] == l)[:positives]:
            fits = sorted(x for x in scored if x[2] != l and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(i, j, n + 1, x[1], -p, -x[0]) for n, x in enumerate(fits[:negatives])]
    return sorted(out)


def test_given_embeddings(spark):
    rows = [(r["vec_id"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table("embeddings")]
    assert sorted(map(tuple, op11_hard_negatives(spark, SF).collect())) == brute(rows, 50)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame([(i, l, v, "x", 1) for i, l, v in rows], "vec_id long, label int, embedding array<double>, id string, win long")
    return sorted(map(tuple, mine_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **kw).collect()))


@pytest.mark.parametrize(("file_rows", "digit"), [(1000, 10), (40, 5)])
def test_odd_rows_and_ties(spark, file_rows, digit):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.random() for _ in range(5)]) for i in range(200)]
    rows += [(300 + i, i % 2, [0.5, 0.25, 0.0, 0.5, 0.1]) for i in range(120)]  # one very common vector, in two labels
    rows += [(500 + i, 7, [0.4, 0.2, 0.0, 0.4, 0.1]) for i in range(50)]
    rows += [(900, 1, None), (901, 1, []), (902, 1, [1.0]), (903, 1, [float("nan")] * 5), (904, 1, [float("inf")]), (905, 1, [1.0, None]), (None, 1, [1.0] * 5), (910, None, [1.0] * 5)]
    rows += [(920, 2, [0.1] * 9), (930, 2, [-1.0] * 5), (940, 1, [0.0] * 5), (300, 0, [0.5, 0.25, 0.0, 0.5, 0.1]), (310, 2, [0.9, 0.1, 0.2, 0.3, 0.4]), (310, 1, [0.1, 0.1, 0.2, 0.3, 0.4])]
    assert mined(spark, rows, file_rows=file_rows, digit=digit) == brute(rows, 10)


def test_large_components(spark):
    """Products beyond 53 bits go by integers; beyond 56 bits they are refused."""
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.random() * 6e5 for _ in range(3)]) for i in range(60)]
    assert mined(spark, rows) == brute(rows, 10)
    with pytest.raises(ValueError, match="2\\^56"):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1e9])])


def test_few_and_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.7]), (3, 2, [0.99])]) == [(0, 1, 1, 2, 65536, 179 * 256)]

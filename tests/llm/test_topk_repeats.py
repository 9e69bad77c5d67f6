from pyspark.sql import functions as F

from lodestone.llm.exact_topk import top_k


def test_ids_that_repeat_leave_the_others_their_places(spark):
    """An id repeated ten times, in equal rows and in different ones, counts once by its best row."""
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, 1.0])] * 10 + [(2, [8.0 - i / 10, 1.0]) for i in range(10)] + [(i, [7.0 - i / 2, 0.5]) for i in range(3, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -(10**9)), int(v[0] * 256 // 1) * 256)
    want = [(0, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    for block_rows in (1, 4, 8192):
        got = top_k(df, F.col("vec_id") == 0, k=5, block_rows=block_rows).collect()
        assert sorted(map(tuple, got)) == want

import corpus_pipeline as cp
from helpers import SF


def text(n):
    return " ".join(f"w{n}x{i}" for i in range(60))


def test_near_dedup_goes_by_rows(spark):
    """Null and repeated ids: one row of each group stays, whatever its id; rows of other groups are no copies."""
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (3, text(4)), (6, text(5)), (None, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r)[:2] for r in cp.simhash_near_dedup(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, text(0)), (None, text(1)), (7, text(2)), (5, text(3)), (3, text(4)), (6, text(5)), (None, ""), (5, "")], key=str)

import hashlib
from collections import Counter

import numpy as np
from helpers import ODD, SF, given, table

from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.perfect_hash import PerfectHash, PerfectTable
from lodestone.llm.queries import op1_line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, lines in docs for k in {key(x) for x in lines} if k)
    return sorted((str(i), len(x), sum(count[key(y)] >= least for y in x), "\n".join(y for y in x if count[key(y)] < least)) for i, x in docs)


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 70_000):
        a, b = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        a[: n // 2] = a[0] if n else 0  # many keys may share one half
        index = PerfectHash.build(a, b)
        assert sorted(index.slots(a, b)) == list(range(n))
        held = PerfectTable.from_bytes(PerfectTable.build(a, b, value=np.arange(n)).to_bytes())
        assert (held.values["value"][held.find(a, b)] == np.arange(n)).all()
        if n == 70_000:
            other = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
            assert (held.find(*other) >= 0).sum() < 5


def test_given_documents(spark):
    docs = table("documents")
    got = op1_line_dedup(spark, SF).collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute([(r["doc_id"], r["text"]) for r in docs], 10)]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_odd_rows_and_hot_lines(spark):
    rows = ODD + [(100 + i, f"Common line\nown {i % 7}\ncommon LINE \n") for i in range(40)] + [(200, "\n".join(["common line"] * 500))]
    for probe_rows in (10, 1 << 18):
        got = dedup_lines(given(spark, rows), 3, keys_per_shard=16, probe_rows=probe_rows).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, 3)


def test_copies_of_a_document_spread_over_groups(spark):
    """3,000 copies of one line make one hot key; its probes are dealt to groups of about probe_rows rows."""
    from pyspark.sql import functions as F

    from lodestone.llm.line_dedup import _dealt, _lines

    rows = given(spark, [(i, "one line") for i in range(3000)]).repartition(3)
    keyed = rows.select("text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(7)).alias("k2"))
    lines = keyed.mapInArrow(_lines, "k1 long, k2 long, pos int, a long, b long, first int, turn int").withColumn("shard", F.lit(0).cast("long"))
    plan = spark.createDataFrame([(0, 30)], "shard long, salts int")
    sizes = [r["count"] for r in _dealt(lines, plan).groupBy("shard", "salt").count().collect()]
    assert len(sizes) == 30 and sum(sizes) == 3000 and max(sizes) <= 110


def test_empty_table(spark):
    assert dedup_lines(given(spark, []), 2).collect() == []

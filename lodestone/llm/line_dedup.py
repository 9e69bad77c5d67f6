"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by the documents.

Plan: every document is split into lines and each line's key is hashed to 128
bits; these hashes are written once. A map-side-combined aggregate counts, for
each key, the documents that hold it. The keys are cut into shards of a bounded number
of keys; each shard becomes one minimal perfect hash with an array of 32-bit
fingerprints and an array of counts (about 10 bytes a key). The documents'
line hashes are dealt to the shards and look their counts up in these arrays;
no line is joined with a line. Shards that a very common line makes hot are
probed in several salted groups (the shard is copied to each), so no task
gets more than about ``probe_rows`` rows however frequent a line is. Only the
positions of lines to drop come back to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, dropped, longs, scratch, signed, text_bytes, written
from lodestone.llm.perfect_hash import PerfectTable

KEYS_PER_SHARD = 1 << 16
PROBE_ROWS = 1 << 18
_MOST = np.iinfo(np.uint32).max


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE.encode()).lower()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a key: the row's content hashes, the position, the key's hashes, 1 if the key is new in its text, and a running number."""
    digest = xxhash.xxh3_128_digest
    before = 0
    for batch in batches:
        row, pos, first, keys = [], [], [], []
        for number, text in enumerate(text_bytes(batch["text"])):
            seen: set[bytes] = set()
            for at, line in enumerate(text.split(b"\n")):
                if key := line_key(line):
                    hashed = digest(key)
                    row.append(number)
                    pos.append(at)
                    first.append(hashed not in seen)
                    seen.add(hashed)
                    keys.append(hashed)
        both = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
        take = pa.array(row, pa.int64())
        turn = ((before + np.arange(len(keys))) % (1 << 30)).astype(np.int32)
        before += len(keys)
        yield pa.record_batch(
            {
                "k1": batch["k1"].take(take),
                "k2": batch["k2"].take(take),
                "pos": pa.array(pos, pa.int32()),
                "a": signed(both[:, 0]),
                "b": signed(both[:, 1]),
                "first": pa.array(np.array(first, dtype=np.int32), pa.int32()),
                "turn": pa.array(turn),
            }
        )


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    counts = np.minimum(table["n_docs"].to_numpy(), _MOST).astype(np.uint32)
    shard = PerfectTable.build(longs(table["a"]), longs(table["b"]), count=counts)
    return pa.table({"shard": [key[0].as_py()], "index": pa.array([shard.to_bytes()], pa.binary())})


def _dealt(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines (shard, turn) dealt to the salted groups of their shard.

    The salt goes by the running number that a line was written with, not by
    content: copies of one line, and of one document, spread evenly.
    """
    return lines.join(plan, "shard").withColumn("salt", F.pmod("turn", "salts")).drop("salts", "turn")


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = KEYS_PER_SHARD, probe_rows: int = PROBE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop, from every document, the lines found in at least ``min_docs`` documents.

    Returns ``docs``' id column, ``n_lines`` and ``n_dropped`` (long) and
    ``kept_text`` (the other lines in order, joined by a line feed).

    Each row is a document of its own: repeated rows all count, and all come
    back. A null or empty text is one empty line. Lines that are blank after
    stripping never count and always stay. A null id is kept as it is. Texts
    of any length are split whole. An empty table gives an empty result.
    ``keep`` names columns to carry along; others, whatever their names, are
    not read.
    """
    spark = docs.sparkSession
    # The two hashes identify a row's content; rows that agree in both have the same lines, so sharing hits is right.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(x).alias(f"keep_{x}") for x in keep))
    rows = rows.withColumns({"lines": F.split("text", "\n", -1), "k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(7))})
    lines_at = scratch(spark, "lines")
    lines = written(rows.select("text", "k1", "k2").mapInArrow(_lines, "k1 long, k2 long, pos int, a long, b long, first int, turn int"), lines_at)
    where = scratch(spark, "line-counts")
    counts = written(lines.groupBy("a", "b").agg(F.sum("first").alias("n_docs"), F.count("*").alias("n_rows")), where)
    shards = max(1, math.ceil(counts.count() / keys_per_shard))
    shard = F.pmod(F.col("a"), F.lit(shards))
    counts = counts.withColumn("shard", shard)

    index = counts.select("shard", "a", "b", "n_docs").groupBy("shard").applyInArrow(_build, "shard long, index binary")
    index_at = scratch(spark, "line-index")
    index = written(index, index_at)
    # A few bytes for each shard (not for each line): the number of salted groups that probe it.
    plan = counts.groupBy("shard").agg(F.ceil(F.sum("n_rows") / F.lit(probe_rows)).cast("int").alias("salts"))
    plan_at = scratch(spark, "line-plan")
    plan = written(plan, plan_at)
    dropped(spark, where)

    probes = _dealt(lines.drop("first").withColumn("shard", shard), plan)
    copies = index.join(plan, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "index")

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = asked.select(["k1", "k2", "pos"])
        if not len(asked) or not len(held):
            return out.slice(0, 0)
        table = PerfectTable.from_bytes(held["index"][0].as_py())
        slots = table.find(longs(asked["a"]), longs(asked["b"]))
        return out.filter(pa.array((slots >= 0) & (table.values["count"][np.maximum(slots, 0)] >= min_docs)))

    hits = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "k1 long, k2 long, pos int")
    # Copies of a text repeat its hits: they are made distinct before the collect, which is bounded by one text's lines.
    drop = written(hits.distinct().groupBy("k1", "k2").agg(F.collect_list("pos").alias("drop")), scratch(spark, "line-drops"))
    dropped(spark, lines_at, index_at, plan_at)
    out = rows.join(drop, ["k1", "k2"], "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return out.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("kept_text"),
        *(F.col(f"keep_{x}").alias(x) for x in keep),
    )

"""SimHash near-dedup with deletion-variant signatures.

64-bit fingerprints that differ in at most two bits are linked. A fingerprint
is cut into two halves: of two differing bits, one half holds at most one.
Each half is indexed once for every bit position, with that bit wiped out (32
one-wildcard variants a half); halves that differ in at most one bit share
the variant that wipes it. So an equality join on variants finds every link,
and each candidate is verified by its exact bit count.

Only distinct fingerprints take part, so copies cost nothing. A variant shared
by up to ``bucket`` fingerprints gives their verified pairs. Those of a larger
bucket are linked without pairs: two fingerprints are within two bits exactly
if their balls of radius one meet, so each is dealt to the 65 values of its
ball, and each value links its fingerprints to the smallest of them.

Components come from alternating large-star and small-star steps over edges
between distinct fingerprints, each step written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, longs, scratch, signed, text_bytes, written

SEED = 42
BUCKET = 32
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(words: list[bytes], width: int) -> int:
    """The fingerprint of a word sequence: a bit is 1 if it is set in over half of the shingles' hashes."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(ends) - width]))
    last = ends[width - 1 :] - 1
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _BITS).sum())


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the SimHash of each whole text's word shingles, A-Z lower-cased; 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.lower().split(), width) for x in text_bytes(batch["text"])]
            yield pa.record_batch({"id": batch["id"], "fp": signed(np.array(fps, dtype=np.uint64))})

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 signatures a fingerprint: half number and wiped bit in the upper bits, the half without that bit below."""
    at = np.arange(32, dtype=np.uint64)
    wipe = ~(np.uint64(1) << at) & np.uint64(0xFFFFFFFF)
    for batch in batches:
        fp = longs(batch["fp"])
        for some in np.array_split(fp, max(1, len(fp) // 4096)):
            keys = [(((some[:, None] >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) & wipe) | ((np.uint64(32 * half) + at) << np.uint64(32)) for half in (0, 1)]
            yield pa.record_batch({"key": signed(np.concatenate(keys, axis=1).ravel()), "fp": signed(np.repeat(some, 64))})


def _verified(max_bits: int, bucket: int):
    """Over rows sorted by key: verified pairs of small buckets; the members of larger ones with themselves."""

    def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate(([True], key[1:] != key[:-1]))
        run = np.cumsum(first) - 1
        sizes = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        big = sizes[run] > bucket if len(run) else np.zeros(0, bool)
        left, right = [fp[big]], [fp[big]]
        for step in range(1, min(bucket, int(sizes.max(initial=1)))):
            close = (run[step:] == run[:-step]) & ~big[step:]
            a, b = fp[:-step][close], fp[step:][close]
            near = np.bitwise_count(a ^ b) <= max_bits
            left.append(a[near])
            right.append(b[near])
        return pa.record_batch({"a": signed(np.concatenate(left)), "b": signed(np.concatenate(right))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket may go on in the next batch: up to bucket + 1 of its rows are carried, and a larger one is flagged as it streams.
        key, fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            key, fp = np.concatenate((key, longs(batch["key"]))), np.concatenate((fp, longs(batch["fp"])))
            if not len(key):
                continue
            cut = 0 if key[0] == key[-1] else int(len(key) - np.argmax(key[::-1] != key[-1]))  # where the last run begins
            if len(key) - cut > bucket + 1:
                yield emit(key, fp)
                key, fp = key[-bucket - 1 :], fp[-bucket - 1 :]
            else:
                yield emit(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield emit(key, fp)

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << _BITS))
    for batch in batches:
        fp = longs(batch["fp"])
        for some in np.array_split(fp, max(1, len(fp) // 4096)):
            yield pa.record_batch({"value": signed((some[:, None] ^ flips).ravel()), "fp": signed(np.repeat(some, 65))})


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep every component of the links of at most two bits."""
    spark = distinct.sparkSession
    keyed = distinct.mapInArrow(_variants, "key long, fp long")
    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key", "fp")
    where = scratch(spark, "simhash-pairs")
    pairs = written(dealt.mapInArrow(_verified(2, bucket), "a long, b long"), where)
    hot = pairs.where("a = b").select(F.col("a").alias("fp")).distinct()
    balls = hot.mapInArrow(_balls, "value long, fp long")
    stars = balls.groupBy("value").agg(F.min("fp").alias("a")).join(balls, "value").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the edges (a, b) of long ids; root is the smallest node it reaches.

    Alternates large-star and small-star until the edges are stars. Each round
    reads the last round's table, so a lost executor costs one round's tasks.
    """
    spark = edges.sparkSession
    at = scratch(spark, "edges")
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), at)
    before = None
    for _ in range(max_rounds):
        # Large star: the larger neighbours of each node, and the node itself, go to its smallest neighbour.
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of each node, and the node itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new_at = scratch(spark, "edges")
        new = written(small.where("u <> v").distinct(), new_at)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        dropped(spark, at)
        edges, at = new, new_at
        if tuple(now) == before and now[0] == now[2]:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` (long) and ``component_id``, the smallest id that its links reach.

    Null and empty texts have no words: fingerprint 0, linked like any other.
    Repeated rows share a fingerprint and so a component. Null ids come back
    but are never a component's id unless it has no other. Texts of any length
    count whole. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    at = scratch(spark, "fingerprints")
    fps = written(fingerprints(docs, width, id_col, text_col), at)
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    edges_at = scratch(spark, "links")
    edges = written(links(least.select("fp"), bucket), edges_at)
    roots = components(edges)
    dropped(spark, edges_at)
    labelled = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")

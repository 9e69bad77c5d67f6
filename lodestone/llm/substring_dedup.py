"""Substring dedup by seed and extend over winnowed anchors.

A window is ``width`` consecutive words. A word goes if a window covers it
whose word sequence also starts in a document with a smaller id.

Seeds: of the word k-grams inside a window (k is half the width), the one of
the least hash is the window's anchor. It depends on the window's words alone,
so equal windows hold equal anchors at the same place. Neighbouring windows
mostly share an anchor; such a run of windows is the anchor's frame. About two
anchors in 27 words are written.

Join: anchors that documents of at least two ids hold are found by a map-side
combined aggregate (no pairs), and the other anchors go.

Extend: a seed is extended both ways to its whole frame. Holders of an anchor
whose frames agree in every word form one class, and a class knows its
smallest id. Where an anchor has one class, its windows are settled at once.
Where it has several, the extension stops somewhere between the anchor and the
frame's ends: one holder of each class gives the hashes of its windows, left
and right of the seed, and classes that share a window share the smaller id.
Thousands of holders of a passage therefore cost a row each, never a pair.

Maximal repeats: windows that follow each other merge into spans; a span is at
least ``width`` words long by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import Chunks
from lodestone.llm.common import dropped, longs, mixed, scratch, signed, text_bytes, written

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n, modulo 2**64."""
    if len(_powers.get(base, ())) <= n:
        _powers[base] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(2 * n, 4096), base, np.uint64))), dtype=np.uint64)
    return _powers[base]


class Rolling:
    """Hashes of any run of words of a text: differences of a running polynomial, brought to one scale and mixed."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        self.n = len(words)
        self.back = _power(pow(_BASE, -1, 2**64), self.n)
        hashes = np.fromiter(map(digest, words), dtype=np.uint64, count=self.n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _power(_BASE, self.n)[: self.n], dtype=np.uint64)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        start = np.arange(self.n - k + 1)
        return self.spans(start, start + k)


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` consecutive hashes stands; of equal ones the last."""
    at, step = np.arange(len(hashes)), 1

    def later(shift: int, n: int) -> np.ndarray:
        a, b = at[:n], at[shift : shift + n]
        return np.where(hashes[b] <= hashes[a], b, a)

    while 2 * step <= width:
        at = later(step, len(at) - step)
        step *= 2
    return later(width - step, len(hashes) - width + 1) if width > step else at


def _anchors(width: int):
    k = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for row, text in enumerate(text_bytes(batch["text"])):
                words = text.split()
                if len(words) < width:
                    continue
                rolling = Rolling(words)
                grams = rolling.grams(k)
                at = _least(grams, width - k + 1)
                begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                last = np.append(begin[1:], len(at)) - 1
                seed = at[begin]
                rows.append(np.full(len(seed), row))
                parts.append((grams[seed], rolling.spans(begin, last + width), seed, seed - begin, seed - last))
            take = pa.array(np.concatenate(rows) if rows else [], pa.int64())
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * 5
            out = {"id": batch["id"].take(take), "rid": batch["rid"].take(take), "chunk": batch["chunk"].take(take), "anchor": signed(cols[0]), "frame": signed(cols[1])}
            yield pa.record_batch(out | {name: pa.array(col.astype(np.int32)) for name, col in zip(("at", "most", "least"), cols[2:], strict=True)})

    return run


def repeated_spans(chunks: Chunks, width: int = 50) -> DataFrame:
    """(chunk, rid, start, end): word spans of windows that also start in a document with a smaller id (they may overlap)."""
    spark, kind = chunks.spark, chunks.id_type
    keys = ["anchor", "frame", "most", "least"]
    seeds_at = scratch(spark, "seeds")
    found = chunks.table.where("id is not null").mapInArrow(_anchors(width), f"id {kind}, rid long, chunk int, anchor long, frame long, at int, most int, least int")
    seeds = written(found, seeds_at)
    # Aggregates are written before they are joined, so that the join's sides are plain shuffles, which Spark can split where a key is hot.
    shared = seeds.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    shared = written(shared, scratch(spark, "shared"))
    held_at, classes_at = scratch(spark, "held"), scratch(spark, "classes")
    held = written(seeds.join(shared, "anchor"), held_at)
    dropped(spark, seeds_at)
    first = F.min(F.struct("id", "rid", "at", "chunk")).alias("first")
    classes = written(held.groupBy(*keys).agg(first).select(*keys, "first.*"), classes_at)
    many_at, ask_at = scratch(spark, "many"), scratch(spark, "ask")
    many = written(classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), many_at)
    ask = written(classes.join(many, "anchor"), ask_at)
    load = chunks.side(ask.drop("id"))

    def extend(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = load(chunk)
        if wanted is None:
            return
        wanted = wanted.sort_by("rid")
        rid, at, most, least = (wanted[x].to_numpy() for x in ("rid", "at", "most", "least"))
        for batch in batches:
            parts = []
            mine = batch["rid"].to_numpy()
            lo, hi = np.searchsorted(rid, mine), np.searchsorted(rid, mine, side="right")
            for row in np.flatnonzero(hi > lo):
                rolling = Rolling(text_bytes(batch["text"].slice(row, 1))[0].split())
                which = np.arange(lo[row], hi[row])
                sizes = most[which] - least[which] + 1
                each = np.repeat(which, sizes)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + least[each]
                start = at[each] - offset
                parts.append((each, offset, rolling.spans(start, start + width)))
            if parts:
                each, offset, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
                picked = wanted.take(pa.array(each)).select(keys).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(offset.astype(np.int32)), signed(hashes)], [*keys, "offset", "hash"])

    windows_at = scratch(spark, "windows")
    windows = written(chunks.map(extend, "anchor long, frame long, most int, least int, offset int, hash long"), windows_at)
    windows = windows.join(ask.select(*keys, "id"), keys)
    best = written(windows.groupBy("anchor", "offset", "hash").agg(F.min("id").alias("best")), scratch(spark, "best"))
    # For every class of a contested anchor, at most width - k + 1 offsets with the smallest id that holds the window.
    by_class = windows.join(best, ["anchor", "offset", "hash"]).groupBy(*keys).agg(F.collect_list(F.struct("offset", "best")).alias("offsets"))
    # One join of the many holders with one row a class: a second join on the same keys would keep Spark from splitting hot ones.
    known = written(classes.select(*keys, F.col("id").alias("lo")).join(by_class, keys, "left"), scratch(spark, "known"))
    settled = held.join(known, keys)
    alone = settled.where("offsets is null and lo < id").select("chunk", "rid", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + width).alias("end"))
    open_ = settled.where("offsets is not null").select("chunk", "rid", "id", "at", F.explode("offsets").alias("o")).where("o.best < id")
    several = open_.select("chunk", "rid", (F.col("at") - F.col("o.offset")).alias("start"), (F.col("at") - F.col("o.offset") + width).alias("end"))
    return alone.union(several)


def dedup_substrings(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` (long), ``kept_text`` (kept words, joined by a space) and ``spans``.

    ``spans`` are the maximal removed repeats: array of (start, end) in words.
    Windows are judged on the input, so no removal hides another.

    A null or empty text has no words. A row with a null id neither removes
    nor is removed. Rows that repeat an id are not smaller than each other, so
    neither removes the other. Texts shorter than a window stay. Very long
    texts are read whole. An empty table gives an empty result. Other columns
    are not read.
    """
    chunks = Chunks(docs, id_col, text_col)
    kind = chunks.id_type
    load = chunks.side(repeated_spans(chunks, width))

    def cut(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = load(chunk)
        spans = (spans or pa.table({"rid": pa.array([], pa.int64()), "start": pa.array([], pa.int32()), "end": pa.array([], pa.int32())})).sort_by([("rid", "ascending"), ("start", "ascending")])
        rid, start, end = (spans[x].to_numpy() for x in ("rid", "start", "end"))
        for batch in batches:
            mine = batch["rid"].to_numpy()
            lo, hi = np.searchsorted(rid, mine), np.searchsorted(rid, mine, side="right")
            n_words, n_removed, kept, merged = [], [], [], []
            for text, a, b in zip(text_bytes(batch["text"]), lo, hi, strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, end[a:b], -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if b > a else b" ".join(words))
                merged.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
            yield pa.record_batch({"id": batch["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    out = chunks.map(cut, f"id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)

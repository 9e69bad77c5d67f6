"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenized where they are read; only the few numbers that
describe a piece go on. A document longer than a sequence is cut so that only
its first piece is shorter, and full pieces are sequences of their own. The
first pieces are dealt at random to packers of a bounded number of pieces.

A packer is an online best-fit with bounded space: a fixed number of open
bins, in a bitset keyed by free space (a bit is set if some open bin has just
that much space left). A piece goes to the fullest bin that takes it, which is
the lowest set bit at or above its length. Where no bin takes it and all are
open, the fullest closes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, written
from lodestone.llm.encoding import CACHE_PARTS, encoder

OPEN_BINS = 1024
PIECES_PER_PACKER = 100_000
#: Documents whose ids go on together.
IDS_BATCH = 500
#: Parts of texts whose ids a worker keeps from task to task while pieces are described (about 200 MB).
KEPT_PARTS = 1_200_000


class BestFit:
    """Bins of ``size``; ``place`` gives each piece a bin number and an offset."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.open_bins = size, open_bins
        self.bins = 0  # numbers given so far
        self.open = 0
        self.mask = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset of a piece of 1 to ``size`` tokens."""
        fits = self.mask >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            number = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            number, free = self.bins, self.size
            self.bins += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.mask |= 1 << left
            self.by_free[left].append(number)
            self.open += 1
        return number, self.size - free


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of every whole text with its end id."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        enc.most_parts = CACHE_PARTS if with_ids else KEPT_PARTS
        for whole in batches:
            # With ids a batch is heavy, so fewer rows go on at a time.
            step = IDS_BATCH if with_ids else max(1, len(whole))
            for batch in [whole.slice(at, step) for at in range(0, len(whole), step)]:
                which, cols, held = [], [[], [], [], []], []
                for row, text in enumerate(batch["text"].to_pylist()):
                    ids = np.append(enc.encode([text])[0].astype("<u4"), np.array([end_id], dtype="<u4"))
                    first = len(ids) % size or size
                    for piece, start in enumerate([0, *range(first, len(ids), size)]):
                        length = first if piece == 0 else size
                        part = ids[start : start + length]
                        which.append(row)
                        for col, value in zip(cols, (piece, start, length, zlib.crc32(part)), strict=True):
                            col.append(value)
                        if with_ids:
                            held.append(part)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                out = {"id": batch["id"].take(pa.array(which, pa.int64())), **{n: pa.array(c, k) for n, c, k in zip(("piece", "start", "length", "ids_crc32"), cols, kinds, strict=True)}}
                if with_ids:
                    ends = np.cumsum([0, *cols[2]]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held or [np.zeros(0, "<u4")]).astype(np.int32)))
                yield pa.record_batch(out)
        # Tasks that send ids hold much besides the cache; the others leave it to the worker's next task.
        if with_ids:
            enc.forget()

    return picked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    size: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    open_bins: int = OPEN_BINS,
    pieces_per_packer: int = PIECES_PER_PACKER,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``; ``with_ids`` adds ``ids`` (array<int>).

    A null or empty text is its end id alone, one piece of one token. Repeated
    rows are packed each on its own. A null id is kept. Very long texts give as
    many pieces as they need. An empty table gives no pieces. Other columns
    are not read.
    """
    spark = docs.sparkSession
    # The pieces are written: numbers given to sequences must not change if a task is run again.
    cut = written(pieces(docs, tokenizer, end_id, size, id_col, text_col, with_ids), scratch(spark, "pieces"))
    kind = cut.schema["id"].dataType.simpleString()
    packers = max(1, math.ceil(cut.where(F.col("length") < size).count() / pieces_per_packer))
    # A row's place in its file tells equal rows apart, so that they spread over all packers too.
    place = F.xxhash64("id", "start", "length", "ids_crc32", "_metadata.file_name", "_metadata.row_index")
    names = cut.columns
    short = cut.where(F.col("length") < size).withColumn("place", place).repartition(packers, "place")
    # Equal input order whenever a task is run again; the hash keeps long and short pieces mixed.
    short = short.sortWithinPartitions(F.xxhash64("place", F.lit(1)), "place").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, fit = TaskContext.get().partitionId(), BestFit(size, open_bins)
        for batch in batches:
            placed = [fit.place(x) for x in batch["length"].to_pylist()]
            bins = pa.array([packer + packers * x for x, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, bins, pa.array([x for _, x in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    packed = short.mapInArrow(run, columns + ", sequence_id long, offset long")
    # Full pieces are sequences of their own, numbered below zero.
    full = cut.where(F.col("length") >= size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).withColumnRenamed("id", id_col)

"""Hard-negative mining by distributed radix selection.

Vectors are turned into integers and stand in one table, dealt evenly over its
files. Each anchor has windows: score ranges in which its k best rows of the
same label (its positives) or of another label (negatives of one positive) are
wanted. The k-th best score of a window is found digit by digit. In a pass
every task meets its rows with all anchors, block by block, and counts the
scores that fall into each window by their leading digit, highest first, until
its own counts hold k rows: no lower digit can hold the k-th of all. The
counts are summed over tasks, the digit in which the k-th row lies becomes the
window's new range, and the next pass counts the next digit in it. A window
ends when its range is one score, when it has to take its range whole, or when
it holds fewer than k rows. A last pass gathers the rows at or above the k-th
score alone; of rows that tie there each task gives the k smallest ids.

No pass sends a score to the shuffle unless it is one of the k sought for. The
anchors' table, with its windows, is read by every task from the shared
folder, a bounded piece at a time; nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, filesystem, scratch, written
from lodestone.llm.exact_topk import _matrix, quantised, usable

#: Rows of a file of the table, anchors of a file and of a piece of it, and bits of a digit.
FILE_ROWS, ANCHOR_ROWS, PIECE, DIGIT = 8192, 16384, 256, 10
#: Scores beyond this are refused, so that bounds times percentages fit 64 bits.
LARGEST = 2**56


@dataclass
class Anchors:
    """A piece of the anchors' table. Windows are padded to equal numbers by empty ones (lo > hi)."""

    ids: np.ndarray
    marks: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    win: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    above: np.ndarray


def _pieces(path: str) -> Iterator[Anchors]:
    import pyarrow.dataset as ds

    fs, at = filesystem(path)
    for batch in ds.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=PIECE):
        n, wins = batch.num_rows, batch["wins"]
        if not n:
            continue
        counts = wins.value_lengths().to_numpy()
        row, col = np.repeat(np.arange(n), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = wins.flatten()
        padded = {}
        for name, pad in (("win", 0), ("lo", 1), ("hi", 0), ("above", 0)):
            padded[name] = np.full((n, max(1, counts.max(initial=0))), pad, dtype=np.int64)
            padded[name][row, col] = flat.field(name).to_numpy(zero_copy_only=False)
        ids, marks, labels = (batch[x].to_numpy(zero_copy_only=False) for x in ("id", "mark", "label"))
        yield Anchors(ids, marks, labels, _matrix(pa.chunked_array([batch["vector"]])), **padded)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``x`` and ``y``; the narrower rows count as ended by zeros."""
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    longest = [np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) for a in (x, y)]
    if longest[0] * longest[1] < 2**52:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x @ y.T


def _hits(rows: pa.RecordBatch, path: str, same: bool) -> Iterator[tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of anchors: (piece, row, anchor, score) where the labels agree or differ as asked and the score lies in some window."""
    x = _matrix(pa.chunked_array([rows["vector"]]))
    ids, labels = (rows[c].to_numpy(zero_copy_only=False) for c in ("id", "label"))
    for a in _pieces(path):
        score = products(a.vectors, x)
        low, high = np.where(a.lo <= a.hi, a.lo, LARGEST).min(axis=1), np.where(a.lo <= a.hi, a.hi, -LARGEST).max(axis=1)
        fits = (score >= low[:, None]) & (score <= high[:, None])
        fits &= (labels[None, :] == a.labels[:, None]) == same
        fits &= ids[None, :] != a.ids[:, None]
        at, row = np.nonzero(fits)
        yield a, row, at, score[at, row]


def _bits(width: np.ndarray) -> np.ndarray:
    """Bits of ``width - 1``, exactly."""
    left, out = np.maximum(width - 1, 0), np.zeros(width.shape, dtype=np.int64)
    while (left > 0).any():
        out += left > 0
        left = left >> 1
    return out


def _counted(rows: pa.RecordBatch, path: str, same: bool, k: int, digit: int) -> Iterator[pa.RecordBatch]:
    """(id, mark, win, bucket, n): by window and digit the number of rows, from the best digit on until k rows are held."""
    for a, _, at, score in _hits(rows, path, same):
        wins = a.lo.shape[1]
        shift = np.maximum(_bits(a.hi - a.lo + 1) - digit, 0)
        keys = []
        for w in range(wins):
            m = (score >= a.lo[at, w]) & (score <= a.hi[at, w])
            c = at[m]
            keys.append(((c * wins + w) << digit) | ((a.hi[c, w] - score[m]) >> shift[c, w]))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        window, bucket = key >> digit, key & ((1 << digit) - 1)
        before = np.cumsum(n) - n
        first = np.searchsorted(window, window)
        keep = before - before[first] < k if len(key) else np.zeros(0, bool)
        c, w = window[keep] // wins, window[keep] % wins
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a.ids[c], a.marks[c], a.win[c, w], bucket[keep], n[keep])], ["id", "mark", "win", "bucket", "n"])


def _gathered(rows: pa.RecordBatch, path: str, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """(id, mark, win, other, score): of each window the rows in its range, the k best of this task at most."""
    ids = rows["id"].to_numpy(zero_copy_only=False)
    for a, row, at, score in _hits(rows, path, same):
        parts = []
        for w in range(a.lo.shape[1]):
            m = np.flatnonzero((score >= a.lo[at, w]) & (score <= a.hi[at, w]))
            m = m[np.lexsort((ids[row[m]], -score[m], at[m]))]
            m = m[np.arange(len(m)) - np.searchsorted(at[m], at[m]) < k]
            parts.append(np.stack((a.ids[at[m]], a.marks[at[m]], a.win[at[m], w], ids[row[m]], score[m])))
        out = np.concatenate(parts, axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["id", "mark", "win", "other", "score"])


_WINDOW = ("id", "mark", "win")


def _staged(anchors: DataFrame, windows: DataFrame) -> tuple[str, int]:
    """The anchors that have open windows, each with its windows, in few files of the shared folder."""
    spark = anchors.sparkSession
    held = windows.groupBy("id", "mark").agg(F.collect_list(F.struct("win", "lo", "hi", "above")).alias("wins"))
    at = scratch(spark, "anchor-windows")
    n = held.count()
    written(anchors.join(held, ["id", "mark"]).repartition(max(1, -(-n // ANCHOR_ROWS))), at)
    return at, n


def select(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, digit: int = DIGIT) -> DataFrame:
    """(id, mark, win, rank, other, score): the first k rows of each window by (score descending, id).

    ``rows``: id, label, vector; ``anchors``: id, mark (tells apart anchors of one
    id), label, vector; ``windows``: id, mark, win, lo, hi (scores, both ends
    included). Both tables are read several times, so they should be files.
    ``same``: rows of the anchor's label, or of the others. Windows without a row
    give none.
    """
    spark = rows.sparkSession
    windows = windows.select(*_WINDOW, "lo", "hi", F.lit(0).cast("long").alias("above"), F.col("hi").alias("top"), F.lit(False).alias("done"))
    state_at = scratch(spark, "radix-windows")
    state = written(windows, state_at)
    while not (todo := state.where(~F.col("done"))).isEmpty():
        at, _ = _staged(anchors, todo)
        counts = rows.mapInArrow(lambda batches, at=at: (x for b in batches if b.num_rows for x in _counted(b, at, same, k, digit)), "id long, mark long, win long, bucket long, n long")
        summed = counts.groupBy(*_WINDOW, "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*_WINDOW).orderBy("bucket"))
        found = summed.withColumn("upto", upto).join(todo.select(*_WINDOW, "above"), list(_WINDOW))
        enough = F.col("above") + F.col("upto") >= k
        # The digit that holds the k-th row; null: the window holds fewer than k rows.
        kth = found.groupBy(*_WINDOW).agg(F.min(F.when(enough, F.struct("bucket", "upto", "n"))).alias("kth"))
        shift = F.greatest(F.length(F.bin(F.col("hi") - F.col("lo"))) - digit, F.lit(0)).cast("int")
        step = F.expr("shiftleft(1L, shift)")
        hi = F.col("hi") - F.col("kth.bucket") * F.col("step")
        lo = F.greatest(F.col("lo"), hi - F.col("step") + 1)
        above = F.col("above") + F.col("kth.upto") - F.col("kth.n")
        ended = F.col("done") | F.col("kth").isNull() | (lo == hi) | (above + F.col("kth.n") == k)
        moved = F.col("kth").isNotNull() & ~F.col("done")
        joined = state.join(kth, list(_WINDOW), "left").withColumn("shift", shift).withColumn("step", step)
        after = joined.select(*_WINDOW, *(F.when(moved, x).otherwise(F.col(c)).alias(c) for c, x in (("lo", lo), ("hi", hi), ("above", above))), "top", ended.alias("done"))
        next_at = scratch(spark, "radix-windows")
        state = written(after, next_at)
        dropped(spark, at, state_at)
        state_at = next_at
    final = state.select(*_WINDOW, "lo", F.col("top").alias("hi"), F.lit(0).cast("long").alias("above"))
    at, _ = _staged(anchors, final)
    got = rows.mapInArrow(lambda batches: (x for b in batches if b.num_rows for x in _gathered(b, at, same, k)), "id long, mark long, win long, other long, score long")
    order = Window.partitionBy(*_WINDOW).orderBy(F.desc("score"), "other")
    best_at = scratch(spark, "radix-found")
    best = written(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*_WINDOW, "rank", "other", "score"), best_at)
    dropped(spark, at, state_at)
    return best


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    whole: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    file_rows: int = FILE_ROWS,
    digit: int = DIGIT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``is_anchor`` (over ``vectors``' columns) holds.
    Components become floor(scale * x); scores are integer inner products. An
    anchor's positives are the first ``positives`` rows of its label by (score
    descending, id); for each, its negatives are the first ``negatives`` rows of
    other labels with low * positive <= whole * negative <= high * positive.

    Rows with a null id, a null ``label``, a null vector or a null, NaN or
    infinite component take no part. Shorter vectors count as ended by zeros; an
    empty one scores 0 with all. Equal rows (id, label, vector) count once; rows
    that share an id but differ count each, and none is a partner of an anchor of
    its id. Fewer partners than asked for are all returned; a positive without
    negatives gives no row, as does an empty table. Other columns are not read,
    but by ``is_anchor`` and ``label``. Scores beyond 2^56 are refused.
    """
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    good = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    once = good.withColumn("vector", quantised(F.col("vector"), scale)).distinct()
    all_at, rows_at, anchors_at = (scratch(spark, f"mining-{x}") for x in ("once", "rows", "anchors"))
    held = written(once, all_at)
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, asked, longest = held.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    bound = int(longest * (1 + 1e-9)) + 1
    if bound > LARGEST:
        raise ValueError(f"scores up to {bound} are beyond 2^56: scale the vectors down")
    rows = written(held.select("id", "label", "vector").repartition(max(1, -(-n // file_rows))), rows_at)
    mark = F.xxhash64("label", "vector")
    anchors = written(held.where("asks").select("id", mark.alias("mark"), "label", "vector").repartition(max(1, -(-asked // ANCHOR_ROWS))), anchors_at)
    dropped(spark, all_at)

    whole_range = anchors.select("id", "mark", F.lit(0).cast("long").alias("win"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    found = select(rows, anchors, whole_range, positives, True, digit)
    # In whole numbers: lo is low * p / whole rounded up, hi is high * p / whole rounded down.
    lo, hi = (f"CAST(-((-score * {low}L - pmod(-score * {low}L, {whole}L)) DIV {whole}L) AS LONG)", f"CAST((score * {high}L - pmod(score * {high}L, {whole}L)) DIV {whole}L AS LONG)")
    ranges = found.select("id", "mark", F.col("rank").cast("long").alias("win"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi")).where("lo <= hi")
    hard = select(rows, anchors, ranges, negatives, False, digit)
    dropped(spark, rows_at, anchors_at)
    named = found.select("id", "mark", F.col("rank").cast("long").alias("win"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, list(_WINDOW)).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

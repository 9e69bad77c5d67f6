"""Exact top-k by inner product, with an impact-ordered index read a score level at a time.

Vectors are turned into integers. The index is cut into blocks of a bounded
number of vectors, a file each. In a block, every non-zero component is a
posting (dimension, row, impact), and the postings stand in segments by
descending quantised impact: the number of bits of the impact's size, and in a
segment by dimension. For each row and level the block keeps the norm of what
the lower levels hold.

Queries stand in bounded groups, a file each. A first pass meets every group
with one block: the k-th best exact score there is a bar that every result of
the query reaches. The second pass meets the groups with all other blocks: a
task reads one block and some groups from their files; neither is shuffled.

A meeting processes the segments from the highest level down: they add to the
scores so far, and what is left of any score is at most the query's norm times
the row's rest norm. Where the bar shows that only few rows can still be
members, processing stops, on that proof alone; if it never does, all segments
are read. The possible members are then rescored exactly, in integers, and
those that reach the bar go on to the k best of each query.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, loaded, made, saved, scratch, written

BLOCK_ROWS, GROUP_ROWS, SLICE = 8192, 4096, 256
#: Groups that one task meets with its block.
GROUPS_A_TASK = 8
#: Stop once the possible members are at most this share of a block's rows (or k times 8).
FEW = 0.03
#: A segment with at most this share of all components is processed posting by posting; a denser one as a matrix.
SPARSE = 0.1
#: Rows on which a stop is tried before it is worked out for all.
TRIED = 64


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    if width:
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.promote_types(np.min_scalar_type(int(x.min(initial=0))), np.min_scalar_type(int(x.max(initial=0)))))


def _index(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A block's file: ids, and for each level the postings by dimension and the rows' rest norms below it."""
    size = np.abs(x)
    level = np.where(size > 0, np.frexp(size.astype(float))[1], 0)
    levels = sorted(set(level[level > 0].tolist()), reverse=True)
    arrays = {"ids": ids, "shape": np.array(x.shape), "levels": np.array(levels, dtype=np.int32)}
    for n, at in enumerate(levels):
        dims, rows = np.nonzero((level == at).T)
        arrays[f"begin{n}"] = np.searchsorted(dims, np.arange(x.shape[1] + 1)).astype(np.int64)
        arrays[f"rows{n}"], arrays[f"impacts{n}"] = _small(rows), _small(x[rows, dims])
        arrays[f"rest{n}"] = np.sqrt((np.where(level < at, x, 0).astype(float) ** 2).sum(axis=1))
    return _packed(**arrays)


@dataclass
class Segment:
    begin: np.ndarray
    rows: np.ndarray
    impacts: np.ndarray
    rest: np.ndarray

    def matrix(self, n: int, width: int, kind: type) -> np.ndarray:
        out = np.zeros((n, width), dtype=kind)
        out[self.rows, np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))] = self.impacts
        return out

    def add(self, score: np.ndarray, q: np.ndarray) -> None:
        """Add this segment's postings to ``score`` (rows, queries) for the queries ``q`` (queries, dimensions)."""
        width = len(self.begin) - 1
        if len(self.rows) > SPARSE * len(score) * max(1, width):
            score += self.matrix(len(score), width, float) @ q[:, :width].T
            return
        for d in np.flatnonzero(np.diff(self.begin)):
            part = slice(self.begin[d], self.begin[d + 1])
            score[self.rows[part]] += self.impacts[part, None] * q[None, :, d]


@dataclass
class Block:
    ids: np.ndarray
    width: int
    segments: list[Segment]

    @classmethod
    def load(cls, path: str) -> Block:
        held = np.load(io.BytesIO(loaded(path)))
        names = ("begin", "rows", "impacts", "rest")
        parts = [[held[f"{x}{n}"] for x in names] for n in range(len(held["levels"]))]
        segments = [Segment(a, b.astype(np.int64), c.astype(np.int64), d) for a, b, c, d in parts]
        return cls(held["ids"], int(held["shape"][1]), segments)

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.ids), self.width), dtype=np.int64)
        for s in self.segments:
            out += s.matrix(len(self.ids), self.width, np.int64)
        return out

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bars: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(query positions, ids, scores, postings processed) by slices of queries: for each query the block's k best ids that reach its bar.

        Each id counts by its best row; ties go to the smaller id; a row of the query's own id is no candidate.
        """
        n, width = len(self.ids), max(self.width, queries.shape[1])
        x = np.zeros((n, width), dtype=np.int64)
        x[:, : self.width] = self.vectors()
        order = np.argsort(self.ids, kind="stable")
        sorted_ids = self.ids[order]
        firsts = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), sorted_ids[1:] != sorted_ids[:-1])))
        tried = np.linspace(0, n - 1, min(n, TRIED)).astype(int) if n else np.zeros(0, int)
        for begin in range(0, len(queries), SLICE):
            q = np.zeros((len(queries[begin : begin + SLICE]), width), dtype=np.int64)
            q[:, : queries.shape[1]] = queries[begin : begin + SLICE]
            mine, bar = query_ids[begin : begin + SLICE], bars[begin : begin + SLICE].astype(float)
            norm = np.sqrt((q.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9
            lo, hi = np.searchsorted(sorted_ids, mine), np.searchsorted(sorted_ids, mine, side="right")
            own_q = np.repeat(np.arange(len(mine)), hi - lo)
            own_x = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])] if len(own_q) else np.zeros(0, np.int64)
            score = np.zeros((n, len(q)))
            score[own_x, own_q] = -np.inf
            member, done, read = None, False, 0
            take = min(k, len(firsts))
            qf = q.astype(float)
            for s in self.segments:
                s.add(score, qf)
                read += len(s.rows)
                # Bounds in doubles: the margin covers their rounding, so that the proof holds.
                edge = bar - 1e-6 * (1 + np.abs(bar))
                few = max(8 * k, FEW * n)
                if np.isfinite(bar).all() and (score[tried] + s.rest[tried, None] * norm >= edge).sum() > 2 * len(q) * max(1, few * len(tried) / n):
                    continue
                low = score - s.rest[:, None] * norm
                if not np.isfinite(bar).all():
                    best = np.maximum.reduceat(low[order], firsts, axis=0) if len(firsts) < n else low
                    local = np.partition(best, len(firsts) - take, axis=0)[len(firsts) - take] if take == k else np.full(len(q), -np.inf)
                    edge = np.maximum(edge, np.where(np.isfinite(local), local - 1e-6 * (1 + np.abs(local)), -np.inf))
                member = (score + s.rest[:, None] * norm >= edge) & np.isfinite(score)
                if member.sum() <= len(q) * few:
                    done = True
                    break
            if not done:
                member = np.isfinite(score) & (score >= bar - 1e-6 * (1 + np.abs(bar))) if np.isfinite(bar).all() else np.isfinite(score)
            col, row = np.nonzero(member.T)
            exact = np.einsum("ij,ij->i", q[col], x[row]) if len(row) else np.zeros(0, np.int64)
            reach = exact >= bar[col]
            col, row, exact = col[reach], row[reach], exact[reach]
            best = np.lexsort((self.ids[row], -exact, col))
            col, row, exact = col[best], row[best], exact[best]
            if len(firsts) < n:
                _, once = np.unique(np.stack((col, self.ids[row]), axis=1), axis=0, return_index=True)
                once.sort()
                col, row, exact = col[once], row[once], exact[once]
            keep = np.arange(len(col)) - np.searchsorted(col, col) < k
            yield begin + col[keep], self.ids[row[keep]], exact[keep], read


_FOUND = "query_id long, id long, score long, block long, postings_read long, postings_held long"


def _meet(block: Block, number: int, q: np.ndarray, ids: np.ndarray, bars: np.ndarray, k: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Rows of ``_FOUND`` (one without a query tells the postings processed), and the query positions and scores."""
    parts = list(block.search(q, ids, bars, k))
    at, got, scores = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    read = sum(p[3] for p in parts)
    held = sum(len(s.rows) for s in block.segments) * len(parts)
    none = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), pa.array([None], pa.int64())])
    last = lambda x: pa.array([None] * len(at) + [x], pa.int64())
    cols = [none(ids[at]), none(got), none(scores), pa.array(np.full(len(at) + 1, number)), last(read), last(held)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _FOUND.split(", ")]), at, scores


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
    report: dict[str, int] | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): for each query the k highest integer inner products, ties to the smaller id.

    Queries are the rows where ``is_query`` (over ``vectors``' columns) holds;
    candidates are all rows but those of the query's id. Vectors that are null
    or hold a null, NaN or infinite component take no part, nor do null ids.
    Shorter vectors count as ended by zeros; an empty one scores 0 with all.
    Rows that repeat an id count once, by their highest score. Fewer than k
    candidates are all returned. Scores must fit 64 bits and the components 53.
    An empty table gives an empty result. Other columns are not read, except
    by ``is_query``. A ``report`` dictionary takes the postings that were read
    before the stops, and those that a full scan would have read.
    """
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    whole_at, index_at = scratch(spark, "vectors"), scratch(spark, "impact-index")
    usable_rows = picked.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", quantised(F.col("vector"), scale)).distinct()
    whole = written(usable_rows, whole_at)
    n, asked = (int(x or 0) for x in whole.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first())
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / group_rows))
    made(index_at)

    def file(what: str, number: int) -> str:
        return f"{index_at}/{what}-{number:08d}.npz"

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        saved(file("block", key[0].as_py()), _index(rows["id"].to_numpy().astype(np.int64), _matrix(rows["vector"])))
        return pa.table({"number": [key[0].as_py()]})

    def group(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        saved(file("group", key[0].as_py()), _packed(ids=rows["id"].to_numpy().astype(np.int64), q=_matrix(rows["vector"])))
        return pa.table({"number": [key[0].as_py()]})

    def queries(number: int) -> tuple[np.ndarray, np.ndarray]:
        held = np.load(io.BytesIO(loaded(file("group", number))))
        return held["q"], held["ids"]

    dealt = whole.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "grp": F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups))})
    indexed = {r[0] for r in dealt.select("block", "id", "vector").groupBy("block").applyInArrow(block, "number long").collect()}
    asking = sorted(r[0] for r in dealt.where("asks").select("grp", "id", "vector").groupBy("grp").applyInArrow(group, "number long").collect())
    dropped(spark, whole_at)
    first = min(indexed, default=0)

    def open_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first block with every group: the k-th best score of each query there, for all later meetings."""
        held = None
        for batch in batches:
            for number in batch["number"].to_pylist():
                held = held or Block.load(file("block", first))
                q, ids = queries(number)
                rows, at, scores = _meet(held, first, q, ids, np.full(len(ids), -np.inf), k)
                bars = np.full(len(ids), -np.inf)
                full = np.flatnonzero(np.bincount(at, minlength=len(ids)) >= k)
                lowest = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(lowest, at, scores)
                bars[full] = lowest[full]
                saved(file("bars", number), _packed(bars=bars))
                yield rows

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, None
        for batch in batches:
            for pair in sorted(batch["id"].to_pylist()):
                number, at = others[pair // spans], GROUPS_A_TASK * (pair % spans)
                if number != last:
                    last, held = number, Block.load(file("block", number))
                for g in asking[at : at + GROUPS_A_TASK]:
                    q, ids = queries(g)
                    yield _meet(held, number, q, ids, np.load(io.BytesIO(loaded(file("bars", g))))["bars"], k)[0]

    def tasks(numbers: DataFrame, n: int) -> DataFrame:
        return numbers.repartition(max(1, min(n, 20_000)))

    found_at = [scratch(spark, "topk") for _ in range(2)]
    # Blocks and groups pair up by their numbers, which Spark counts out; the vectors stay in their files.
    asked = spark.createDataFrame([(g,) for g in asking], "number long")
    found = written(tasks(asked, len(asking)).mapInArrow(open_bars, _FOUND), found_at[0])
    others = [b for b in sorted(indexed) if b != first]
    spans = -(-len(asking) // GROUPS_A_TASK)
    if others and spans:
        # Numbers of blocks and groups without rows have no file; the two lists grow with the table by block, not by pair.
        pairs = tasks(spark.range(len(others) * spans), len(others) * spans)
        found = found.union(written(pairs.mapInArrow(meet, _FOUND), found_at[1]))
    dropped(spark, index_at)
    if report is not None:
        row = found.agg(F.sum("postings_read"), F.sum("postings_held")).first()
        report.update(read=int(row[0] or 0), held=int(row[1] or 0))
    # Rows of a query's id that stand in the table with several vectors ask together.
    best = found.where("query_id is not null").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

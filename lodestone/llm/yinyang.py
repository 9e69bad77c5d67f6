"""Exact k-means by Yinyang grouping.

Centroids are cut into groups once, by their first places. A row keeps an upper
bound of the distance to its own centroid and one lower bound a group, of the
distances to the group's other centroids. When centroids move, the upper bound
grows by the move of the row's centroid, and each lower bound shrinks by the
largest move in its group. A row whose upper bound lies below all its lower
bounds stays without a look at its vector (the global filter). For the others
the distance to their own centroid is worked out; then only the groups whose
lower bound it does not undercut are scanned, exactly, in integers.

Rows never move between tasks: a round is one pass that reads and writes the
table with its bounds, and a sum over the rows that changed their centroid.
Sums, counts and centroids are exact integers, so neither the filters nor the
order of tasks change a result; bounds are doubles, rounded to the safe side.
The driver holds only what the number of centroids bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, scratch, written
from lodestone.llm.exact_topk import _matrix, quantised, usable

#: Components beyond this are refused: squared distances must fit 64 bits.
LARGEST = 2**26
#: Bounds are moved outwards by this share, more than their rounding.
SAFE = 1e-12

_STATE = "id long, vector array<long>, was int, cluster int, upper double, lower array<double>, distance long, scanned int"


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the integer rows of ``x`` to those of ``c``."""
    size = max((int(np.abs(a).max(initial=0)) for a in (x, c)), default=0)
    if 4 * x.shape[1] * size * size < 2**52:
        xf, cf = x.astype(float), c.astype(float)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def grouped(centroids: np.ndarray, size: int) -> np.ndarray:
    """A group number for each centroid: some ten rounds of plain k-means over the centroids themselves, about ``size`` to a group."""
    n = max(1, -(-len(centroids) // size))
    places = centroids[np.linspace(0, len(centroids) - 1, n).astype(int)].astype(float)
    of = np.zeros(len(centroids), dtype=np.int64)
    for _ in range(10):
        of = ((centroids[:, None, :] - places[None]) ** 2).sum(axis=2).argmin(axis=1)
        places = np.stack([centroids[of == g].mean(axis=0) if (of == g).any() else places[g] for g in range(n)])
    return np.unique(of, return_inverse=True)[1]


@dataclass
class Round:
    """What a task needs of a round: centroids, their groups and how far each has moved since the last one."""

    centroids: np.ndarray
    groups: np.ndarray
    moves: np.ndarray

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """(own, upper, lower, squared distance or -1 where not known, distances worked out) of rows; own is -1 before the first round."""
        n, members = len(x), [np.flatnonzero(self.groups == g) for g in range(self.groups.max() + 1)]
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        known, scanned = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int32)
        new = own < 0
        upper = np.where(new, np.inf, (upper + self.moves[own]) * (1 + SAFE))
        most = np.array([self.moves[m].max() for m in members])
        lower = np.where(new[:, None], -1.0, (lower - most) * (1 - SAFE) - SAFE)
        todo = np.flatnonzero(upper >= lower.min(axis=1))
        seen = todo[~new[todo]]
        for c in np.unique(own[seen]):
            at = seen[own[seen] == c]
            known[at] = squared_distances(x[at], self.centroids[c : c + 1])[:, 0]
            scanned[at] += 1
        upper[seen] = np.sqrt(known[seen]) * (1 + SAFE)
        before, first = own.copy(), known.copy()
        nearest = {}
        for g, m in enumerate(members):
            at = todo[upper[todo] >= lower[todo, g]]
            if not len(at):
                continue
            d = squared_distances(x[at], self.centroids[m])
            scanned[at] += len(m)
            low = d.argmin(axis=1)  # the first of equals: the smaller number, as members ascend
            best, who = d[np.arange(len(at)), low], m[low]
            d[np.arange(len(at)), low] = np.iinfo(np.int64).max
            nearest[g] = at, best, who, d.min(axis=1)
            # A group's bound holds for the round's start, so rows scanned later are judged by it as well: none is lost.
            better = (known[at] < 0) | (best < known[at]) | ((best == known[at]) & (who < own[at]))
            known[at[better]], own[at[better]] = best[better], who[better]
        for g, (at, best, who, second) in nearest.items():
            rest = np.where(who == own[at], second, best)
            lower[at, g] = np.where(rest == np.iinfo(np.int64).max, np.inf, np.sqrt(rest.astype(float))) * (1 - SAFE)
        left = seen[own[seen] != before[seen]]
        home = self.groups[before[left]]
        lower[left, home] = np.minimum(lower[left, home], np.sqrt(first[left]) * (1 - SAFE))
        upper[todo] = np.sqrt(known[todo]) * (1 + SAFE)
        return own, upper, lower, known, scanned


def _pass(batches: Iterator[pa.RecordBatch], step: Round, last: bool) -> Iterator[pa.RecordBatch]:
    n_groups = int(step.groups.max()) + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(pa.chunked_array([batch["vector"]]))
        own = batch["cluster"].to_numpy(zero_copy_only=False).astype(np.int64)
        upper = batch["upper"].to_numpy(zero_copy_only=False)
        lower = batch["lower"].flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if (own >= 0).any() else np.zeros((len(x), n_groups))
        now, upper, lower, known, scanned = step.assign(x, own, upper, lower)
        if last:
            for c in np.unique(now[known < 0]):
                at = np.flatnonzero((now == c) & (known < 0))
                known[at] = squared_distances(x[at], step.centroids[c : c + 1])[:, 0]
        bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_groups), pa.array(lower.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["vector"], batch["cluster"], pa.array(now.astype(np.int32)), pa.array(upper), bounds, pa.array(known), pa.array(scanned)], [f.split()[0] for f in _STATE.split(", ")]
        )


def _changes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(cluster, n, sums) of a task: what rows that changed their centroid add to the new one and take from the old one."""
    n, sums = np.zeros(k, dtype=np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(pa.chunked_array([batch["vector"]]))
        sums = np.zeros((k, x.shape[1]), dtype=np.int64) if sums is None else sums
        for name, sign in (("cluster", 1), ("was", -1)):
            at = batch[name].to_numpy(zero_copy_only=False).astype(np.int64)
            there = at >= 0
            np.add.at(sums, at[there], sign * x[there])
            n += sign * np.bincount(at[there], minlength=k)
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def drawn(rows: DataFrame, k: int, order: Column) -> np.ndarray:
    """The vectors of the k first rows by ``order`` (ties by id and vector): where centroids start."""
    first = rows.orderBy(order, F.col("id").asc_nulls_first(), "vector").limit(k)
    return np.array([r["vector"] for r in first.select("vector").collect()], dtype=np.int64)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: int = 2,
    dims: int = 64,
    scale: int = 256,
    group_size: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict[str, int] | None = None,
) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector that takes part.

    Vectors of exactly ``dims`` components, none null, NaN or infinite, take
    part; components become floor(scale * x). Centroids start as the ``k`` vectors
    with the smallest sha256 of ``seed:id`` (a null id as empty text; repeated
    ids by their vectors). ``rounds`` times every vector goes to the nearest
    centroid (ties to the smaller number) and each non-empty centroid becomes
    floor(sum / count) of its vectors, exactly; then vectors are assigned once
    more. ``distance`` is squared; the inertias are its sums. Repeated rows are
    rows of their own. With fewer than ``k`` vectors each starts a centroid; an
    empty table gives no row. Other columns are not read. Components beyond 2^26
    are refused. A ``report`` dictionary takes the distances worked out and those
    that comparing every vector with every centroid would take.
    """
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    good = picked.where((F.size("vector") == dims) & usable(F.col("vector")))
    blank = {"was": F.lit(-1), "cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.array().cast("array<double>"), "distance": F.lit(-1).cast("long"), "scanned": F.lit(0)}
    at = scratch(spark, "yinyang")
    state = written(good.select("id", quantised(F.col("vector"), scale).alias("vector"), *(x.alias(c) for c, x in blank.items())), at)
    n, largest = state.agg(F.count("*"), F.coalesce(F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))), F.lit(0))).first()
    if largest > LARGEST:
        raise ValueError(f"components up to {largest} are beyond 2^26: scale the vectors down")
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not n:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in zip(names, ("long", "int", "long", "long", "long", "string"), strict=True)))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = drawn(state, k, order)
    k = len(centroids)
    step = Round(centroids, grouped(centroids, group_size), np.zeros(k))
    sums, counts, worked = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object), 0
    for done in range(rounds + 1):
        next_at = scratch(spark, "yinyang")
        state = written(state.mapInArrow(lambda batches, step=step, last=done == rounds: _pass(batches, step, last), _STATE), next_at)
        dropped(spark, at)
        at = next_at
        if report is not None:
            worked += state.agg(F.sum("scanned")).first()[0]
        if done == rounds:
            break
        changed = state.where("cluster <> was").select("vector", "was", "cluster").mapInArrow(lambda batches: _changes(batches, k), "cluster int, n long, sums array<long>")
        for row in changed.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims))).collect():
            counts[row[0]] += row[1]
            sums[row[0]] += np.array(row[2:], dtype=object)
        moved = np.array([[int(s) // int(m) for s in own] if m else old.tolist() for own, m, old in zip(sums, counts, step.centroids, strict=True)], dtype=np.int64)
        far = np.sqrt(((moved - step.centroids).astype(float) ** 2).sum(axis=1)) * (1 + SAFE)
        step = Round(moved, step.groups, far)
    if report is not None:
        report.update(worked=int(worked), full=int(n) * k * (rounds + 1))
    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("total")).collect()
    inertia = sum(r["total"] for r in totals)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in step.centroids.tolist()]
    # As many rows as there are centroids.
    known = spark.createDataFrame([(r["cluster"], r["total"], inertia, digest[r["cluster"]]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(known), "cluster").select(*names)

"""Near copies by exact Jaccard similarity of word shingles.

Each text is the set of its shingles' hashes; equal sets count once. MinHash
finds candidates: ``BANDS`` bands of ``ROWS`` minima each, and sets that agree
in a band share a bucket. The pairs of a bucket of up to ``BUCKET`` sets are
candidates, but for those that cannot be similar: each set has a bit array that
holds the parity of its shingles by hash, and two sets differ by at least as
many shingles as their arrays differ in bits. So no similar pair is left out,
and texts that merely share a passage do not chain up to large groups. The sets
of a larger bucket are joined to its smallest, so a bucket of any size gives at
most about ``BUCKET / 2`` rows a member. The components of these candidate
links are groups; in a group every pair whose sizes allow the similarity is
compared exactly until its links are known: a set that is linked already is
compared with no further one.

No task holds more than two cells of ``CELL`` sets. A larger group is cut into
cells; each cell is settled by itself, and one set of each of its components
goes on to meet those of the other cells, as a smaller group. What is then
still apart is compared cell by cell: sets stand in cells by their component,
so two cells of one component need no comparison.

A pair of similarity 0.8 agrees in at least one band with probability 0.997, a
pair of 0.9 practically always.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, signed, text_bytes, written
from lodestone.llm.simhash import components
from lodestone.operators.ordering import numbered

BANDS, ROWS, SEED = 32, 8, 42
#: Sets that one cell of a group holds.
CELL = 500
#: Sets of a bucket whose pairs are looked at one by one, and bits of a set's array of parities.
BUCKET, PARITIES = 32, 1024
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(ends) - width])).tolist()
    last = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)), dtype=np.uint64, count=len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash minima."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    digest = xxhash.xxh64_intdigest
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((digest(rows[b].tobytes(), b) for b in range(BANDS)), dtype=np.uint64, count=BANDS)


def parities(hashes: np.ndarray) -> np.ndarray:
    """``PARITIES`` bits as longs: whether the number of hashes that fall on a bit is odd."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _possible(pairs: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) without those whose sizes or parities, from ``about`` (whole, n, odd), rule the similarity out."""
    both = pairs.join(about.toDF("a", "n_a", "odd_a"), "a").join(about.toDF("b", "n_b", "odd_b"), "b")
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    # |A ^ B| <= (1 - s) / (1 + s) * (|A| + |B|) holds exactly if the similarity is s or more.
    return both.where(sizes & (apart * (1 + similarity) <= (1 - similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6)).select("a", "b")


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the number of the component it is in, under exact Jaccard similarity of at least ``similarity``."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[order], [sets[i] for i in order]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), dtype=bool)
    of = np.full(n, -1)
    # The sets not reached yet, ascending by size, with their shingles end to end; made anew when half of them are reached.
    left, at, held = np.arange(n), starts, flat
    for first in range(n):
        if of[first] >= 0:
            continue
        of[first], queue = first, [first]
        while queue:
            i = queue.pop()
            mine = flat[starts[i] : starts[i + 1]]
            open_ = of[left] < 0
            if 2 * open_.sum() < len(left):
                left = left[open_]
                held = np.concatenate([flat[starts[j] : starts[j + 1]] for j in left]) if len(left) else flat[:0]
                at = np.concatenate(([0], np.cumsum(sizes[left])))
            lo = int(np.searchsorted(sizes[left], math.ceil(similarity * sizes[i] - 1e-9)))
            hi = int(np.searchsorted(sizes[left], math.floor(sizes[i] / similarity + 1e-9), side="right"))
            if lo >= hi:
                continue
            mark[mine] = True
            common = np.add.reduceat(mark[held[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64) if len(mine) else np.zeros(hi - lo, np.int64)
            mark[mine] = False
            near = common >= similarity * (sizes[left[lo:hi]] + sizes[i] - common) - 1e-9
            new = left[lo:hi][near]
            new = new[of[new] < 0]
            of[new] = first
            queue.extend(new.tolist())
    out = np.empty(n, dtype=np.int64)
    out[order] = order[of]
    return out


def _cells(members: DataFrame, group: str, order: list[str], cell: int) -> DataFrame:
    """Members with ``cell``: a number within their group, of about ``cell`` members each, along ``order``."""
    sized = members.join(members.groupBy(group).agg(F.count("*").alias("__n")), group)
    small = sized.where(F.col("__n") <= cell).withColumn("cell", F.lit(0).cast("long"))
    large = sized.where(F.col("__n") > cell)
    keys = [F.col(group), *map(F.col, order)]
    spread = numbered(large, "nth", *keys)
    first = spread.groupBy(group).agg(F.min("nth").alias("first"))
    spread = spread.join(first, group).withColumn("cell", F.floor((F.col("nth") - F.col("first")) / cell)).drop("nth", "first")
    return small.unionByName(spread).drop("__n")


def _settled(docs: DataFrame, members: DataFrame, width: int, similarity: float, cell: int) -> DataFrame:
    """(whole, component) of members (id, whole, root): exact components within each root, by cells of bounded size."""
    spark = docs.sparkSession

    def compare(rows: pa.Table) -> pa.Table:
        whole = rows["whole"].to_numpy()
        of = linked([shingles(x, width) for x in text_bytes(rows["text"])], similarity)
        return pa.table({"whole": pa.array(whole), "component": pa.array(whole[of])})

    dealt = written(_cells(members, "root", ["whole"], cell), scratch(spark, "near-cells"))
    texts = docs.join(dealt, "id").select("root", "cell", "whole", "text")
    found = written(texts.groupBy("root", "cell").applyInArrow(compare, "whole long, component long"), scratch(spark, "near-settled"))
    many = dealt.where("cell > 0").select("root").distinct()
    if many.isEmpty():
        return found
    # One set of each component of the groups of several cells; fewer of them meet again.
    rest = dealt.join(many, "root").join(found, "whole")
    heads = written(rest.where("whole = component").select("id", "whole", "root"), scratch(spark, "near-heads"))
    if heads.count() < rest.count():
        higher = _settled(docs, heads, width, similarity, cell).toDF("component", "higher")
        found = written(found.join(higher, "component", "left").select("whole", F.coalesce("higher", "component").alias("component")), scratch(spark, "near-merged"))
        rest = dealt.join(many, "root").join(found, "whole")
    return _across(docs, found, rest.select("id", "whole", "root", "component"), width, similarity, cell)


def _across(docs: DataFrame, found: DataFrame, rest: DataFrame, width: int, similarity: float, cell: int) -> DataFrame:
    """Links between components of one group whose sets never met: cells of a group meet in pairs, unless both are of one component."""
    spark = docs.sparkSession
    apart = rest.groupBy("root").agg(F.count_distinct("component").alias("k")).where("k > 1").select("root")
    open_ = rest.join(apart, "root")
    if open_.isEmpty():
        return found
    cells = written(_cells(open_, "root", ["component", "whole"], cell), scratch(spark, "near-cells"))
    about = cells.groupBy("root", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    a, b = about.alias("a"), about.alias("b")
    one = (F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo"))
    pairs = a.join(b, "root").where((F.col("a.cell") <= F.col("b.cell")) & ~one)
    pairs = pairs.select("root", F.col("a.cell").alias("x"), F.col("b.cell").alias("y"))
    asked = pairs.select("root", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("cell"))

    def compare(rows: pa.Table) -> pa.Table:
        part = rows["component"].to_numpy()
        of = linked([shingles(x, width) for x in text_bytes(rows["text"])], similarity)
        edges = np.unique(np.stack((part, part[of]), axis=1), axis=0)
        return pa.table({"a": pa.array(edges[:, 0].copy()), "b": pa.array(edges[:, 1].copy())})

    met = asked.join(cells, ["root", "cell"]).join(docs, "id").select("root", "x", "y", "component", "text")
    edges = met.groupBy("root", "x", "y").applyInArrow(compare, "a long, b long").where("a <> b").distinct()
    roots = components(written(edges, scratch(spark, "near-across")))
    return found.join(roots, found.component == roots.node, "left").select("whole", F.coalesce(roots.root, found.component).alias("component"))


def near_copies(
    docs: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell: int = CELL,
    also: DataFrame | None = None,
) -> DataFrame:
    """(id, component): texts whose shingle sets reach each other by links of Jaccard similarity ``similarity`` or more share a component.

    ``also`` (two columns of ids) names further candidates, such as SimHash
    links; like those of MinHash they count only as far as the similarity holds.
    ``component`` is a long. Null and empty texts have the empty set in common
    and share one. Ids must be unique and not null; ``docs`` must be a table
    that reads the same again. Texts of any length count whole. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, width) for x in text_bytes(batch["text"])]
            whole = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), dtype=np.uint64, count=len(sets))
            keys = np.concatenate([bands(x) for x in sets]) if sets else np.zeros(0, np.uint64)
            odd = np.concatenate([parities(x) for x in sets]) if sets else np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), x) for n, x in ((BANDS, signed(keys)), (PARITIES // 64, pa.array(odd)))]
            yield pa.RecordBatch.from_arrays([batch["id"], signed(whole), pa.array(np.array([len(x) for x in sets], np.int64)), *lists], ["id", "whole", "n", "keys", "odd"])

    signatures = written(picked.mapInArrow(sign, f"id {kind}, whole long, n long, keys array<long>, odd array<long>"), scratch(spark, "minhash"))
    least = signatures.groupBy("whole").agg(F.min("id").alias("id"))
    single = signatures.join(least, ["whole", "id"], "left_semi")
    keyed = single.select("whole", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("whole").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = written(keyed.join(buckets, ["band", "key"]), scratch(spark, "minhash-shared"))
    small = shared.where(F.col("size") <= BUCKET).select("band", "key", "whole")
    pairs = small.withColumnRenamed("whole", "a").join(small.withColumnRenamed("whole", "b"), ["band", "key"]).where("a < b").select("a", "b").distinct()
    near = _possible(pairs, single.select("whole", "n", "odd"), similarity)
    links = near.union(shared.where(F.col("size") > BUCKET).where("whole <> first").select(F.col("whole").alias("a"), F.col("first").alias("b")))
    if also is not None:
        of = signatures.select("id", "whole")
        a, b = of.toDF(also.columns[0], "a"), of.toDF(also.columns[1], "b")
        links = links.union(also.toDF(*also.columns).join(a, also.columns[0]).join(b, also.columns[1]).where("a <> b").select("a", "b"))
    groups = components(written(links.distinct(), scratch(spark, "minhash-links")))
    members = written(least.join(groups, least.whole == groups.node).select("id", "whole", "root"), scratch(spark, "near-members"))
    found = _settled(picked, members, width, similarity, cell)
    out = signatures.select("id", "whole").join(found, "whole", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("component", "whole").alias("component"))

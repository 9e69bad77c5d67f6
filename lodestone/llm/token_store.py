"""Token ids in raw binary shards, with a minimal perfect hash index for constant-time keyed access.

Layout of a store (a folder below the shared folder):

* ``shards/``: raw little-endian unsigned ids, without any header, of whole
  documents in ascending key order; shard after shard, one range of keys each.
  16 bits an id if the vocabulary allows, else 32.
* ``manifest/`` (Parquet): which shard files belong to the store, their order
  and the number of ids before each. A retried task writes a file of another
  name, and only the files of the committed attempts are in the manifest.
* ``index/``: a file for each slice of the entries' hash space, named by the
  slice: a minimal perfect hash with arrays of 32-bit fingerprints, shards,
  offsets, lengths and the number of documents of the key.
* ``meta/`` (Parquet): one row of the store's figures.

An entry is a key with a number from 0: documents that share a key follow each
other in the store and are its entries 0, 1 and so on. A lookup hashes the
entry, opens the slice that the hash names, probes its arrays and reads one
range of a shard file: no scan and no Spark job.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, filesystem, loaded, longs, made, saved, scratch, signed, written
from lodestone.llm.encoding import encoder
from lodestone.llm.perfect_hash import PerfectTable

KEYS_PER_INDEX = 1 << 17
#: Parts of texts whose ids a worker keeps from task to task while it writes (about 200 MB).
KEPT_PARTS = 1_200_000
#: Index slices that an open store keeps for later lookups.
OPEN_SLICES = 64
VALUES = ("shard", "offset", "length", "n_docs")


def _entry(key: str | None, number: int) -> bytes:
    return xxhash.xxh3_128_digest(b"\0" if key is None else key.encode(), seed=number)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the halves ``a`` and ``b`` of each entry's hash; drops the key's text."""
    for batch in batches:
        names, numbers = batch["name"].to_pylist(), batch["number"].to_pylist()
        both = np.frombuffer(b"".join(map(_entry, names, numbers)), dtype=np.uint64).reshape(-1, 2)
        rest = [n for n in batch.schema.names if n not in ("name", "number")]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), signed(both[:, 0]), signed(both[:, 1])], [*rest, "a", "b"])


def _with_hash(rows: DataFrame) -> DataFrame:
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("name", "number")]
    return rows.mapInArrow(_hashed, ", ".join([*rest, "a long", "b long"]))


def _slice_file(path: str, number: int) -> str:
    return f"{path}/index/{number:08d}.mph"


@dataclass
class TokenStore:
    spark: SparkSession
    path: str
    dtype: str
    slices: int
    repeats: bool
    _slices: dict[int, PerfectTable] = field(default_factory=dict, repr=False)
    _files: dict[int, str] | None = field(default=None, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenStore:
        """A store that was written before."""
        row = spark.read.parquet(f"{path}/meta").first()
        return cls(spark, path, row["dtype"], row["slices"], row["repeats"])

    def _manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, shard, offset, length) of the first key column's values, a row a document, through the index; unknown keys give no row."""
        key = F.col(keys.columns[0])
        asked = keys.select(key.alias("key")).distinct().select("key", F.col("key").cast("string").alias("name"), F.lit(0).alias("number"))
        first = self._probed(asked)
        if not self.repeats:
            return first.drop("n_docs")
        more = first.where("n_docs > 1").select("key", F.explode(F.sequence(F.lit(1), (F.col("n_docs") - 1).cast("int"))).alias("number"))
        return first.union(self._probed(more.select("key", F.col("key").cast("string").alias("name"), "number"))).drop("n_docs")

    def _probed(self, asked: DataFrame) -> DataFrame:
        kind, path = asked.schema["key"].dataType.simpleString(), self.path
        dealt = _with_hash(asked).withColumn("slice", F.pmod("a", F.lit(self.slices)))

        def probe(key: tuple[pa.Scalar, ...], wanted: pa.Table) -> pa.Table:
            table = PerfectTable.from_bytes(loaded(_slice_file(path, key[0].as_py())))
            slots = table.find(longs(wanted["a"]), longs(wanted["b"]))
            known = slots >= 0
            found = [pa.array(table.values[x][slots[known]].astype(np.int64)) for x in VALUES]
            return pa.table([wanted["key"].filter(pa.array(known)), *found], ["key", *VALUES])

        # A slice's file is read by the task that probes it; the index is never shuffled.
        return dealt.groupBy("slice").applyInArrow(probe, f"key {kind}, " + ", ".join(f"{x} long" for x in VALUES))

    def _lookup(self, key: str | None, number: int) -> tuple[int, int, int, int] | None:
        a, b = np.frombuffer(_entry(key, number), dtype=np.uint64)
        at = int(a.astype(np.int64) % self.slices)
        if at not in self._slices:
            if len(self._slices) >= OPEN_SLICES:
                self._slices.pop(next(iter(self._slices)))
            self._slices[at] = PerfectTable.from_bytes(loaded(_slice_file(self.path, at)))
        table = self._slices[at]
        slot = int(table.find(np.array([a]), np.array([b]))[0])
        return None if slot < 0 else tuple(int(table.values[x][slot]) for x in VALUES)

    def get(self, key, number: int = 0) -> np.ndarray | None:
        """The ids of a key's document (of several the ``number``-th): one index slice, one probe of its arrays, one ranged read."""
        found = self._lookup(None if key is None else str(key), number)
        if found is None:
            return None
        if self._files is None:
            self._files = {r["shard"]: r["file"] for r in self._manifest().select("shard", "file").collect()}
        shard, offset, length, _ = found
        fs, at = filesystem(self._files[shard])
        size = np.dtype(self.dtype).itemsize
        with fs.open_input_file(at) as f:
            f.seek(offset * size)
            return np.frombuffer(f.read(length * size), dtype=self.dtype)

    def count(self, key) -> int:
        """How many documents have this key."""
        found = self._lookup(None if key is None else str(key), 0)
        return found[3] if found else 0

    def read(self, keys: DataFrame) -> DataFrame:
        """(key, start, n_tokens, ids_crc32), a row a document, read back from the shard files; start counts all ids before the document."""
        manifest = self._manifest().select("shard", "file", "before")
        where = self.locate(keys).join(F.broadcast(manifest) if manifest.count() <= 10_000 else manifest, "shard")
        kind = where.schema["key"].dataType.simpleString()
        # Neighbours in a file are read by one task, in file order.
        where = where.repartition(F.col("file")).sortWithinPartitions("file", "offset")
        dtype = np.dtype(self.dtype)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, source = None, None
            for batch in batches:
                sums = []
                for file, offset, length in zip(*(batch[x].to_pylist() for x in ("file", "offset", "length")), strict=True):
                    if file != name:
                        if source:
                            source.close()
                        fs, at = filesystem(file)
                        name, source = file, fs.open_input_file(at)
                    source.seek(offset * dtype.itemsize)
                    sums.append(zlib.crc32(np.frombuffer(source.read(length * dtype.itemsize), dtype=dtype).astype("<u4")))
                start = np.array(batch["before"].to_pylist(), np.int64) + np.array(batch["offset"].to_pylist(), np.int64)
                yield pa.record_batch({"key": batch["key"], "start": pa.array(start), "n_tokens": batch["length"], "ids_crc32": pa.array(sums, pa.int64())})
            if source:
                source.close()

        return where.mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    keys_per_index: int = KEYS_PER_INDEX,
) -> TokenStore:
    """Encode every whole text, append ``end_id`` and write ids and index; see the module for the layout.

    Documents are dealt to shards by ranges of the key, so the shards' order
    is the order of keys (a null key comes first). A null or empty text is its
    end id alone. Rows that share a key are all kept, each a document of its
    own, in the order in which they are read; a key of very many rows spreads
    over several shards. An empty table gives an empty store. Other columns
    are not read.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    dtype = encoder(tokenizer).dtype
    size = dtype.itemsize
    shards = f"{path}/shards"
    made(shards)
    made(f"{path}/index")
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("key"), text.alias("text"), F.monotonically_increasing_id().alias("rid"))
    kind = picked.schema["key"].dataType.simpleString()
    dealt = picked.repartitionByRange("key", "rid").sortWithinPartitions("key", "rid").drop("rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, file, at, place = encoder(tokenizer), None, "", 0, 0
        enc.most_parts = KEPT_PARTS
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch in batches:
            if out is None and len(batch):
                file = f"{shards}/{shard:07d}-{uuid.uuid4().hex}.ids"
                fs, where = filesystem(file)
                out = fs.open_output_stream(where, buffer_size=1 << 20)
            starts, lengths = [], []
            for one in batch["text"].to_pylist():
                data = enc.encode([one])[0].tobytes() + end
                out.write(data)
                starts.append(at)
                lengths.append(len(data) // size)
                at += lengths[-1]
            took = len(starts)
            places = pa.array(np.arange(place, place + took))
            place += took
            fixed = {"shard": pa.array([shard] * took, pa.int64()), "file": pa.array([file] * took, pa.string())}
            yield pa.record_batch({"key": batch["key"], **fixed, "place": places, "offset": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())})
        if out:
            out.close()

    rows = written(dealt.mapInArrow(run, f"key {kind}, shard long, file string, place long, offset long, length long"), f"{path}/rows")
    spans = rows.groupBy("shard", "file").agg(F.sum("length").alias("n_ids"), F.count("*").alias("n_docs"))
    # One row a shard, not a document: the running sums in one task stay small.
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = {x: F.coalesce(F.sum(y).over(upto), F.lit(0)) for x, y in (("before", "n_ids"), ("docs_before", "n_docs"))}
    manifest = written(spans.withColumns(before), f"{path}/manifest")
    # Documents that share a key stand in a row: a document's number is its place after the key's first.
    placed = rows.join(manifest.select("shard", "docs_before"), "shard").withColumn("nth", F.col("docs_before") + F.col("place"))
    keys = placed.groupBy("key").agg(F.min("nth").alias("first"), F.count("*").alias("n_docs"))
    n, most = (int(x or 0) for x in keys.agg(F.sum("n_docs"), F.max("n_docs")).first())
    slices = max(1, math.ceil(n / keys_per_index))
    if most > 1:
        shared = keys.where("n_docs > 1").select(F.col("key").alias("k"), "first", "n_docs")
        placed = placed.join(shared, F.col("key").eqNullSafe(F.col("k")), "left").drop("k")
        number, n_docs = F.coalesce(F.col("nth") - F.col("first"), F.lit(0)).cast("int"), F.coalesce("n_docs", F.lit(1)).cast("long")
    else:
        number, n_docs = F.lit(0), F.lit(1).cast("long")
    entries = placed.select(F.col("key").cast("string").alias("name"), number.alias("number"), "shard", "offset", "length", n_docs.alias("n_docs"))
    sliced = _with_hash(entries).withColumn("slice", F.pmod("a", F.lit(slices)))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        values = {x: small(table[x].to_numpy()) for x in VALUES}
        saved(_slice_file(path, key[0].as_py()), PerfectTable.build(longs(table["a"]), longs(table["b"]), **values).to_bytes())
        return pa.table({"slice": [key[0].as_py()], "n": pa.array([len(table)], pa.int64())})

    held = {r["slice"] for r in sliced.groupBy("slice").applyInArrow(build, "slice long, n long").collect()}
    for empty in set(range(slices)) - held:
        none = np.zeros(0, np.uint64)
        saved(_slice_file(path, empty), PerfectTable.build(none, none, **{x: none for x in VALUES}).to_bytes())
    spark.createDataFrame([(dtype.str, slices, most > 1)], "dtype string, slices int, repeats boolean").write.parquet(f"{path}/meta")
    dropped(spark, f"{path}/rows")
    return TokenStore(spark, path, dtype.str, slices, most > 1)

"""Many literal patterns in many texts: Aho-Corasick automata over shards of the patterns, texts streamed over them.

The patterns are written once, dealt into shards of a bounded number of
characters. A task gathers its texts up to a bound and sweeps them over one
shard's automaton after the other, so time per text follows its length and the
number of shards, not the number of patterns. Python workers keep the
automaton of the last shard that they built. No text meets a pattern in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import filesystem, scratch, written

#: Characters of a shard's patterns, and of the texts that a task sweeps at once.
SHARD_CHARS, TEXT_CHARS = 4_000_000, 16_000_000

_built: dict[str, Any] = {}


@dataclass(frozen=True)
class Patterns:
    """Written patterns: ``path`` has the columns pattern, value by shard."""

    path: str
    shards: int

    def automaton(self, shard: int) -> Any:
        """The automaton of a shard; each match gives (pattern, value). None for a shard without patterns."""
        import ahocorasick
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        at = f"{self.path}/shard={shard}"
        if at not in _built:
            _built.clear()
            fs, inner = filesystem(at)
            found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            if fs.get_file_info(inner).type == FileType.Directory:
                for batch in ds.dataset(inner, filesystem=fs, format="parquet").to_batches(columns=["pattern", "value"]):
                    for pattern, value in zip(batch["pattern"].to_pylist(), batch["value"].to_pylist(), strict=True):
                        found.add_word(pattern, (pattern, value))
            found.make_automaton()
            _built[at] = found if len(found) else None
        return _built[at]

    def sweep(self, batches: Iterator[pa.RecordBatch], text: str, each: Callable[[pa.RecordBatch, int, set], None], shard_done: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        """Call ``each(batch, row, matches)`` for every text that holds patterns, shard by shard, and yield what ``shard_done`` gives after each."""
        held, size = [], 0

        def swept() -> Iterator[pa.RecordBatch]:
            for shard in range(self.shards):
                automaton = self.automaton(shard)
                if automaton is None:
                    continue
                for batch in held:
                    for row, value in enumerate(batch[text].to_pylist()):
                        if value and (hits := {x for _, x in automaton.iter(value)}):
                            each(batch, row, hits)
                yield from shard_done()

        for batch in batches:
            held.append(batch)
            size += batch[text].nbytes
            if size > TEXT_CHARS:
                yield from swept()
                held, size = [], 0
        if held:
            yield from swept()


def write_patterns(patterns: DataFrame, shard_chars: int = SHARD_CHARS) -> Patterns:
    """Deal patterns (pattern, value; patterns distinct and not empty) into shards of the shared folder."""
    spark = patterns.sparkSession
    chars = patterns.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // shard_chars))
    path = scratch(spark, "patterns")
    written(patterns.withColumn("shard", F.pmod(F.xxhash64("pattern"), F.lit(shards)).cast("int")).repartition(shards, "shard"), path, "shard")
    return Patterns(path, shards)


def held_values(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id_col, value, n): for each row and value the number of distinct patterns of that value that the text holds.

    ``patterns``: pattern (distinct, not empty), values (array of strings). A row
    is one of ``texts``; with several shards its values may come in several
    rows, which the caller sums.
    """
    known = write_patterns(patterns.select("pattern", F.to_json("values").alias("value")), shard_chars)
    kind = texts.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        out: dict[int, tuple[pa.Array, list[int], list[str], list[int]]] = {}

        def each(batch: pa.RecordBatch, row: int, hits: set) -> None:
            counts: dict[str, int] = {}
            for _, values in hits:
                for v in json.loads(values):
                    counts[v] = counts.get(v, 0) + 1
            _, rows, values, n = out.setdefault(id(batch), (batch["id"], [], [], []))
            rows.extend([row] * len(counts))
            values.extend(counts)
            n.extend(counts.values())

        def done() -> Iterator[pa.RecordBatch]:
            for ids, rows, values, n in out.values():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(values, pa.string()), pa.array(n, pa.int64())], ["id", "value", "n"])
            out.clear()

        return known.sweep(batches, "text", each, done)

    picked = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    return picked.mapInArrow(run, f"id {kind}, value string, n long").withColumnRenamed("id", id_col)


def least_holder(texts: DataFrame, patterns: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(pattern, id): for each pattern the least id of a text (text, id) that holds it; patterns in no text are left out.

    A task sends one row for a pattern, however many of its texts hold it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    known = write_patterns(patterns.select("pattern", F.lit(0).alias("value")), shard_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, Any] = {}

        def each(batch: pa.RecordBatch, row: int, hits: set) -> None:
            i = batch["id"][row].as_py()
            for pattern, _ in hits:
                if pattern not in best or i < best[pattern]:
                    best[pattern] = i

        def done() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array(list(best.values()))], ["pattern", "id"])
            best.clear()

        return known.sweep(batches, "text", each, done)

    found = texts.select("text", "id").mapInArrow(run, f"pattern string, id {kind}")
    return found.groupBy("pattern").agg(F.min("id").alias("id"))


def least_held(texts: DataFrame, patterns: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(text, id): for each text (distinct) the least id of the patterns (pattern, id) that it holds; texts without any are left out."""
    kind = patterns.schema["id"].dataType.simpleString()
    known = write_patterns(patterns.select("pattern", F.col("id").alias("value")), shard_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, Any]] = []

        def each(batch: pa.RecordBatch, row: int, hits: set) -> None:
            out.append((batch["text"][row].as_py(), min(x for _, x in hits)))

        def done() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out])], ["text", "id"])
            out.clear()

        return known.sweep(batches, "text", each, done)

    return texts.select("text").mapInArrow(run, f"text string, id {kind}").groupBy("text").agg(F.min("id").alias("id"))

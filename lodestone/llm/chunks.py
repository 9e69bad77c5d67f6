"""Documents written once in numbered chunks, and side tables that each chunk's tasks read back.

Some operators look whole texts at twice: what the first look finds is settled
across the cluster, and the second look needs, for each chunk of documents,
only the small part of the answer that concerns that chunk. The texts are then
never shuffled: the answer is written below the shared folder by chunk, and
the task that reads a chunk's texts loads that chunk's part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, filesystem, scratch, written

CHUNKS_A_FOLDER, FILES_A_FOLDER = 64, 16


class Chunks:
    """``table``: id, text (null as empty), ``rid`` (a unique row number) and ``chunk``, in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.path = scratch(self.spark, "chunks")
        numbered = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
        # The number of a row holds the task that wrote it; once written, it stays whatever runs again.
        self.table = written(numbered.withColumn("chunk", F.shiftright("rid", 33).cast("int")), self.path)
        self.sides: list[str] = []

    @property
    def id_type(self) -> str:
        return self.table.schema["id"].dataType.simpleString()

    def side(self, rows: DataFrame) -> Callable[[int], pa.Table | None]:
        """Write ``rows`` (with a ``chunk`` column) by chunk; the result loads one chunk's rows on an executor.

        ``CHUNKS_A_FOLDER`` chunks share a folder, in files sorted by chunk, so
        a load reads the row groups of its chunk alone and folders stay few.
        """
        path = scratch(self.spark, "side")
        self.sides.append(path)
        folder = F.floor(F.col("chunk") / CHUNKS_A_FOLDER).cast("int")
        dealt = rows.withColumn("folder", folder).repartition("folder", F.pmod("chunk", F.lit(FILES_A_FOLDER))).sortWithinPartitions("folder", "chunk")
        dealt.write.partitionBy("folder").option("compression", "zstd").option("parquet.block.size", 1 << 22).parquet(path)
        last: dict[int, pa.Table | None] = {}

        def load(chunk: int) -> pa.Table | None:
            import pyarrow.parquet as pq
            from pyarrow import fs as pafs

            if chunk in last:
                return last[chunk]
            last.clear()
            fs, at = filesystem(f"{path}/folder={chunk // CHUNKS_A_FOLDER}")
            files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if x.base_name.endswith(".parquet"))
            parts = [pq.read_table(x, filesystem=fs, partitioning=None, filters=[("chunk", "=", chunk)]) for x in files]
            held = pa.concat_tables(parts) if parts else None
            last[chunk] = held if held is not None and len(held) else None
            return last[chunk]

        return load

    def map(self, run: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, table: DataFrame | None = None) -> DataFrame:
        """``run(chunk, batches)`` for each run of rows of one chunk in a task (a chunk may be cut into several).

        Over the documents, or over another ``table`` with a ``chunk`` column.
        """

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def cut() -> Iterator[tuple[int, pa.RecordBatch]]:
                for batch in batches:
                    column = batch["chunk"].to_numpy()
                    at = 0
                    while at < len(column):
                        end = at + int((column[at:] == column[at]).sum())
                        yield int(column[at]), batch.slice(at, end - at)
                        at = end

            for chunk, parts in groupby(cut(), key=itemgetter(0)):
                yield from run(chunk, map(itemgetter(1), parts))

        return (self.table if table is None else table).mapInArrow(each, schema)

    def release(self, texts: bool = False) -> None:
        dropped(self.spark, *self.sides, *([self.path] if texts else []))
        self.sides = []

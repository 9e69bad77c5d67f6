"""One JSON file a row, written by many tasks.

Spark's own writer opens a file a row as well if told so, but in as many tasks
as the table has partitions, with a checksum file and a call of chmod for each
where Hadoop's native library is missing, and its commit moves every file by
itself. Here rows are dealt out, tasks write into a folder of their attempt,
and the commit moves these folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lodestone.scratch import filesystem


@dataclass
class Folder(WriterCommitMessage):
    """The folder of a task's attempt; None if it had no rows."""

    name: str | None


class PaperWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        self.beside = f"{path}/.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Folder:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():08d}-{context.taskAttemptId()}"
        fs, beside = filesystem(self.beside)
        made: set[str] = set()
        for n, (folder, text) in enumerate(iterator):
            at = f"{beside}/{name}/{folder}"
            if at not in made:
                fs.create_dir(at, recursive=True)
                made.add(at)
            with fs.open_output_stream(f"{at}/{n}.json") as out:
                out.write(text.encode())
        return Folder(name if made else None)

    def commit(self, messages: list[Folder | None]) -> None:
        fs, target = filesystem(self.path)
        _, beside = filesystem(self.beside)
        for m in messages:
            if m is not None and m.name:
                # A writer's folders have names of their own, so a second write to the path adds to it.
                fs.move(f"{beside}/{m.name}", f"{target}/{beside.rpartition('-')[2]}-{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Folder | None]) -> None:
        from pyarrow.fs import FileType

        fs, folder = filesystem(self.beside)
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class PaperSink(DataSource):
    """Rows (folder string, text string) into files of one text each, in nested folders below the path."""

    @classmethod
    def name(cls) -> str:
        return "paper_files"

    def schema(self) -> str:
        return "folder string, text string"

    def writer(self, schema: T.StructType, overwrite: bool) -> PaperWriter:
        return PaperWriter(self.options["path"])


def write_papers(df: DataFrame, path: str, folder: str, tasks: int = 64) -> None:
    """One JSON document a row, each in a file of its own, in folders below ``path`` named by the column ``folder`` and its value.

    The folder of ``path`` must be one that the driver and the executors share.
    With over 32 ``tasks`` readers list the folders in parallel.
    """
    df.sparkSession.dataSource.register(PaperSink)
    document = F.to_json(F.struct(*(c for c in df.columns if c != folder)))
    named = F.concat(F.lit(f"{folder}="), F.coalesce(F.url_encode(F.col(folder).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__")))
    rows = df.repartition(tasks).select(named.alias("folder"), document.alias("text"))
    rows.write.format("paper_files").option("path", path).mode("append").save()

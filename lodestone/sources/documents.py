"""One ordered document from the rows of many tasks, in two phases.

Tasks write their rows as fragments beside the target, in the order that they
have them. The commit joins the fragments by their tasks' order, with the
document's fixed parts between them, as a stream of bounded pieces, and moves
the whole to its place: readers see the old document or the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lodestone.scratch import filesystem

#: Bytes that the commit copies at a time.
PIECE = 4 << 20


@dataclass
class Fragment(WriterCommitMessage):
    """A task's file: for each slot (number, first byte, bytes), and the task's place."""

    task: int
    path: str
    slots: list[tuple[int, int, int]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.parts, self.separator = json.loads(options["parts"]), options["separator"].encode()
        self.beside = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Fragment:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, folder = filesystem(self.beside)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}"
        slots: list[list[int]] = []
        at = 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                text = row[1].encode()
                if not slots or slots[-1][0] != row[0]:
                    slots.append([row[0], at, 0])
                elif self.separator:
                    out.write(self.separator)
                    at += len(self.separator)
                out.write(text)
                at += len(text)
                slots[-1][2] = at - slots[-1][1]
        return Fragment(context.partitionId(), path, [tuple(s) for s in slots])

    def commit(self, messages: list[Fragment | None]) -> None:
        fs, target = filesystem(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        whole = f"{target}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(whole) as out:
            for slot, fixed in enumerate(self.parts):
                out.write(fixed.encode())
                first = True
                for m in done:
                    for number, start, size in m.slots:
                        if number != slot:
                            continue
                        if not first:
                            out.write(self.separator)
                        first = False
                        with fs.open_input_file(m.path) as held:
                            held.seek(start)
                            while size:
                                piece = held.read(min(PIECE, size))
                                out.write(piece)
                                size -= len(piece)
        fs.move(whole, target)
        self.abort(messages)

    def abort(self, messages: list[Fragment | None]) -> None:
        from pyarrow.fs import FileType

        fs, folder = filesystem(self.beside)
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class DocumentSink(DataSource):
    """Rows (slot int, text string) into one file: the fixed ``parts``, after each but the last the texts of its slot, joined by ``separator``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def schema(self) -> str:
        return "slot int, text string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_document(path: str, parts: list[str], slots: list[tuple[DataFrame, Column, list[Column]]], tasks: int = 16, separator: str = ",") -> None:
    """Write one text file: the ``parts`` in turn, between two of them the rows of a slot.

    Each slot is (rows, text, order): a text of each row, in the total order
    given. There is one part more than slots. Rows are sorted over ``tasks``
    tasks and never gathered; a slot without rows is empty. Null texts are
    left out. The folder of ``path`` must be one that the driver and the
    executors share.
    """
    if len(parts) != len(slots) + 1:
        raise ValueError("there is one part more than slots")
    spark = slots[0][0].sparkSession
    rows = None
    for number, (df, text, order) in enumerate(slots):
        # Orders of different slots may differ in number and type, so each is sorted on its own; a union keeps its parts' order.
        part = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order else df.coalesce(1)
        part = part.select(F.lit(number).alias("slot"), text.alias("text")).where("text is not null")
        rows = part if rows is None else rows.union(part)
    spark.dataSource.register(DocumentSink)
    rows.write.format("ordered_document").option("path", path).option("parts", json.dumps(parts)).option("separator", separator).mode("append").save()


def json_rows(df: DataFrame) -> Column:
    """A row as JSON, nulls kept."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})

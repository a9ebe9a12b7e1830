"""A sink that makes one text file of ordered rows, as a Spark data source.

Tasks write their rows as parts beside the file; when all have ended, the parts are put together in order under another
name, and the file appears by a rename. If a task fails for good, the parts go and the file is as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are copied at a time.
COPY_BYTES = 8 << 20


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class OneFile(DataSource):
    """`text` is written as it is, rows in the order of partitions and of rows within them. Option path: a path or URI of a file
    system that pyarrow opens (local, HDFS, S3, ...), which all executors and the driver see."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], f"parts-{uuid.uuid4().hex}")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def _at(self) -> tuple[fs.FileSystem, str, str]:
        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else "/" + self.path.removeprefix("file:").lstrip("/"))
        return system, path, f"{path}.{self.name}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, _, folder = self._at()
        context = TaskContext.get()
        system.create_dir(folder, recursive=True)
        part = f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}"
        with system.open_output_stream(part) as out:
            for row in iterator:
                out.write((row[0] or "").encode())
        return _Part(context.partitionId(), part)

    def commit(self, messages: list) -> None:
        system, path, folder = self._at()
        whole = f"{folder}/whole"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(whole) as out:
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with system.open_input_stream(part.path) as source:
                    while piece := source.read(COPY_BYTES):
                        out.write(piece)
        system.move(whole, path)
        system.delete_dir(folder)

    def abort(self, messages: list) -> None:
        system, _, folder = self._at()
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def write_one_file(rows: DataFrame, order: str, text: str, path: str) -> None:
    """One file of the texts of all rows by the order of a column, with nothing between them. Null texts are empty."""
    spark = rows.sparkSession
    spark.dataSource.register(OneFile)
    lined = rows.select(F.col(order).alias("_o"), F.col(text).alias("text")).repartitionByRange("_o").sortWithinPartitions("_o").select("text")
    lined.write.format("onefile").mode("append").option("path", path).save()

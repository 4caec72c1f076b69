"""Files written by executors: bytes of each stream, and lines of text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class ByteFileWriter(DataSourceWriter):
    """One file a row (name, bytes). A file is written aside and renamed, so a task that runs again leaves no half."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        from pyspark.sql.datasource import WriterCommitMessage as Message

        os.makedirs(self.path, exist_ok=True)
        for name, content in rows:
            if os.sep in name:
                raise ValueError(f"not a file name: {name}")
            aside = os.path.join(self.path, f".{uuid.uuid4().hex}")
            with open(aside, "wb") as f:
                f.write(bytes(content))
            os.replace(aside, os.path.join(self.path, name))
        return Message()


class ByteFiles(DataSource):
    """Sink `byte_files`: columns name and bytes, written below a path that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return "name string, bytes binary"

    def writer(self, schema, overwrite: bool) -> ByteFileWriter:
        if not self.options.get("path"):
            raise ValueError("the sink byte_files needs a path")
        return ByteFileWriter(self.options["path"])


def write_byte_files(files: DataFrame, path: str) -> None:
    """Write (name, bytes) as one file each."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(ByteFiles)
    files.select("name", "bytes").write.format("byte_files").mode("append").save(path)


def write_lines(lines: DataFrame, order: str, column: str, path: str) -> None:
    """Write a text column as text files that are in order across files."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)
